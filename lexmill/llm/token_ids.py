"""Token ids in a binary file format, coded with Simple-8b.

The files are Parquet, so any store Spark writes to will do and Spark's commit
keeps failed tasks' files out. A row is a segment of one shard; shards hold
ascending ranges of ids, segments of a shard follow one another in order:

- shard, segment, first (ids of the shard before the segment)
- doc_ids, lens: the documents of the segment and how many ids each has
- n_ids, block, offsets: ids in all, ids a block, first word of each block
- words: the 64-bit words, little-endian

A segment holds whole documents: ``segment_ids`` ids, or one longer document.
Memory is bounded by an Arrow batch of texts and the longest document. Texts
are encoded where they are read; what is shuffled into the order of ids is the
token ids, two bytes each where they fit.

Edge cases: null and empty texts have the end id only. A null doc_id comes
first; ids may be of any type that casts to and from strings. Rows that repeat
a doc_id stand in order of a hash of their text. Special tokens
written out in a text are what the tokenizer makes of them. An empty table
writes no segments and reads back as no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import simple8b
from lexmill.llm.common import Workspace, table

SCHEMA = "shard int, segment int, first long, doc_ids array<string>, lens array<long>, n_ids long, block int, offsets array<long>, words binary"
ENCODED = "doc_id string, h long, wide boolean, ids binary"
_MAX_WORDS = 1_000_000
# The rules of a tokenizer file under which stretches between blanks can be encoded one by one.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters that are one code point in any normal form, and marks that the tokenizer splits off.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\]^_{}~]*)")


class WordIds(dict):
    """A stretch between blanks -> its ids as bytes; emptied when it gets large."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # the tokenizer's alphabet for bytes: printable ones stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def stem(self, word: str) -> bytes:
        plain = word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()])
        out = self.stems[word] = array("I", [x.id for x in self.tokenizer.model.tokenize(plain)]).tobytes()
        return out

    def mark(self, marks: str) -> bytes:
        out = self.marks[marks] = array("I", self.encode(marks)).tobytes()
        return out

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= _MAX_WORDS:
            for d in (self, self.stems, self.marks):
                d.clear()
        if m := _PLAIN.fullmatch(stretch):
            word, marks = m[1].lower(), m[2]
            ids = self.stems.get(word) or self.stem(word)
            if marks:
                ids += self.marks.get(marks) or self.mark(marks)
        else:
            ids = array("I", self.encode(stretch)).tobytes()
        self[stretch] = ids
        return ids


def cuts_at_blanks(path: str) -> bool:
    """Whether the tokenizer file has the rules of BY_WORD, and special tokens that start with <| only."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    return all(rules.get(k) == v for k, v in BY_WORD.items()) and all(t["content"].startswith("<|") for t in rules.get("added_tokens", ()))


def text_ids(text: str | None, words: WordIds | None, encode, end_id: int) -> np.ndarray:
    """The ids of a whole text and the end id.

    ``words`` serves tokenizers that never look across a blank, for texts that
    cannot hold a special token.
    """
    if not text:
        return np.array([end_id], np.uint32)
    if words is None or "<|" in text:
        return np.array([*encode(text), end_id], np.uint32)
    parts = text.replace("\n", " ").split(" ")
    return np.frombuffer(b"".join([*map(words.__getitem__, parts), array("I", (end_id,)).tobytes()]), np.uint32)


def _encoder(path: str, end_id: int, by_word: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(path)
        for b in batches:
            ids = [text_ids(t, words if by_word else None, words.encode, end_id) for t in b["text"]]
            wide = [bool(i.max() >= 1 << 16) for i in ids]
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "wide": wide, "ids": [i.astype("<u4" if w else "<u2").tobytes() for i, w in zip(ids, wide, strict=True)]})

    return run


def _writer(segment_ids: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal segment, first, held
            ids = np.concatenate(parts)
            coded, offsets = simple8b.encode(ids, block)
            row = {"shard": shard, "segment": segment, "first": first, "doc_ids": list(docs), "lens": [len(p) for p in parts], "n_ids": len(ids), "block": block, "offsets": offsets, "words": coded.astype("<u8").tobytes()}
            segment, first, held = segment + 1, first + len(ids), 0
            docs.clear()
            parts.clear()
            return pd.DataFrame([row])

        for b in batches:
            for doc_id, wide, raw in zip(b["doc_id"], b["wide"], b["ids"], strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)
                if parts and held + len(ids) > segment_ids:
                    yield flush()
                docs.append(doc_id)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", by_word: bool | None = None, segment_ids: int = 1 << 18, block: int = 1024, shards: int | None = None) -> None:
    """Writes the ids of ``docs`` to ``path`` in ascending order of ``id_col``.

    ``by_word`` encodes by stretches between blanks; unset, if the file's rules allow it.
    """
    spark = docs.sparkSession
    by_word = cuts_at_blanks(tokenizer) if by_word is None else by_word
    ws = Workspace(spark)
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    coded = ws.save(d.mapInPandas(_encoder(tokenizer, end_id, by_word), ENCODED), "encoded")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").cast(docs.schema[id_col].dataType).asc_nulls_first(), F.col("h")]
    coded = coded.repartitionByRange(shards, *order).sortWithinPartitions(*order, "ids")
    coded.select("doc_id", "wide", "ids").mapInPandas(_writer(segment_ids, block), SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)
    ws.close()


def segment_rows(row) -> Iterator[tuple[str | None, int, np.ndarray]]:
    """(doc_id as text, place in the shard, ids) of a segment's documents."""
    ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.asarray(row["offsets"]), int(row["n_ids"]), int(row["block"]))
    at = 0
    for doc_id, n in zip(row["doc_ids"], row["lens"], strict=True):
        yield doc_id, int(row["first"]) + at, ids[at : at + n]
        at += n


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row in b.to_dict("records"):
            got = [(d, at, len(i), zlib.crc32(i.astype("<u4").tobytes())) for d, at, i in segment_rows(row)]
            yield pd.DataFrame({"shard": row["shard"], "doc_id": pd.Series([g[0] for g in got], dtype=object), "at": [g[1] for g in got], "n_tokens": [g[2] for g in got], "ids_crc32": [g[3] for g in got]})


def read_ids(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id as ``id_type``, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    docs = files.mapInPandas(_summary, "shard int, doc_id string, at long, n_tokens long, ids_crc32 long")
    # one total a shard: as many rows as tasks wrote
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    before, starts = 0, []
    for r in sorted(totals, key=lambda r: r["shard"]):
        starts.append((r["shard"], before))
        before += r["n"]
    starts = spark.createDataFrame(starts, "shard int, before long")
    return docs.join(F.broadcast(starts), "shard").select(F.col("doc_id").cast(id_type).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_ids(spark, sf_dir):
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), Workspace(spark), public_tokenizers.path("word_bpe_49k.json"))


def encoded(docs: DataFrame, ws: Workspace, tokenizer: str, **kw) -> DataFrame:
    """Writes the ids below the workspace and reads them back."""
    write_ids(docs, ws.path("ids"), tokenizer, **kw)
    return read_ids(docs.sparkSession, ws.path("ids"), docs.schema[kw.get("id_col", "doc_id")].dataType.simpleString())
