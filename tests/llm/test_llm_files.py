"""Archives and token files: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import simple8b, token_ids, warc
from lexmill.llm.common import Workspace


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    a = np.array(ids, np.uint32)
    words, offsets = simple8b.encode(a, block)
    assert (simple8b.decode(words, offsets, len(a), block) == a).all()
    assert len(offsets) == -(-len(a) // block)


def test_simple8b_packs():
    a = np.array([1] * 600, np.uint32)
    assert len(simple8b.encode(a, 1024)[0]) == 10
    assert len(simple8b.encode(np.array([2**30] * 4, np.uint32), 1024)[0]) == 4  # escapes stand alone


def test_warc_round_trip(spark):
    big, small = "<p>" + "é" * 100, "x" * 99
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (1, "http://b\r\nX: y", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "http://c", "ü" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    ws = Workspace(spark)
    warc.write_archive(pages, ws.path("a"), ws)
    got = {r.page_id: r for r in warc.read_archive(spark, ws.path("a")).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(raw) >= 100 and i is not None and i != min(same)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None)
    records = {r.page_id: r for r in warc.records(spark, ws.path("a")).collect()}
    r = bytes(records[3].record)
    assert r.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and r.endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n")
    assert b"Content-Length: %d\r\n" % len(big.encode()) in r + b"\r\n"
    assert bytes(records[5].payload) == big.encode() and b"WARC-Refers-To: <urn:page:3>" in bytes(records[5].record)
    assert spark.read.parquet(ws.path("a") + "/payloads").count() == 4
    ws.close()


def test_warc_keeps_every_url(spark):
    body = "z" * 200
    urls = ["http://a\u2028WARC-Payload-Digest: sha256:abc", "http://a\u0085WARC-Type: response", "http://a\u2029WARC-Record-ID: <urn:page:77>", "", None, "x\r\nWARC-Type: revisit\r\n\r\n", "a%0Ab", "\r", "plain"]
    rows = [(i, u, body) for i, u in enumerate(urls)]
    ws = Workspace(spark)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), ws.path("a"), ws, date=F.concat(F.lit("2020-01-0"), F.col("page_id") + 1, F.lit("T00:00:00Z")))
    got = {r.page_id: r for r in warc.read_archive(spark, ws.path("a")).collect()}
    assert {i: r.url for i, r in got.items()} == dict(enumerate(urls))
    assert [(r.record_type, r.refers_to) for _, r in sorted(got.items())] == [("response", None)] + [("revisit", 0)] * 8
    assert {r.page_id: b"WARC-Date: 2020-01-0%d" % (r.page_id + 1) in bytes(r.record) for r in warc.records(spark, ws.path("a")).collect()} == dict.fromkeys(range(9), True)
    ws.close()


def test_warc_ids_of_other_types(spark):
    body = "z" * 200
    ids = ["b>c", "a d/é", "-", "", None, "a d/é"]
    ws = Workspace(spark)
    warc.write_archive(spark.createDataFrame([(i, "u", body) for i in ids], "page_id string, url string, html string"), ws.path("a"), ws)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, ws.path("a")).collect()), key=str)
    assert got == sorted([(i, "revisit" if i else "response", "" if i else None) for i in ids], key=str)
    ws.close()


def test_warc_shares_out_hot_payloads(spark):
    rows = [(i, f"u{i}", "h" * 300 if i % 3 else f"{i} " * 60) for i in range(600)]
    ws = Workspace(spark)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), ws.path("a"), ws, bits_per_row=1)
    assert spark.read.parquet(ws.path("a") + "/payloads").count() == 201
    got = {r.page_id: (r.url, r.payload.decode()) for r in warc.records(spark, ws.path("a")).select("page_id", "url", F.decode("payload", "UTF-8").alias("p"), "payload").collect()}
    assert got == {i: (u, h) for i, u, h in rows}
    ws.close()


def test_warc_fails_on_lost_payloads(spark):
    ws = Workspace(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string"), ws.path("a"), ws)
    rest = [(hashlib.sha256(b"one").hexdigest(), bytearray(b"one"))]
    spark.createDataFrame(rest, "digest string, payload binary").write.mode("overwrite").parquet(ws.path("a") + "/payloads")
    with pytest.raises(Exception, match="no payload as the header says"):
        warc.read_archive(spark, ws.path("a")).collect()
    ws.close()


def test_warc_empty_and_damaged(spark):
    ws = Workspace(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, ws.path("a"), ws)
    assert warc.read_archive(spark, ws.path("a")).count() == 0
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write_archive(pages, ws.path("b"), ws)
    spark.createDataFrame([(hashlib.sha256(b"text").hexdigest(), bytearray(b"other"))], "digest string, payload binary").write.mode("overwrite").parquet(ws.path("b") + "/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, ws.path("b")).collect()
    ws.close()


TEXTS = [(7, "Hello, world! It's 3.5% <|endoftext|> done"), (2, None), (9, ""), (4, "Éternité ünïcode ß日本語 résumé́\tx y 'tis  don't"), (4, "again"), (None, "first"), (1, "word " * 3000), (3, "$$$ thor%%% HEING!! a|b \x1c end\n\nnew"), (5, "İstanbul ΑΣ µm ª")]


def test_token_ids_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    d = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("shard", F.lit(1))
    got = {}
    for by_word in (True, False):
        ws = Workspace(spark)
        token_ids.write_ids(d, ws.path("ids"), path, by_word=by_word, segment_ids=50, block=16, shards=3)
        got[by_word] = sorted(map(tuple, token_ids.read_ids(spark, ws.path("ids")).collect()), key=lambda r: r[1])
        ws.close()
    at, want = 0, []
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in ordered:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got[True] == got[False]
    assert sorted(((r[0], r[2], r[3]) for r in got[True]), key=str) == sorted(want, key=str)
    for r in got[True]:
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in got[True]] == [i for i, _ in ordered]


def test_token_ids_of_other_id_types(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    for kind, ids in (("string", ["b", "a", None, "10", "a"]), ("long", [2**62 + 1, 2**62, None, -5, 2**62]), ("date", None)):
        rows = [(i, f"text number {k}") for k, i in enumerate(ids or [f"2020-01-0{k}" for k in (3, 1, 2)])]
        d = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'date' else kind}, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        ws = Workspace(spark)
        got = sorted(token_ids.encoded(d, ws, path, shards=2).collect(), key=lambda r: r.start)
        want = [r[0] for r in d.orderBy(F.col("doc_id").asc_nulls_first()).select("doc_id").collect()]
        assert [r.doc_id for r in got] == want and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
        ws.close()


def test_token_ids_by_word_only_under_its_rules(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import json

    path = public.path("word_bpe_49k.json")
    rules = json.load(open(path, encoding="utf-8"))
    assert token_ids.cuts_at_blanks(path)
    for k, v in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "[CLS]"}])):
        other = tmp_path / "t.json"
        other.write_text(json.dumps(rules | {k: v}), "utf-8")
        assert not token_ids.cuts_at_blanks(str(other))


def test_token_ids_empty(spark):
    public = pytest.importorskip("public_tokenizers")
    ws = Workspace(spark)
    d = spark.createDataFrame([], "doc_id long, text string")
    assert token_ids.encoded(d, ws, public.path("word_bpe_49k.json")).count() == 0
    ws.close()
