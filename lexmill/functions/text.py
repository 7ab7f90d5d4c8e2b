"""Text functions as column expressions: folding, names, phrases, extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, one for one.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

# Words that carry no identity in a party's name. Single letters are initials there ("A&E"), and connectives
# only in the looser key of lists.
STOPWORDS = ("DA", "DE", "DO", "DAS", "DOS", "EM", "NO", "NA", "NOS", "NAS", "AS", "OS")
LOOSE_STOPWORDS = (*STOPWORDS, "E", "A", "O")
COMPANY_FORMS = ("SA", "S", "A", "LTDA", "ME", "EPP", "EIRELI", "MEI", "CIA")
ROLES = (
    "REQUERIDO", "REQUERIDA", "REQUERENTE", "IMPETRADO", "IMPETRADA", "IMPETRANTE", "EXECUTADO", "EXECUTADA", "EXEQUENTE", "AUTOR", "AUTORA", "REU", "RE",
    "RECORRENTE", "RECORRIDO", "RECORRIDA", "APELANTE", "APELADO", "APELADA", "AGRAVANTE", "AGRAVADO", "AGRAVADA", "INTERESSADO", "INTERESSADA", "ASSISTENTE",
    "LITISCONSORTE", "TERCEIRO", "EMBARGANTE", "EMBARGADO", "EMBARGADA", "PERITO", "REPRESENTANTE", "SUCESSOR", "HERDEIRO", "INVENTARIANTE",
)
PLACEHOLDERS = (
    "INFORMACAO PROTEGIDA", "INFORMACAO SIGILOSA", "SEGREDO JUSTICA", "NOME PROTEGIDO", "PARTE SIGILOSA", "SIGILOSO", "SIGILOSA", "NAO INFORMADO", "NAO INFORMADA",
    "NAO IDENTIFICADO", "NAO IDENTIFICADA", "DESCONHECIDO", "DESCONHECIDA", "SEM NOME", "A APURAR", "NOME", "NULL",
)
ACRONYM_MAX = 8
SEPARATOR = r"\s*[-–—/|:;,]\s*"
UFS = ("AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO")


def fold(c: Column) -> Column:
    """Lower case without accents; the length stays."""
    return F.lower(F.translate(c, ACCENTED, PLAIN))


def fold_py(s: str) -> str:
    return s.translate(str.maketrans(ACCENTED, PLAIN)).lower()


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def without_parentheses(c: Column) -> Column:
    """Text in parentheses goes, nested up to four deep."""
    for _ in range(4):
        c = F.regexp_replace(c, r"\([^()]*\)", " ")
    return c


def contains_in_order(c: Column, term: str) -> Column:
    """Whether the folded text has the term's words in order, anything between."""
    words = [re.escape(w) for w in fold_py(term).split()]
    return fold(c).rlike("(?s)" + ".*".join(words)) if words else F.lit(True)


def has_all_tokens(toks: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), toks)) == 0


def padded(toks: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def has_phrase(toks: Column, phrase: str | Column) -> Column:
    """Whether the tokens of the phrase stand one after another."""
    p = phrase if isinstance(phrase, Column) else F.lit(" ".join(re.findall("[a-z0-9]+", fold_py(phrase))))
    return padded(toks).contains(F.concat(F.lit(" "), p, F.lit(" ")))


def has_prefix_query(toks: Column, query: str) -> Column:
    """All words but the last as they are, the last as a prefix."""
    words = re.findall("[a-z0-9]+", fold_py(query))
    if not words:
        return F.lit(False)
    last = F.exists(toks, lambda t: t.startswith(words[-1]))
    return has_all_tokens(toks, words[:-1]) & last if words[:-1] else last


def split_query(query: str) -> tuple[list[str], list[str]]:
    """(quoted phrases, loose words) of a search box."""
    phrases = [p.strip() for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    return phrases, re.findall("[a-z0-9]+", fold_py(re.sub(r'"[^"]*"', " ", query)))


def matches_query(toks: Column, query: str) -> Column:
    """All phrases and all loose words."""
    phrases, words = split_query(query)
    out = has_all_tokens(toks, words) if words else F.lit(True)
    for p in phrases:
        out = out & has_phrase(toks, p)
    return out


def _drop_tail(toks: Column, words: tuple[str, ...]) -> Column:
    """Without trailing tokens of the list, while a token is left."""
    keep = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), F.lit(1), lambda acc, i: F.when(F.try_element_at(toks, i).isin(*words), acc).otherwise(i))
    return F.when(F.size(toks) == 0, toks).otherwise(F.slice(toks, 1, keep))


def normal_name(c: Column) -> Column:
    """The key under which spellings of a party's name meet.

    Upper case without accents; no text in parentheses; of segments cut by
    - / | : ; , acronyms go, but for the first; no connectives; no role and no
    company form at the end.
    """
    return F.array_join(_drop_tail(_drop_tail(_key_tokens(c, True, STOPWORDS), ROLES), COMPANY_FORMS), " ")


def grouping_name(c: Column) -> Column:
    """A looser key for lists: acronyms go from any segment, single-letter connectives go too, roles and forms stay."""
    return F.array_join(_key_tokens(c, False, LOOSE_STOPWORDS), " ")


def _key_tokens(c: Column, keep_first: bool, stopwords: tuple[str, ...]) -> Column:
    """A name's words without acronym segments and stopwords, unless nothing else is left."""
    text = without_parentheses(F.upper(strip_accents(F.coalesce(c, F.lit("")))))
    alnum = lambda x: F.filter(F.split(x, "[^A-Z0-9]+"), lambda t: t != "")
    segments = F.filter(F.split(text, SEPARATOR), lambda s: F.trim(s) != "")
    long = lambda s: (F.size(alnum(s)) != 1) | ~F.length(F.array_join(alnum(s), "")).between(2, ACRONYM_MAX)
    body = F.filter(segments, lambda s, i: (F.lit(keep_first) & (i == 0)) | long(s))
    toks = alnum(F.array_join(F.when(F.size(body) > 0, body).otherwise(segments), " "))
    useful = F.filter(toks, lambda t: ~t.isin(*stopwords))
    return F.when(F.size(useful) > 0, useful).otherwise(toks)


def clean_label(c: Column) -> Column:
    """A name to show: no parentheses, no role at its end; case and accents stay."""
    t = squeeze(without_parentheses(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(t, rf"(?i)(\s*[-–—/|:;,]*\s*\b({'|'.join(ROLES)})\b)+\s*$", ""))


def identity_tokens(c: Column) -> Column:
    return F.filter(F.split(F.upper(strip_accents(clean_label(c))), "[^A-Z0-9]+"), lambda t: t != "")


def is_sub_phrase(small: Column, large: Column) -> Column:
    """Whether the small token list stands in the large one, which is longer."""
    return (F.size(small) > 0) & (F.size(small) < F.size(large)) & padded(large).contains(padded(small))


def acronym(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda t: F.substring(t, 1, 1)), "")


def suspicious_name(name: Column, rows: Column) -> Column:
    """Why a name looks broken: one word with few rows, or a connective at its end; null if neither."""
    toks = F.split(name, " ")
    return F.when((F.size(toks) == 1) & (rows < 5), "one word").when(F.element_at(toks, -1).isin(*LOOSE_STOPWORDS), "cut off")


# Names of public bodies, on folded text.
PUBLIC_BODY = r"\b(municipio|prefeitura|estado d[aeo]|uniao federal|fazenda (publica|nacional|estadual|municipal)|autarquia|instituto nacional|inss|camara municipal)\b"


def is_public_body(c: Column) -> Column:
    return fold(F.coalesce(c, F.lit(""))).rlike(PUBLIC_BODY)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^<>]{0,80}>", " ")


def html_text(c: Column) -> Column:
    """The text of a page, without scripts, styles, comments and tags."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)


def snippet(c: Column, pattern: str, around: int) -> Column:
    """The first match with ``around`` characters on either side, and marks where text is cut."""
    at = F.regexp_instr(c, F.lit(pattern))
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(c), at + F.length(F.regexp_substr(c, F.lit(pattern))) - 1 + around)
    cut = F.substring(c, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(end < F.length(c), "…").otherwise("")))


def highlights(c: Column, word: str, size: int = 200, most: int = 3) -> Column:
    """Up to ``most`` fragments around the word, with the word in <em>."""
    w = re.escape(word)
    parts = F.regexp_extract_all(c, F.lit(rf"(?is)(.{{0,{size // 2}}}\b{w}\b.{{0,{size // 2}}})"), F.lit(1))
    return F.transform(F.slice(parts, 1, most), lambda p: F.regexp_replace(p, rf"(?i)\b({w})\b", "<em>$1</em>"))


def windows_around(c: Column, pattern: str, radius: int) -> Column:
    """Merged intervals (start, end; from 0, end exclusive) of ``radius`` characters around every match."""
    pieces = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out"))

    def step(acc, x):
        a0 = acc["at"] + F.length(x["p"])
        b0 = a0 + F.length(F.coalesce(x["h"], F.lit("")))
        a, b = F.greatest(F.lit(0), a0 - radius), F.least(F.length(c), b0 + radius)
        last = F.try_element_at(acc["out"], F.lit(-1))
        merged = F.when(
            x["h"].isNull(), acc["out"]
        ).when(
            F.coalesce(last["b"] >= a, F.lit(False)),
            F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b")))),
        ).otherwise(F.concat(acc["out"], F.array(F.struct(a.alias("a"), b.alias("b")))))
        return F.struct(b0.alias("at"), merged.alias("out"))

    pairs = F.arrays_zip(pieces.alias("p"), hits.alias("h"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


OAB_FORMS = (r"oab\s*[/-]?\s*([a-z]{2})\s*(?:n[o.]*\s*)?([0-9][0-9.]{2,8})", r"oab\s*(?:n[o.]*\s*)?([0-9][0-9.]{2,8})\s*[/-]?\s*([a-z]{2})\b", r"\(([a-z]{2})\s*([0-9][0-9.]{3,8})\)")


def bar_numbers(c: Column, most: int = 40) -> Column:
    """Bar registrations in a text as UFnnnn, in three notations, without repeats."""
    t = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[ºª°]", " ")
    out = []
    for i, p in enumerate(OAB_FORMS):
        a, b = F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.regexp_extract_all(t, F.lit(p), F.lit(2))
        uf, n = (b, a) if i == 1 else (a, b)
        out.append(F.zip_with(uf, n, lambda u, x: F.concat(F.upper(u), F.regexp_replace(x, "[.]", ""))))
    known = F.filter(F.concat(*out), lambda x: F.substring(x, 1, 2).isin(*UFS))
    return F.slice(F.array_distinct(known), 1, most)


def money_values(c: Column, most: int = 40) -> Column:
    """Distinct amounts above zero after R$, largest first."""
    raw = F.regexp_extract_all(c, F.lit(r"R\$\s*([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}|[0-9]+,[0-9]{2})"), F.lit(1))
    num = F.transform(raw, lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)"))
    return F.slice(F.sort_array(F.array_distinct(F.filter(num, lambda x: x > 0)), asc=False), 1, most)
