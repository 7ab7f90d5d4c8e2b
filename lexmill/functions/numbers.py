"""Numbers, booleans, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_bool(c: Column) -> Column:
    """True, but for the usual words for no; null counts as true."""
    return F.coalesce(~F.lower(F.trim(c)).isin("false", "0", "no", "nao", "não", "f", "n", ""), F.lit(True))


def parse_brl(c: Column) -> Column:
    """'R$ 1.234,56' -> 1234.56, else null."""
    n = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.-]", "")
    return F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def format_brl(c: Column) -> Column:
    en = F.format_number(c.cast("decimal(18,2)"), 2)
    return F.concat(F.lit("R$ "), F.translate(en, ",.", ".,"))


def log_ratio(c: Column, base: float) -> Column:
    """log(1 + c) in units of log(base)."""
    return F.log1p(c) / F.log(F.lit(float(base)))


def z_score(c: Column, mean: float, sd: float) -> Column:
    return (c - mean) / sd


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def compound(rates: Column) -> Column:
    """The product of (1 + rate / 100)."""
    return F.aggregate(rates, F.lit(1.0), lambda acc, r: acc * (1 + r / 100))


def present_value(face: Column, years: Column, discount: float, inflation: float) -> Column:
    """Face value grown by inflation and discounted, both a year."""
    return face * F.pow(F.lit((1 + inflation) / (1 + discount)), years)


def opportunity(pillars: Column) -> Column:
    """Weighted mean of the pillars that have a value, weights renormalised; null if none has."""
    known = F.filter(pillars, lambda p: p["value"].isNotNull())
    w = F.aggregate(known, F.lit(0.0), lambda a, p: a + p["weight"])
    s = F.aggregate(known, F.lit(0.0), lambda a, p: a + p["weight"] * p["value"])
    return F.when(w > 0, s / w)


def first_of(c: Column, key: str, depth: int = 5) -> Column:
    """A field of a JSON object, or of the first object inside lists up to ``depth`` deep."""
    return F.coalesce(*[F.get_json_object(c, "$" + "[0]" * d + f".{key}") for d in range(depth + 1)])


def key_drift(c: Column, expected: list[str], optional: list[str]) -> tuple[Column, Column]:
    """(keys that are not known, expected keys that are absent) of a JSON object."""
    keys = F.coalesce(F.json_object_keys(c), F.expr("cast(array() as array<string>)"))
    known = F.array(*map(F.lit, [*expected, *optional]))
    return F.array_except(keys, known), F.array_except(F.array(*map(F.lit, expected)), keys)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
