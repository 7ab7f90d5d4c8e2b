"""Identifiers: case numbers, taxpayer and company numbers, bar registrations, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment digits with one court, and state codes of the courts' numbering (alphabetical order of names).
SINGLE_COURTS = {"1": "STF", "2": "CNJ", "3": "STJ", "7": "STM"}
STATE_BY_CODE = {"01": "AC", "02": "AL", "03": "AP", "04": "AM", "05": "BA", "06": "CE", "07": "DF", "08": "ES", "09": "GO", "10": "MA", "11": "MT", "12": "MS", "13": "MG", "14": "PA", "15": "PB", "16": "PR", "17": "PE", "18": "PI", "19": "RJ", "20": "RN", "21": "RS", "22": "RO", "23": "RR", "24": "SC", "25": "SE", "26": "SP", "27": "TO"}
FEDERAL_STATE = {"TRF1": "DF", "TRF2": "RJ", "TRF3": "SP", "TRF4": "RS", "TRF5": "PE", "TRF6": "MG"}

MASKED = r"(\d{7})-(\d{2})\.(\d{4})\.(\d)\.(\d{2})\.(\d{4})"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def case_year(c: Column) -> Column:
    """The year in a masked case number, else null."""
    return F.nullif(F.regexp_extract(c, r"^\d{7}-\d{2}\.(\d{4})\.", 1), F.lit("")).try_cast("int")


def case_parts(c: Column) -> Column:
    """sequence, check, year, segment, court, origin of a number of 20 digits, else null."""
    d = digits(c)
    cut = {"sequence": (1, 7), "check": (8, 2), "year": (10, 4), "segment": (14, 1), "court": (15, 2), "origin": (17, 4)}
    return F.when(F.length(d) == 20, F.struct(*[F.substring(d, a, n).alias(k) for k, (a, n) in cut.items()]))


def case_mask(c: Column) -> Column:
    """The masked form of a number of 20 digits, else null."""
    p = case_parts(c)
    return F.when(p.isNotNull(), F.concat(p["sequence"], F.lit("-"), p["check"], F.lit("."), p["year"], F.lit("."), p["segment"], F.lit("."), p["court"], F.lit("."), p["origin"]))


def case_check(c: Column) -> Column:
    """Whether the two check digits hold (modulus 97); false for what is no number of 20 digits."""
    p = case_parts(c)
    base = F.concat(p["sequence"], p["year"], p["segment"], p["court"], p["origin"], F.lit("00")).cast("decimal(38,0)")
    return F.coalesce(base % 97 == 98 - p["check"].cast("int"), F.lit(False))


def case_in_text(*cs: Column) -> Column:
    """The first masked number, or bare run of 20 digits, in any of the columns, masked."""
    found = [F.coalesce(F.nullif(F.regexp_extract(c, MASKED, 0), F.lit("")), case_mask(F.nullif(F.regexp_extract(c, r"(?<!\d)\d{20}(?!\d)", 0), F.lit("")))) for c in cs]
    return F.coalesce(*found)


def cases_in_text(c: Column) -> Column:
    """All masked numbers whose check digits hold, blanks inside allowed, none glued to other digits; distinct, in order."""
    loose = r"(?<!\d)(\d{7}\s*-\s*\d{2}\s*\.\s*\d{4}\s*\.\s*\d\s*\.\s*\d{2}\s*\.\s*\d{4})(?!\d)"
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(loose), F.lit(1)), lambda x: F.regexp_replace(x, r"\s", "")), case_check))


def case_court(c: Column) -> Column:
    """The court a number belongs to, or null where the segment or code is unknown."""
    p = case_parts(c)
    seg, n, uf = p["segment"], p["court"].try_cast("int"), F.try_element_at(_map(STATE_BY_CODE), p["court"])
    number = n.cast("string")
    return (
        F.when((seg == "4") & n.between(1, 6), F.concat(F.lit("TRF"), number))
        .when((seg == "5") & n.between(1, 24), F.concat(F.lit("TRT"), number))
        .when(seg == "6", F.concat(F.lit("TRE"), uf))
        .when(seg.isin("8", "9") & (uf == "DF"), F.lit("TJDFT"))
        .when(seg.isin("8", "9"), F.concat(F.lit("TJ"), uf))
        .when(seg.isin(*SINGLE_COURTS), F.try_element_at(_map(SINGLE_COURTS), seg))
    )


def describe_case(c: Column) -> Column:
    p, ok = case_parts(c), case_check(c)
    return F.struct(ok.alias("valid"), F.when(p.isNull(), "digits").when(~ok, "check").alias("reason"), F.length(digits(c)).alias("digits"), case_court(c).alias("court"), p["year"].alias("year"), case_mask(c).alias("masked"))


def court_state(court: Column) -> Column:
    """The state of a court by its name, federal ones by their seat."""
    tail = F.regexp_extract(court, "^(?:TJ|TRE)([A-Z]{2})", 1)
    return F.coalesce(F.try_element_at(_map(FEDERAL_STATE), court), F.nullif(tail, F.lit("")))


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).try_cast("int")


def _check_digit(c: Column, weights: list[int]) -> Column:
    s = F.lit(0)
    for i, w in enumerate(weights, 1):
        s = s + _digit(c, i) * w
    r = s % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def cpf_check(c: Column) -> Column:
    """Both check digits of a taxpayer number; one digit repeated is no number."""
    ok = (_check_digit(c, list(range(10, 1, -1))) == _digit(c, 10)) & (_check_digit(c, list(range(11, 1, -1))) == _digit(c, 11))
    return F.coalesce(c.rlike(r"^\d{11}$") & ~c.rlike(r"^(\d)\1{10}$") & ok, F.lit(False))


def cnpj_check(c: Column) -> Column:
    """Both check digits of a company number."""
    w = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    ok = (_check_digit(c, w) == _digit(c, 13)) & (_check_digit(c, [6, *w]) == _digit(c, 14))
    return F.coalesce(c.rlike(r"^\d{14}$") & ~c.rlike(r"^(\d)\1{13}$") & ok, F.lit(False))


def mask_cpf(d: Column) -> Column:
    return F.concat(F.substring(d, 1, 3), F.lit("."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-"), F.substring(d, 10, 2))


def mask_cnpj(d: Column) -> Column:
    return F.concat(F.substring(d, 1, 2), F.lit("."), F.substring(d, 3, 3), F.lit("."), F.substring(d, 6, 3), F.lit("/"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 2))


def document(c: Column) -> Column:
    """kind (cpf, cnpj, cnpj root or null), digits, masked form, root and whether the check digits hold."""
    d = digits(c)
    kind = F.when(F.length(d) == 11, "cpf").when(F.length(d) == 14, "cnpj").when(F.length(d) == 8, "root")
    masked = F.when(kind == "cpf", mask_cpf(d)).when(kind == "cnpj", mask_cnpj(d)).when(kind == "root", F.substring(mask_cnpj(F.rpad(d, 14, "0")), 1, 10))
    return F.struct(kind.alias("kind"), d.alias("digits"), masked.alias("masked"), F.when(kind.isin("cnpj", "root"), F.substring(d, 1, 8)).alias("root"), F.when(kind == "cpf", cpf_check(d)).when(kind == "cnpj", cnpj_check(d)).alias("valid"))


def bar_number(c: Column) -> Column:
    """UFnnnn from any notation; leading zeros stay; null without a digit."""
    s = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]", ""))
    turned = F.regexp_replace(s, "^([0-9]+[A-Z]?)([A-Z]{2})$", "$2$1")
    return F.when(s.rlike("[0-9]"), turned)


def is_masked(c: Column) -> Column:
    return F.coalesce(c.rlike("[Xx*]"), F.lit(False))


def masks_agree(a: Column, b: Column) -> Column:
    """Whether two numbers of equal length agree in every digit that neither hides."""
    hidden = lambda x: x.rlike("[Xx*]")
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: hidden(x) | hidden(y) | (x == y))
    return (F.length(a) == F.length(b)) & F.forall(pairs, lambda x: x)


def cnpj_root(c: Column) -> Column:
    """The first eight digits of a full, unmasked company number, else null."""
    d = digits(c)
    return F.when(~is_masked(c) & (F.length(d) == 14) & ~d.rlike("^0{8}"), F.substring(d, 1, 8))


def is_cpf(c: Column, kind: Column) -> Column:
    return F.coalesce(F.lower(kind) == "cpf", F.lit(False)) | (F.length(digits(c)) == 11)


def external_id(source: str, *parts: Column) -> Column:
    """source:part:part, or an error beyond 64 characters; never cut."""
    x = F.concat_ws(":", F.lit(source), *[p.cast("string") for p in parts])
    return F.when(F.length(x) <= 64, x).otherwise(F.raise_error(F.concat(F.lit("id too long: "), x)))


def movement_id(case: Column, at: Column, code: Column) -> Column:
    return F.concat(F.lit("mov:"), F.substring(F.sha1(F.concat_ws("|", case.cast("string"), at.cast("string"), code.cast("string")).cast("binary")), 1, 24))


def act_fingerprint(case: Column, day: Column, text: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.sha1(F.concat_ws("|", case.cast("string"), day.cast("string"), F.substring(t, 1, 4000)).cast("binary"))


def key_set_hash(keys: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array_sort(keys)), 256), 1, 32)


def hash_fraction(c: Column, salt: str = "") -> Column:
    """A number in [0, 1] from the first 32 bits of a digest."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt), c.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def debtor_kind(name: Column) -> Column:
    """federal, municipal, state or other, from a debtor's name."""
    from lexmill.functions.text import fold

    t = fold(F.coalesce(name, F.lit("")))
    return F.when(t.rlike(r"\b(uniao|inss|federal|nacional)\b"), "federal").when(t.rlike(r"\b(municipio|prefeitura|municipal)\b"), "municipal").when(t.rlike(r"\b(estado|estadual)\b"), "state").otherwise("other")


def box_kind(c: Column) -> Column:
    """What a free search box holds, by its format."""
    d, s = digits(c), F.trim(c)
    return F.when(F.length(d) == 20, "case").when(F.length(d) == 11, "cpf").when(F.length(d) == 14, "cnpj").when((F.length(d) == 8) & s.rlike(r"^[\d./-]+$"), "root").when(F.upper(s).rlike(r"^([A-Z]{2}\s*\d{3,7}|\d{3,7}\s*/?\s*[A-Z]{2})$"), "bar").otherwise("name")
