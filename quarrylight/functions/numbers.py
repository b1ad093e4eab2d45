"""Numbers in text: extraction, parsing, scales and closeness, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import blank

# ---- Fixed values: number patterns and scales -------------------------------------------------------------------
#: Groups: currency, number, scale | number, unit.
CLAIM = (
    r"([$€£¥₽₸])\s?(\d[\d\s.,]{0,16})(?:\s?(billion|million|млрд|млн|тыс|[BbMm]|k|K))?"
    r"|(\d[\d\s.,]{1,16})\s?(%|°[CF]?|ГВт|GW|МВт|MW|млрд|млн|тыс|billion|million|stars?|зв[её]зд[\p{L}\p{N}_]*)"
)
STARS = r"(\d[\d\s.,]{0,12})\s*(?:[~≈]?\s*)?(?:k|тыс)?\s*(?:github\s+)?(?:stars?|зв[её]зд[\p{L}\p{N}_]*)"
THOUSAND = r"(?:[\d.,]k\b|\bk\b|тыс)"
FIGURE = r"([$€£¥₽₸])\s?(\d[\d\s.,]{0,14})|(\d[\d\s.,]{1,14})\s?(€|EUR|USD|\$|₽|₸|zł|£|%|°[CF]?|k\b|тыс|млн)"
MENTION = r"(?:[$€£¥₽₸]\s?\d[\d\s.,]*|\d[\d\s.,]*\s?(?:€|EUR|USD|\$|₽|₸|zł|£|%|k\b|тыс|млн|млрд|usd|eur))"
PLAIN = r"(?<![\p{L}\p{N}_./])(-?\d{1,4}(?:[.,]\d{1,2})?)(?![\p{L}\p{N}_./])"
SCALES = {"b": 1e9, "млрд": 1e9, "billion": 1e9, "m": 1e6, "млн": 1e6, "million": 1e6, "k": 1e3, "тыс": 1e3}
# -----------------------------------------------------------------------------------------------------------------

_I = "(?i)(?u)"


def parse_number(raw: Column) -> Column:
    """A number written with either decimal sign; null if it isn't one.

    With both signs the later is the decimal one; a single comma with two digits at most after it is one too.
    """
    s = F.translate(F.regexp_replace(blank(raw), r"^\s+|\s+$", ""), "  ", "")
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    both = (commas > 0) & F.contains(s, F.lit("."))
    comma_last = F.locate(",", F.reverse(s)) < F.locate(".", F.reverse(s))
    one = (commas == 1) & (F.length(F.substring_index(s, ",", -1)) <= 2)
    plain = (
        F.when(both & comma_last, F.translate(F.replace(s, F.lit("."), F.lit("")), ",", "."))
        .when(~both & one, F.translate(s, ",", "."))
        .otherwise(F.replace(s, F.lit(","), F.lit("")))
    )
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def scale_of(x: Column) -> Column:
    low = F.lower(F.trim(blank(x)))
    out = F.lit(1.0)
    for unit, factor in SCALES.items():
        out = F.when(low == unit, F.lit(factor)).otherwise(out)
    return out


def _group(raw: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(raw, f"{_I}^(?:{pattern})", group)


def claim_value(raw: Column) -> Column:
    """The scaled value of a match of CLAIM."""
    money, suffix = _group(raw, CLAIM, 2), F.lower(_group(raw, CLAIM, 5))
    unit = F.when(suffix.isin("k", "тыс", "млн", "million", "млрд", "billion"), scale_of(suffix)).otherwise(F.lit(1.0))
    return F.when(money != "", parse_number(money) * scale_of(_group(raw, CLAIM, 3))).otherwise(parse_number(_group(raw, CLAIM, 4)) * unit)


def claim_kind(raw: Column) -> Column:
    s = F.lower(_group(raw, CLAIM, 5))
    return (
        F.when(F.contains(s, F.lit("star")) | F.contains(s, F.lit("зв")), F.lit("stars"))
        .when(F.contains(s, F.lit("%")), F.lit("percent"))
        .when(F.contains(s, F.lit("гвт")) | F.contains(s, F.lit("мвт")) | s.isin("gw", "mw"), F.lit("power"))
        .otherwise(F.lit("number"))
    )


def matches(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(blank(x), F.lit(f"{_I}{pattern}"), F.lit(0))


def evidence_numbers(x: Column) -> Column:
    """Array of (value, raw) of the text's claims that parse."""
    each = F.transform(matches(x, CLAIM), lambda r: F.struct(claim_value(r).alias("value"), r.alias("raw")))
    return F.filter(each, lambda e: e["value"].isNotNull())


def _bare(r: Column) -> Column:
    return F.regexp_replace(r, r"^\s+|\s+$", "")


def claims(x: Column, most: int = 24) -> Column:
    """Array of (raw, value, kind): star claims first, then the others, each wording once."""
    body = F.regexp_replace(blank(x), r"[*`_]+", " ")

    def star(r):
        n = parse_number(F.regexp_extract(r, f"{_I}{STARS}", 1))
        thousand = F.when(r.rlike(f"{_I}{THOUSAND}"), F.lit(1000.0)).otherwise(F.lit(1.0))
        return F.struct(_bare(r).alias("raw"), (n * thousand).alias("value"), F.lit("stars").alias("kind"))

    stars = F.transform(matches(body, STARS), star)
    rest = F.transform(matches(body, CLAIM), lambda r: F.struct(_bare(r).alias("raw"), claim_value(r).alias("value"), claim_kind(r).alias("kind")))
    rest = F.filter(rest, lambda c: F.length(c["raw"]) >= 2)

    def add(kept, c):
        again = F.exists(kept, lambda k: F.lower(k["raw"]) == F.lower(c["raw"]))
        return F.when((F.size(kept) >= most) | again, kept).otherwise(F.array_append(kept, c))

    return F.aggregate(F.concat(stars, rest), F.array().cast("array<struct<raw:string,value:double,kind:string>>"), add)


def page_numbers(x: Column, most: int = 24) -> Column:
    """The first plain numbers of the first 8000 characters."""
    found = F.regexp_extract_all(F.substring(blank(x), 1, 8000), F.lit(PLAIN), F.lit(1))
    values = F.transform(found, lambda r: F.translate(r, ",", ".").try_cast("double"))
    return F.slice(F.filter(values, lambda v: v.isNotNull() & (F.abs(v) <= 1e7)), 1, most)


def numbers_close(a: Column, b: Column) -> Column:
    diff = F.abs(a - b)
    return (diff <= 1.0) | (diff / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= 0.08)


def approx_equal(a: Column, b: Column, rel: float = 0.08, tolerance: Column | float = 0.5) -> Column:
    diff = F.abs(a - b)
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return (diff <= tolerance) | (diff / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= rel)


def mention_count(x: Column) -> Column:
    return F.size(matches(x, MENTION))
