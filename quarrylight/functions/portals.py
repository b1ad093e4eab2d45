"""Deep links into listing portals from a question's city and day, by a rule table that callers extend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java
from .urls import blank

# ---- Fixed values: city patterns and their names in addresses ----------------------------------------------------
CITIES = {
    r"\bалмат[аы]\b": "almaty",
    r"\bастана\b|\bнур[- ]султан\b|\bnur[- ]sultan\b": "astana",
    r"\bшымкент\b": "shymkent",
    r"\bкараганда\b": "karaganda",
    r"\bактобе\b": "aktobe",
    r"\bпавлодар\b": "pavlodar",
    r"\bтараз\b": "taraz",
    r"\bатырау\b": "atyrau",
    r"\bкостанай\b": "kostanay",
    r"\bуст[- ]каменогорск\b|\bоскемен\b": "ust-kamenogorsk",
    r"\bактау\b": "aktau",
    r"\bуральск\b": "uralsk",
    r"\bпетропавловск\b": "petropavlovsk",
    r"\bкокшетау\b": "kokshetau",
    r"\bтуркестан\b": "turkestan",
    r"\bсемей\b": "semey",
}
# ------------------------------------------------------------------------------------------------------------------


def city(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, slug in reversed(CITIES.items()):
        out = F.when(blank(x).rlike(java(pattern)), F.lit(slug)).otherwise(out)
    return out


def day_kind(x: Column) -> Column:
    low = F.lower(blank(x))
    has = lambda w: F.contains(low, F.lit(w))
    return F.when(has("послезавтра"), F.lit("day_after")).when(has("завтра"), F.lit("tomorrow")).when(has("сегодня"), F.lit("today")).otherwise(F.lit("unspecified"))


def target_date(kind: Column, as_of: str) -> Column:
    """The day meant, as a date; an unspecified one is tomorrow."""
    days = F.when(kind == "today", 0).when(kind == "day_after", 2).otherwise(1)
    return F.date_format(F.date_add(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")


def biased_query(message: Column, q: Column, portal: str) -> Column:
    """The query with the portal's site mark where the message names a city and a listing; once."""
    text = F.trim(blank(q))
    wanted = city(message).isNotNull() & ~F.contains(F.lower(text), F.lit(portal))
    return F.when(wanted, F.trim(F.concat(text, F.lit(f" site:{portal}")))).otherwise(q)


def deep_link(x: Column, portal: str, section: str, as_of: str) -> Column:
    """portal/city/section?date_from=day, or the portal's front page where no city is named; no day named is today."""
    kind = F.when(day_kind(x) == "unspecified", F.lit("today")).otherwise(day_kind(x))
    at = F.concat(F.lit(f"https://{portal}/"), city(x), F.lit(f"/{section}?date_from="), target_date(kind, as_of))
    return F.coalesce(at, F.lit(f"https://{portal}/"))
