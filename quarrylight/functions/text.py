"""Text and HTML functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import java
from .urls import blank, contains_any

# ---- Fixed values: phrases, patterns, limits -------------------------------------------------------------------
SPAM_FRAGMENTS = ("click here", "subscribe now", "buy now", "casino", "cialis", "viagra", "выигра", "заработай", "перейди по ссылке")
BLOCK_PHRASES = ("access denied", "403 forbidden", "cloudflare to continue", "please verify you are a human", "enable javascript", "browser doesn't support javascript")
NOISE_PHRASES = (
    "cookie",
    "cookies",
    "privacy policy",
    "terms of service",
    "subscribe",
    "подписаться",
    "реклама",
    "advertisement",
    "войти",
    "login",
    "sign in",
    "register",
    "зарегистрироваться",
    "©",
    "all rights reserved",
)
FOOTER_PHRASES = (
    "may make mistakes",
    "might make mistakes",
    "can make mistakes",
    "может ошибаться",
    "қателесуі",
    "peut commettre",
    "kann fehler",
    "puede cometer",
    "cookie preferences",
)
WEAK_SIGNALS = (
    "404",
    "not found",
    "403",
    "forbidden",
    "access denied",
    "captcha",
    "cloudflare",
    "no results",
    "step budget exhausted",
    "url_loop_break",
    "auto-stop",
    "no_tables_found",
    "insufficient",
    "could not",
    "failed to",
)
GAP_MARK = "\n … ─── [page middle omitted: head and tail of the document kept] ─── … \n"
DATE_PATTERNS = (
    r"\b(\d{1,2}\s+(?:янв|фев|мар|апр|мая|июн|июл|авг|сен|окт|ноя|дек)\w*\s+\d{4})\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{1,2}\.\d{2}\.\d{4})\b",
    r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4})\b",
)
SECTION_LABELS = {
    "currency": ("💱 Курсы валют:", "💱 Exchange rates:"),
    "price": ("Цены/котировки:", "Prices / quotes:"),
    "rate": ("🏦 Процентные ставки:", "🏦 Interest rates:"),
    "news": ("📰 Актуальные события:", "📰 Latest:"),
    "general": ("🔍 Актуальная информация:", "🔍 Current information:"),
}
GLUE_WORDS = ("that", "this", "with", "from", "который", "которая", "которые", "данные", "market", "github")
TOKEN = "[A-Za-zА-Яа-яЁёӘәІіҢңҒғҮүҰұҚқӨөҺһ0-9]{3,}"
# ----------------------------------------------------------------------------------------------------------------


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_to_text(html: Column) -> Column:
    """Scripts, styles and noscript blocks gone, tags to spaces, white space collapsed; entities stay."""
    out = blank(html)
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return collapse(F.regexp_replace(out, "<[^>]+>", " "))


def head_and_tail(x: Column, limit: int) -> Column:
    """x unchanged up to the limit, else its head and tail round a mark; only the head below 400 characters of budget."""
    budget = limit - len(GAP_MARK)
    if budget < 400:
        return F.substring(x, 1, limit)
    head = budget // 2
    cut = F.concat(F.substring(x, 1, head), F.lit(GAP_MARK), F.right(x, F.lit(budget - head)))
    return F.when(F.length(x) <= limit, x).otherwise(cut)


def clean_blob(x: Column, title: bool = False) -> Column:
    """Inline URLs cut to 120 characters, white space collapsed, empty if spam, then cut to 240 or 8000 characters."""
    s = F.regexp_replace(F.trim(blank(x)), r"(http://\S{0,113}|https://\S{0,112})\S*", "$1")
    s = collapse(s)
    return F.when(contains_any(F.lower(s), SPAM_FRAGMENTS), F.lit("")).otherwise(F.substring(s, 1, 240 if title else 8000))


def is_block_page(x: Column) -> Column:
    return contains_any(F.lower(x), BLOCK_PHRASES) & (F.length(x) < 2000)


def is_markdown_chrome(x: Column) -> Column:
    """Blank, rules and separators only, or without a letter or digit."""
    s = F.trim(blank(x))
    return (s == "") | s.rlike(r"^[\s\-|:=]+$") | ~s.rlike("[A-Za-zА-Яа-яЁёӘәІіҢңҒғҮүҰұҚқӨөҺһ0-9]")


def has_token_loop(x: Column) -> Column:
    """The same token of 4 to 40 characters eight times in a row."""
    return (F.length(F.trim(blank(x))) >= 80) & F.trim(blank(x)).rlike(r"(?iU)(?<!\S)(\S{4,40}+)(?!\S)(?:\s+\1(?!\S)){7,}")


def has_fragment_loop(x: Column) -> Column:
    """The same 12 to 80 characters four times in a row, something other than table rules."""
    s = F.trim(blank(x))
    found = F.regexp_extract(s, r"(?isU)(.{12,80}?)\s*\1\s*\1\s*\1", 1)
    return (F.length(s) >= 80) & (found != "") & ~is_markdown_chrome(found)


def has_phrase_loop(x: Column) -> Column:
    return has_token_loop(x) | has_fragment_loop(x)


def ellipsis_collapse(x: Column) -> Column:
    s = F.rtrim(blank(x))
    tail = F.right(s, F.lit(400))
    return (F.length(s) >= 200) & (tail.rlike(r"(?:\.{3,}|……){2,}") | tail.rlike(r"(?U)(\b\w{4,}\b[\s.,]*){0,3}\.{6,}\s*$"))


def date_in(x: Column) -> Column:
    """The first pattern's first match; null without any."""
    return F.coalesce(*[F.nullif(F.regexp_extract(blank(x), java(p), 1), F.lit("")) for p in DATE_PATTERNS])


def has_cyrillic(x: Column) -> Column:
    return blank(x).rlike(r"[\x{0400}-\x{04FF}]")


def section_label(kind: str, query: Column, icon: str = "") -> Column:
    ru, en = SECTION_LABELS[kind]
    label = F.when(has_cyrillic(query), F.lit(ru)).otherwise(F.lit(en))
    return F.concat(F.lit(f"{icon} "), label) if icon else label


def display_snippet(enriched: Column, snippet: Column, limit: int, cap: int = 500_000) -> Column:
    own, short = F.trim(blank(enriched)), F.trim(blank(snippet))
    n = F.greatest(F.lit(limit), F.least(F.lit(cap), F.length(own)))
    return F.when(own != "", F.substr(own, F.lit(1), n)).otherwise(F.substring(short, 1, limit))


def citation_suffix(url: Column) -> Column:
    u = F.trim(blank(url))
    return F.when(u.rlike("^https?://"), F.concat(F.lit("\n    URL: "), u)).otherwise(F.lit(""))


def footer_only(x: Column) -> Column:
    return (F.length(F.trim(blank(x))) < 320) & contains_any(F.lower(blank(x)), FOOTER_PHRASES)


def result_insufficient(ok: Column, summary: Column, n_facts: Column, min_chars: int = 120) -> Column:
    s = F.trim(blank(summary))
    weak = contains_any(F.substring(F.lower(s), 1, 800), WEAK_SIGNALS) & (F.length(s) < 600)
    return F.when(~ok, F.lit(True)).when((n_facts > 0) & (F.length(s) >= 40), F.lit(False)).otherwise((F.length(s) < min_chars) | footer_only(s) | weak)
