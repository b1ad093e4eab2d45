"""Row-set operators over search hits: keep-first deduplication, filters with fallback, scores and ranks.

Hits carry (query_id, pos, title, url, snippet, date, source, relevance, enriched_text). Every order ends in pos, every
shuffle is by query_id, and bounded ranks let Spark cut groups before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import urls as U
from ..functions.text import NOISE_PHRASES
from ..functions.urls import blank, contains_any

STRUCTURED_SOURCE = "github_api"
STRUCTURED_MARK = "[STRUCTURED:github_api]"


def keep_first(rows: DataFrame, key: Column, order: list, by: tuple[str, ...] = ("query_id",), blank_is_key: bool = True) -> DataFrame:
    """The first row of each key within `by`; rows with a blank key all stay if blank is no key."""
    rank = F.row_number().over(Window.partitionBy(*by, "__key").orderBy(*order))
    keyed = rows.withColumn("__key", key)
    if blank_is_key:
        return keyed.withColumn("__n", rank).where("__n = 1").drop("__key", "__n")
    first = keyed.where("__key != ''").withColumn("__n", rank).where("__n = 1").drop("__key", "__n")
    return first.unionByName(keyed.where("__key = ''").drop("__key"))


def merge_key() -> Column:
    """Trimmed lower-case URL, or the snippet's start and the source."""
    url = F.lower(F.trim(blank(F.col("url"))))
    return F.when(url != "", url).otherwise(F.lower(F.concat(F.substring(blank(F.col("snippet")), 1, 72), F.lit("|"), F.col("source"))))


def merge_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two row sets, first before second, without repeated keys."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    return keep_first(both, merge_key(), ["side", "pos"])


def merge_agents(rows: DataFrame) -> DataFrame:
    """Agents' rows (.., agent, role) in agent order; URLs once, rows without a URL all stay; snippets name the role."""
    url = F.trim(blank(F.col("url")))
    key = F.lower(F.regexp_replace(F.substring_index(url, "#", 1), r"/+$", ""))
    tag = F.concat(F.lit("[agent:"), F.col("role"), F.lit("] "))
    snippet = blank(F.col("snippet"))
    marked = rows.withColumn("snippet", F.when(F.contains(F.substring(snippet, 1, 48), tag), snippet).otherwise(F.concat(tag, snippet)))
    return keep_first(marked, key, ["agent", "pos"], blank_is_key=False)


def first_of_domain(rows: DataFrame, blank_is_key: bool) -> DataFrame:
    return keep_first(rows, U.domain(F.col("url")), ["pos"], blank_is_key=blank_is_key)


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Fact rows before the others, each repository page once."""
    both = facts.withColumn("side", F.lit(0)).unionByName(rows.withColumn("side", F.lit(1)))
    return keep_first(both, U.repo_key(F.col("url")), ["side", "pos"], blank_is_key=False)


def ensure_urls(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows plus one for each wanted https URL (query_id, ord, url) that is missing; later ones come first."""
    key = U.url_key(F.col("url"))
    asked = wanted.where(F.startswith(F.trim("url"), F.lit("https://"))).withColumn("url", F.trim("url")).withColumn("key", key)
    once = asked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("ord"))).where("n = 1")
    missing = once.join(rows.select("query_id", key.alias("key")).distinct(), ["query_id", "key"], "left_anti")
    none = F.lit(None).cast("string")
    new = missing.select(
        "query_id",
        (-F.col("ord") - 1).cast("long").alias("pos"),
        F.col("url").alias("title"),
        "url",
        F.lit("(selected for deep enrich)").alias("snippet"),
        none.alias("date"),
        F.lit("enrich_allowlist").alias("source"),
        F.lit(1.1).alias("relevance"),
        none.alias("enriched_text"),
    )
    return rows.unionByName(new)


def new_urls(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct URLs of `after` that `before` lacks, counted by query."""
    fresh = after.where("url is not null and url != ''").select("query_id", "url").distinct().join(before.select("query_id", "url"), ["query_id", "url"], "left_anti")
    return fresh.groupBy("query_id").agg(F.count("*").alias("new_urls"))


def demote_stale(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Rank of each row: for questions about now, live rows, then others, then stale ones; else the order as it is."""
    m = F.col("message")
    now = messages.select("query_id", I.is_current_fact(m).alias("current"), I._has(m, I.WEATHER).alias("weather"), I._has(m, I.FX).alias("fx"))
    text = F.concat_ws(" ", blank(F.col("title")), blank(F.col("url")), blank(F.col("snippet")))
    stale = (F.col("weather") & I._has(text, I.STALE_WEATHER)) | (F.col("fx") & I._has(text, I.STALE_FX))
    bucket = F.when(~F.col("current"), 0).when(stale, 2).when(I._has(text, I.LIVE), 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy("bucket", "pos")
    ranked = rows.join(now, "query_id").withColumn("bucket", bucket)
    return ranked.withColumn("rank", F.row_number().over(order)).select("query_id", "pos", "rank")


def score(query: Column, kind: Column) -> Column:
    """Relevance, query words, figures, dates, noise, URL shape and structured facts; 0 at least."""
    c = F.col
    body = F.when(blank(c("enriched_text")) != "", c("enriched_text")).otherwise(blank(c("snippet")))
    low = F.lower(body)
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    total = (
        c("relevance")
        + F.least(hits * 0.1, F.lit(0.4))
        + F.when(body.rlike(r"\d[\d\.,]+"), 0.15).otherwise(0.0)
        + F.when(blank(c("date")) != "", 0.1).otherwise(0.0)
        - F.when(contains_any(low, NOISE_PHRASES), 0.3).otherwise(0.0)
        + F.when(F.trim(blank(c("url"))) != "", U.quality_adjustment(F.trim(c("url")), kind)).otherwise(0.0)
        + F.when((c("source") == STRUCTURED_SOURCE) | F.startswith(blank(c("enriched_text")), F.lit(STRUCTURED_MARK)), 1.5).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.round(total, 6))


def rerank(rows: DataFrame, messages: DataFrame, keep: int, with_media: bool = False) -> DataFrame:
    """The best `keep` rows of each query with score and rank; ties keep their order."""
    asked = messages.select("query_id", F.col("message").alias("query"), (I.media_intent(F.col("message")) if with_media else F.lit(None).cast("string")).alias("kind"))
    scored = rows.join(asked, "query_id").withColumn("score", score(F.col("query"), F.col("kind"))).drop("query", "kind")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def place_relevant(rows: DataFrame, messages: DataFrame, min_keep: int = 4) -> DataFrame:
    """Rows that name the asked place and a noun, best first; without any, the best few; all where nothing is asked."""
    asked = messages.select("query_id", F.slice(I.place_tokens(F.col("message")), 1, 4).alias("places"), F.slice(I.content_nouns(F.col("message")), 1, 8).alias("nouns"))
    c = F.col
    front = F.lower(F.concat_ws("\n", blank(c("title")), blank(c("url")), blank(c("snippet"))))
    rows = rows.join(asked, "query_id").withColumn("front", front)
    rows = rows.withColumn("full", F.concat(c("front"), F.lit("\n"), F.lower(F.substring(blank(c("enriched_text")), 1, 4000))))
    in_front = (F.size("places") == 0) | F.exists("places", lambda p: F.contains(c("front"), F.lower(p)))
    n_hits = F.when(F.size("nouns") == 0, 1).otherwise(F.size(F.filter("nouns", lambda n: F.contains(c("full"), n))))
    rows = rows.withColumn("n_hits", n_hits).withColumn("p_hit", F.when(in_front & (F.col("n_hits") > 0), 1).otherwise(0))
    matched = (c("p_hit") == 1) & (c("n_hits") >= 1)
    by = Window.partitionBy("query_id")
    ranked = rows.withColumn("matched", F.sum(matched.cast("int")).over(by))
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy(F.desc("p_hit"), F.desc("n_hits"), F.desc("relevance"), "pos")))
    idle = (F.size("places") == 0) & (F.size("nouns") == 0)
    kept = ranked.where(idle | F.when(c("matched") > 0, matched).otherwise(c("rank") <= max(min_keep, 8)))
    return kept.select("query_id", "pos", F.when(idle, c("pos") + 1).otherwise(c("rank")).cast("long").alias("rank"))


def relevance_floor(ranked: DataFrame, floor: float = 0.06, fallback: int = 14) -> DataFrame:
    """Rows at the floor or above by score capped at 1; where none is, the first ones."""
    good = F.least("score", F.lit(1.0)) >= floor
    any_good = F.max(good.cast("int")).over(Window.partitionBy("query_id"))
    return ranked.withColumn("any", any_good).where(F.when(F.col("any") == 1, good).otherwise(F.col("rank") <= fallback)).drop("any")


def ordered_distinct(ranked: DataFrame, value: Column, keep: int, name: str) -> DataFrame:
    """Distinct values of each query in rank order, the first `keep`, joined by ' | '."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda s: s["v"])
    return ranked.where(value.isNotNull() & (value != "")).groupBy("query_id").agg(F.array_join(F.slice(F.array_distinct(in_order), 1, keep), " | ").alias(name))


def eligible_pages(rows: DataFrame) -> DataFrame:
    """Rows worth a fetch: not enriched, https, not blocked for browsing, allowed by the URL policy."""
    url = F.trim(blank(F.col("url")))
    none = F.lit(None).cast("string")
    ok = (F.trim(blank(F.col("enriched_text"))) == "") & F.startswith(url, F.lit("https://")) & ~U.blocked_for_browse(url, none) & (U.policy_reason(url) == "")
    return rows.where(ok)


def research_picks(rows: DataFrame, most: int = 5) -> DataFrame:
    """URLs to read even for a draft: the best primary source first, then the best of the rest."""
    url = F.trim(blank(F.col("url")))
    none = F.lit(None).cast("string")
    ok = rows.where(F.startswith(url, F.lit("https://")) & ~U.blocked_for_browse(url, none)).withColumn("u", url)
    ok = ok.withColumn("prim", U.is_primary_source(F.col("u")).cast("int")).withColumn("adj", U.quality_adjustment(F.col("u"), none))
    order = Window.partitionBy("query_id").orderBy(F.desc("prim"), F.desc("adj"), F.desc("relevance"), "pos")
    ok = ok.withColumn("n", F.row_number().over(order))
    lead = (F.col("n") == 1) & (F.col("prim") == 1)
    picked = keep_first(ok.where(lead | (F.col("adj") >= -0.5)), F.col("u"), ["n"])
    ranked = picked.withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy("n")))
    return ranked.where(F.col("pick") <= most).select("query_id", F.col("pick").cast("long").alias("pick"), F.col("u").alias("url"))


def entry_urls(rows: DataFrame, kind: Column) -> DataFrame:
    """Addresses for a browser, best first, each page once whatever its query string."""
    url = F.trim(blank(F.col("url")))
    ok = rows.where(U.is_http(url) & ~U.blocked_for_browse(url, kind) & (U.policy_reason(url) == "")).withColumn("u", url)
    ok = ok.withColumn("priority", U.entry_priority(F.col("u"), F.col("relevance"), kind))
    once = keep_first(ok, U.browse_key(F.col("u")), [F.desc("priority"), "pos"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("priority"), "pos"))
    return once.withColumn("rank", rank.cast("long")).select("query_id", "rank", F.col("u").alias("url"), "priority")
