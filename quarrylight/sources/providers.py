"""Providers' JSON answers as hits: one row a query in, one row a hit out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, date_in
from ..functions.urls import blank, domain


@dataclass(frozen=True)
class Provider:
    """Where a provider keeps its results, and which rules its rows follow."""

    name: str
    schema: str
    items: str
    url: str
    title: str
    snippets: tuple[str, ...]
    date: str | None = None
    score: str | None = None
    min_chars: int = 20
    blank_domain_counts: bool = False
    by_accepted: bool = False
    step: float = 0.08


_ITEM = "array<struct<{}>>"
SERPER = Provider("serper", f"organic {_ITEM.format('link string, title string, snippet string, date string')}", "organic", "link", "title", ("snippet",), "date")
BRAVE = Provider("brave", f"web struct<results:{_ITEM.format('url:string,title:string,description:string')}>", "web.results", "url", "title", ("description",))
BING = Provider("bing_web", f"webPages struct<value:{_ITEM.format('url:string,name:string,snippet:string,datePublished:string')}>", "webPages.value", "url", "name", ("snippet",), "datePublished", None, 0, False, True, 0.1)
TAVILY = Provider("tavily", f"results {_ITEM.format('url string, title string, content string, snippet string, score double')}", "results", "url", "title", ("content", "snippet", "title"), None, "score", 20, True)
CSE = Provider("google_cse", f"items {_ITEM.format('link string, title string, snippet string')}", "items", "link", "title", ("snippet",), None, None, 0, True, True, 0.1)


def _text(x: Column) -> Column:
    return F.trim(blank(x))


def parse(responses: DataFrame, provider: Provider, most: int = 10) -> DataFrame:
    """responses (query_id, body) -> (query_id, pos, title, url, snippet, date, source, relevance).

    Bodies that aren't the provider's JSON give no rows. The first hit of a domain stays; relevance falls with the
    place in the answer or among the accepted ones, or is the provider's own score between 0 and 1.
    """
    p = provider
    body = responses.select("query_id", F.from_json("body", p.schema, {"mode": "PERMISSIVE"}).alias("b"))
    each = body.select("query_id", F.posexplode(f"b.{p.items}").alias("i", "r"))
    snippet = F.coalesce(*[F.nullif(_text(F.col(f"r.{s}")), F.lit("")) for s in p.snippets], F.lit(""))
    url = _text(F.col(f"r.{p.url}"))
    rows = each.select("query_id", "i", url.alias("url"), _text(F.col(f"r.{p.title}")).alias("title"), snippet.alias("s"), (F.col(f"r.{p.date}") if p.date else F.lit(None).cast("string")).alias("date"), (F.col(f"r.{p.score}") if p.score else F.lit(None).cast("double")).alias("own"), domain(url).alias("d"))
    rows = rows.where(F.length("s") >= p.min_chars)
    if not p.blank_domain_counts and p.by_accepted:
        rows = rows.where("d != '' or url != ''")
    key = F.col("d") if p.blank_domain_counts else F.when(F.col("d") != "", F.col("d")).otherwise(F.concat(F.lit(" "), F.col("i").cast("string")))
    rows = rows.withColumn("k", key)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "k").orderBy("i"))).where("n = 1")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("i")) - 1).where(F.col("pos") < most)
    place = F.col("pos") if p.by_accepted else F.col("i")
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("own", 1.0 - place * p.step)))
    clean = collapse(F.col("s"))
    date = F.nullif("date", F.lit("")) if p.date else (date_in(F.col("s")) if p.name == "google_cse" else F.lit(None).cast("string"))
    shown = F.when(F.col("title") != "", F.col("title")).when(F.col("d") != "", F.col("d")).otherwise(F.lit("result"))
    source = F.col("d") if p.by_accepted else F.when(F.col("d") != "", F.col("d")).otherwise(F.lit(p.name))
    return rows.select("query_id", F.col("pos").cast("long").alias("pos"), (F.col("title") if p.name == "google_cse" else shown).alias("title"), "url", (clean if p.by_accepted else F.substring(clean, 1, 2000)).alias("snippet"), date.alias("date"), source.alias("source"), F.round(relevance, 6).alias("relevance"))


#: Freshness buckets by date restriction.
FRESHNESS = {"d1": "Day", "w1": "Week", "d7": "Week", "m1": "Month", "m3": "Month"}


def market(language: Column) -> Column:
    return F.when(F.lower(_text(language)) == "lang_ru", F.lit("ru-RU")).otherwise(F.lit("en-US"))


def freshness(restrict: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(F.nullif(restrict, F.lit("")), F.lit("m3"))))
    out = F.lit(None).cast("string")
    for code, name in FRESHNESS.items():
        out = F.when(r == code, F.lit(name)).otherwise(out)
    return out


DIRECT = (
    "answerBox struct<answer:string,snippet:string,title:string,link:string>, "
    "knowledgeGraph struct<title:string,type:string,description:string,descriptionLink:string,website:string,attributes:map<string,string>>, "
    "topStories array<struct<title:string,link:string,source:string,date:string>>"
)


def direct_answers(responses: DataFrame) -> DataFrame:
    """The answer box (1.0), the entity card (0.98) and three top stories (0.9) of each answer, in this order."""
    b = responses.select("query_id", F.from_json("body", DIRECT).alias("b"))
    joined = lambda *xs: collapse(F.array_join(F.array_distinct(F.filter(F.array(*xs), lambda x: x != "")), ". "))
    named = lambda url, name: F.when(domain(url) != "", domain(url)).otherwise(F.lit(name))
    box, card = "b.answerBox", "b.knowledgeGraph"
    t = lambda p: _text(F.col(p))
    answer = joined(t(f"{box}.title"), t(f"{box}.answer"), t(f"{box}.snippet"))
    first = b.where(F.length(answer) >= 8).select("query_id", F.lit(0).alias("ord"), F.when(t(f"{box}.title") != "", t(f"{box}.title")).otherwise(F.lit("Google answer")).alias("title"), t(f"{box}.link").alias("url"), F.substring(answer, 1, 2400).alias("snippet"), named(t(f"{box}.link"), "google_answer_box").alias("source"), F.lit(1.0).alias("relevance"))
    pairs = F.filter(F.transform(F.slice(F.map_entries(F.col(f"{card}.attributes")), 1, 10), lambda e: F.concat(F.trim(e["key"]), F.lit(": "), F.trim(e["value"]))), lambda x: ~x.rlike("^: |: $"))
    about = collapse(F.array_join(F.filter(F.array(t(f"{card}.type"), t(f"{card}.description"), F.coalesce(F.array_join(pairs, "; "), F.lit(""))), lambda x: x != ""), ". "))
    link = F.when(t(f"{card}.descriptionLink") != "", t(f"{card}.descriptionLink")).otherwise(t(f"{card}.website"))
    second = b.where((t(f"{card}.title") != "") & (F.length(about) >= 8)).select("query_id", F.lit(1).alias("ord"), t(f"{card}.title").alias("title"), link.alias("url"), F.substring(about, 1, 2400).alias("snippet"), named(link, "google_knowledge_graph").alias("source"), F.lit(0.98).alias("relevance"))
    story = b.select("query_id", F.posexplode(F.slice("b.topStories", 1, 3)).alias("i", "s")).where((t("s.title") != "") & (t("s.link") != ""))
    said = F.concat(t("s.title"), F.when(t("s.source") != "", F.concat(F.lit(" — "), t("s.source"))).otherwise(F.lit("")))
    third = story.select("query_id", (F.col("i") + 2).alias("ord"), t("s.title").alias("title"), t("s.link").alias("url"), said.alias("snippet"), named(t("s.link"), "top_stories").alias("source"), F.lit(0.9).alias("relevance"))
    return first.union(second).union(third)
