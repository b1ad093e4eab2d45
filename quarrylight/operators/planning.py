"""Search plans from questions, repositories named in text, and text blocks from ranked hits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import numbers as N
from ..functions import text as T
from ..functions.regex import java
from ..functions.urls import blank
from .evidence import outliers

# ---- Fixed values: what decides a lens, its role and its query ---------------------------------------------------
PRICE = r"(цена|цен[ыу]|стоимост|price|cost|rent|аренд|зарплат|salary|wage|ставк|rate|fee|тариф|сколько\s+стоит)"
BEST = r"(лучш|best|рейтинг|rank|quality|цена\s*[-/]?\s*качеств|price\s*[-/]?\s*quality|рекоменд|подбери|top\b)"
AREA = r"(район|neighborhood|district|регион|area|квартал|микрорайон|borough|zone)"
SEGMENT = r"(категор|segment|тип\w*|kinds?|types?|уровн|junior|middle|senior|desk|office)"
FILINGS = (
    r"(market\s*size|TAM|revenue|выручк|доля\s*рынка|market\s*share|earnings|10[\s-]?K|10[\s-]?Q|filing|investor\s*relations|press\s*release|"
    r"финансов\w*\s*отч[её]т|annual\s*report|(?:объ[её]м|volume)\s*(?:рынка|market)|regulatory\s*filing)"
)
GOVERNMENT = (
    r"(официальн|official\s+(?:stat|data|figure|report|source)|national\s*stats?|government\s+(?:stat|data|report)|stat\.gov|министерств|ministry\s+of|"
    r"бюр[оа]\s*(?:нац|стат)|statistics\s+office|national\s+bureau)"
)
OPEN_SOURCE = r"(github|open[\s-]?source|stars?|зв[её]зд|репозитор|multi[\s-]?agent|orchestration)"
REPO_PATTERNS = (
    r"(?i)github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)",
    r"(?i)\brepo:([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)",
    r"(?i)\b((?:langchain-ai|crewaiinc|microsoft|openai|agentscope-ai|huggingface|anthropics)/[A-Za-z0-9_.-]+)",
)
NOT_REPOS = ("issues", "pulls", "actions", "wiki", "tree", "blob", "releases")
# ------------------------------------------------------------------------------------------------------------------


def lenses(message: Column, topic: Column, year: int) -> Column:
    """Array of (role, query): overview and data, primary sources, then what the question's words ask for."""
    has = lambda p: I._has(message, p)
    filings, government, code = has(FILINGS), has(GOVERNMENT), has(OPEN_SOURCE)
    primary = filings | government | code
    lens = lambda role, tail: F.struct(F.lit(role).alias("role"), F.concat(topic, F.lit(tail.replace("{y}", str(year)))).alias("query"))
    return F.array_compact(
        F.array(
            lens("overview", " overview statistics trends {y}"),
            lens("data", " data figures numbers {y}"),
            F.when(filings, lens("primary_filings", " investor relations OR annual report OR earnings OR regulatory filing {y}")),
            F.when(filings, lens("primary_ir", " press release financial results OR 10-K OR 10-Q {y}")),
            F.when(government, lens("primary_gov", " official statistics OR government report OR national statistics office {y}")),
            F.when(code, lens("primary_gh", " site:github.com stars license")),
            F.when(has(PRICE), lens("prices_data", " prices costs rates median average {y}")).when(~primary, lens("prices_data", " costs rates fees {y}")),
            F.when(has(BEST), lens("best_value", " best options ranking comparison")),
            F.when(has(AREA), lens("breakdown", " neighborhoods districts areas comparison"))
            .when(has(SEGMENT), lens("breakdown", " categories levels types segments comparison"))
            .when(~primary, lens("breakdown", " categories types segments comparison")),
            lens("context_risks", " news outlook risks regulations {y}"),
            F.when(T.has_cyrillic(message), lens("locale", " {y}")),
        )
    )


def plan(messages: DataFrame, year: int, most: int = 5) -> DataFrame:
    """(query_id, ord, role, query): up to `most` searches a question; price words aren't echoed, comparisons not split."""
    m = F.col("message")
    topics = messages.withColumn("topic", I.topic_core(m, F.lit("")))
    each = topics.select("query_id", F.posexplode(F.slice(lenses(m, F.col("topic"), year), 1, most)).alias("ord", "x"))
    return each.select("query_id", F.col("ord").cast("long").alias("ord"), "x.role", F.substring(T.collapse(F.col("x.query")), 1, 240).alias("query"))


def explicit_plan(primary: Column, subqueries: Column, most: int = 5) -> Column:
    """The caller's queries, each once, with the primary one first, or in the first's place if there is no room."""
    cleaned = F.filter(F.transform(subqueries, lambda q: F.trim(q)), lambda q: q != "")
    kept = F.transform(I.keep_first(cleaned, F.lower, most), lambda q: F.substring(q, 1, 500))
    p = F.substring(F.trim(blank(primary)), 1, 500)
    known = F.exists(kept, lambda q: F.lower(q) == F.lower(p)) | (p == "")
    full = F.concat(F.array(p), F.slice(kept, 2, most))
    return F.when(known, kept).when(F.size(kept) < most, F.concat(F.array(p), kept)).otherwise(full)


def gap_queries(message: Column, gaps: Column, year: int) -> Column:
    """Follow-up searches from evidence gaps and the question's own words."""
    topic = F.regexp_replace(F.trim(blank(message)), java(I.INSTRUCTION_PREFIX), "")
    topic = F.substring(I.strip_chars(T.collapse(F.regexp_replace(topic, r"(?s)[:：].*$", "")), " ,;"), 1, 140)
    places = F.slice(I.place_tokens(message), 1, 4)
    place, nouns = F.array_join(F.slice(places, 1, 3), " "), I.content_nouns(message)
    asked, has = F.size(places) > 0, lambda g: F.array_contains(gaps, g)
    base = F.when(asked, F.trim(F.concat_ws(" ", place, topic))).otherwise(topic)
    y = F.lit(str(year))
    numbers = has("missing_numbers") | has("thin_page_text") | (F.size(gaps) == 0)
    weak, five = has("weak_place_overlap") & asked, F.array_join(F.slice(nouns, 1, 5), " ")
    wanted = F.array_compact(
        F.array(
            F.when(numbers, F.concat(base, F.lit(" statistics data numbers prices rates "), y)),
            F.when(numbers, F.concat_ws(" ", base, y)),
            F.when(weak, F.concat_ws(" ", place, five, y)),
            F.when(weak, F.concat_ws(" ", place, five, F.lit("average median range"), y)),
            F.when(weak, F.concat_ws(" ", place, F.substring(topic, 1, 80))),
            F.when(has("too_few_hosts") | has("too_few_results"), F.concat(base, F.lit(" report analysis overview "), y)),
            F.when(asked & (F.size(nouns) > 0), F.concat_ws(" ", place, F.array_join(F.slice(nouns, 1, 4), " "), y)),
            F.when(asked & message.rlike("[А-Яа-яЁё]"), F.concat_ws(" ", place, F.lit("data"), y)).when(asked, F.concat_ws(" ", place, y, F.lit("official statistics"))),
        )
    )
    clean = F.filter(F.transform(wanted, T.collapse), lambda q: F.length(q) >= 8)
    return F.transform(I.keep_first(clean, F.lower, 5), lambda q: F.substring(q, 1, 240))


def repositories(x: Column, most: int = 8) -> Column:
    """owner/name pairs from addresses, repo: marks and known owners, each once; a final .git is no part of a name."""
    found = F.concat(*[F.regexp_extract_all(blank(x), F.lit(p), F.lit(1)) for p in REPO_PATTERNS])
    named = F.transform(found, lambda r: F.regexp_replace(r, r"\.git$", ""))
    real = F.filter(named, lambda r: ~F.lower(F.substring_index(r, "/", -1)).isin(*NOT_REPOS))
    return I.keep_first(real, F.lower, most)


def block(ranked: DataFrame, kind: str, most: int = 28, limit: int = 240) -> DataFrame:
    """(query_id, content): a header in the question's language and a bullet a row, in rank order."""
    shown = T.display_snippet(F.lit(None).cast("string"), F.col("snippet"), limit)
    dated = F.concat(F.lit(" ("), F.col("source"), F.when(blank(F.col("date")) != "", F.concat(F.lit(", "), F.col("date"))).otherwise(F.lit("")), F.lit(")"))
    line = F.concat(F.lit("  • "), shown, dated, T.citation_suffix(F.col("url")))
    if kind == "news":
        line = F.concat(F.lit("  • **"), F.substring("title", 1, 160), F.lit("**"), dated, F.lit("\n    "), shown, T.citation_suffix(F.col("url")))
    lines = ranked.where(F.col("rank") <= most).select("query_id", "message", F.struct("rank", line.alias("line")).alias("l"))
    joined = lines.groupBy("query_id").agg(F.max("message").alias("message"), F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda s: s["line"]), "\n").alias("lines"))
    return joined.select("query_id", F.concat(T.section_label(kind, F.col("message")), F.lit("\n"), F.col("lines")).alias("content"))


PAYLOAD = "struct<v:string,query_used:string,results:array<struct<title:string,url:string,snippet:string,date:string,source:string,relevance:double,enriched_text:string>>>"
TRUNCATED = "\n…[truncated-for-cache]"


def payload(rows: DataFrame, messages: DataFrame, cap: int = 12_000) -> DataFrame:
    """(query_id, body): a query's hits as versioned JSON, page texts cut at the cap with a mark."""
    page = F.trim(blank(F.col("enriched_text")))
    kept = F.when(F.length(page) > cap, F.concat(F.substring(page, 1, cap), F.lit(TRUNCATED))).otherwise(F.nullif(page, F.lit("")))
    hit = F.struct("title", "url", "snippet", "date", "source", "relevance", kept.alias("enriched_text"))
    grouped = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", hit.alias("h")))), lambda s: s["h"]).alias("results"))
    return grouped.join(messages, "query_id").select("query_id", F.to_json(F.struct(F.lit("v1").alias("v"), F.col("message").alias("query_used"), "results")).alias("body"))


def from_payload(bodies: DataFrame) -> DataFrame:
    """The hits of payloads of this version; others and broken ones give no rows."""
    read = bodies.select("query_id", F.from_json("body", PAYLOAD).alias("b")).where("b.v = 'v1'")
    return read.select("query_id", F.posexplode("b.results").alias("pos", "h")).select("query_id", F.col("pos").cast("long").alias("pos"), "h.*")


def last_object(text: str | None, key: str = "search") -> str | None:
    """The last balanced JSON object in a text that has the key, serialised; quotes and escapes are respected."""
    found, text = None, text or ""
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted, escaped = 0, False, False
        for end in range(start, len(text)):
            c = text[end]
            if quoted:
                quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        value = json.loads(text[start : end + 1])
                    except ValueError:
                        break
                    if isinstance(value, dict) and key in value:
                        found = json.dumps(value, ensure_ascii=False, sort_keys=True)
                    break
    return found


def decision_json(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(last_object, na_action=None)

    return run(x)


def figures(rows: DataFrame, per_row: int = 12) -> DataFrame:
    """(query_id, pos, n, raw, value): positive figures with a currency or unit in the first 20,000 characters."""
    body = F.when(F.trim(blank(F.col("enriched_text"))) != "", F.trim("enriched_text")).otherwise(F.trim(blank(F.col("snippet"))))
    found = N.matches(F.substring(body, 1, 20_000), N.FIGURE)
    number = lambda r: N.parse_number(F.coalesce(F.nullif(F.regexp_extract(r, f"(?iu)^(?:{N.FIGURE})", 2), F.lit("")), F.regexp_extract(r, f"(?iu)^(?:{N.FIGURE})", 3)))
    valued = F.filter(F.transform(found, lambda r: F.struct(F.substring(F.trim(r), 1, 48).alias("raw"), number(r).alias("value"))), lambda f: f["value"] > 0)
    each = rows.select("query_id", "pos", F.posexplode(F.slice(valued, 1, per_row)).alias("n", "f"))
    return each.select("query_id", "pos", F.col("n").cast("long").alias("n"), "f.*")


def chunks(x: Column) -> Column:
    """Parts of a page's text between runs of three spaces, of the first ten those of 61 to 599 characters, five at most."""
    parts = F.slice(F.split(x, r"\s{3,}"), 1, 10)
    return F.slice(F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: (F.length(c) > 60) & (F.length(c) < 600)), 1, 5)


def fact_row(facts: DataFrame) -> DataFrame:
    """Repository facts (full_name, stars, ..) as a hit whose text is key=value lines."""
    lines = F.concat_ws("\n", F.concat(F.lit("[STRUCTURED:github_api] repo="), "full_name"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in facts.columns if c != "full_name"])
    return facts.select("full_name", F.lit("github_api").alias("source"), F.lit(1.15).alias("relevance"), lines.alias("enriched_text"))


def enrich_limit(n_hits: Column, draft: Column, allowlisted: Column, full: Column, fast: Column, adaptive: Column, pages: int = 12) -> Column:
    """How many pages a search may read."""
    return (
        F.when(draft & (allowlisted == 0), 0)
        .when(draft, F.least(n_hits, allowlisted, F.lit(8)))
        .when(allowlisted > 0, F.least(n_hits, F.greatest(allowlisted, F.lit(1))))
        .when(full, n_hits)
        .when(fast, F.lit(min(pages, 6)))
        .otherwise(adaptive)
        .cast("long")
    )




def shrink(body: DataFrame, max_bytes: int, cuts: tuple[int, ...] = (500_000, 300_000, 150_000, 80_000, 40_000, 20_000)) -> DataFrame:
    """(key.., synthesized, results) -> json no larger than max_bytes if the ladder gets there.

    First whole; then without page texts, the block cut step by step; the last resort is 12,000 characters of it.
    """
    bare = F.transform("results", lambda r: r.withField("enriched_text", F.lit(None).cast("string")))
    wrap = lambda text, rows: F.to_json(F.struct(F.lit("v1").alias("v"), text.alias("synthesized"), rows.alias("results")))
    out = wrap(F.substring("synthesized", 1, 12_000), bare)
    for cut in reversed(cuts):
        step = wrap(F.substring("synthesized", 1, cut), bare)
        out = F.when(F.octet_length(step) <= max_bytes, step).otherwise(out)
    whole = wrap(F.col("synthesized"), F.col("results"))
    return body.withColumn("json", F.when(F.octet_length(whole) <= max_bytes, whole).otherwise(out))


def append_facts(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """evidence (query_id, text) with the fact texts of repositories it names but doesn't hold yet, in name order."""
    named = evidence.select("query_id", F.explode(repositories(F.col("text"))).alias("repo")).select("query_id", F.lower("repo").alias("repo"))
    held = evidence.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\[STRUCTURED:github_api\]\s*repo=([^\s]+)"), F.lit(1))).alias("repo")).select("query_id", F.lower("repo").alias("repo"))
    missing = named.distinct().join(held.distinct(), ["query_id", "repo"], "left_anti").join(facts.select(F.lower("full_name").alias("repo"), "enriched_text"), "repo")
    block = missing.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo", "enriched_text"))), lambda s: s["enriched_text"]), "\n\n").alias("block"))
    joined = evidence.join(block, "query_id", "left")
    return joined.select("query_id", F.when(F.col("block").isNull(), F.col("text")).otherwise(F.concat(F.trim(F.concat(F.rtrim("text"), F.lit("\n\n"), F.col("block"))), F.lit("\n"))).alias("text"))


def critic(figs: DataFrame) -> DataFrame:
    """figures (query_id, pos, n, raw, value) -> counts of figures and outliers and whether more search is needed."""
    marked = outliers(figs, "query_id", "value")
    return marked.groupBy("query_id").agg(F.count("*").alias("figures"), F.count_if("outlier").alias("outliers"), (F.count_if(~F.col("outlier")) == 0).alias("needs_more"))
