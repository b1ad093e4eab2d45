"""The search engine as DataFrame pipelines: plans sent to a backend, rows after the fetch, one reflection pass, the answer.

A backend is a function from requests (query_id, agent, role, query, most) to hits with agent and role. Nothing here
reaches a network: backends and page texts are tables, or functions over tables, that the caller passes. Rows that several
later steps use are staged (`sources.staging`), since each use would otherwise plan and run all that went before again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import intent as I
from ..functions import text as T
from ..functions.urls import blank
from . import evidence as E
from . import planning as P
from . import rowsets as S
from . import synthesis as Y
from ..sources.staging import staged

Backend = Callable[[DataFrame], DataFrame]
HIT = ("query_id", "pos", "title", "url", "snippet", "date", "source", "relevance", "enriched_text")
#: Categories whose rows are checked against a second search, and what that search adds.
CROSS_CHECKED = I.RECENT_CATEGORIES
CROSS_SUFFIX = " official"


def per_agent(n_agents: Column, max_results: int) -> Column:
    """Hits each agent may bring: all for one, else a share and three more, four at least."""
    share = F.floor(F.lit(max_results) / n_agents) + 3
    return F.when(n_agents <= 1, F.lit(max_results)).otherwise(F.greatest(F.lit(4), share)).cast("long")


def requests(plans: DataFrame, max_results: int) -> DataFrame:
    """plans (query_id, ord, role, query) -> (query_id, agent, role, query, most)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return plans.select("query_id", F.col("ord").cast("long").alias("agent"), "role", "query", per_agent(n, max_results).alias("most"))


def in_plan_order(plans: DataFrame, results: DataFrame) -> DataFrame:
    """results (query_id, agent, ..) with the order and role of their plan (query_id, agent_id, ord, role); results without a plan come last."""
    own = plans.select("query_id", F.col("agent_id").alias("agent"), "ord", "role")
    joined = results.join(own, ["query_id", "agent"], "left")
    return joined.withColumn("ord", F.coalesce(F.col("ord").cast("long"), F.lit(1_000_000).cast("long")))


def run_agents(plans: DataFrame, backend: Backend, max_results: int, stamp: bool = True) -> DataFrame:
    """The hits of all plans in plan order, an address once, cut to each agent's share; pos counts anew."""
    asked = requests(plans, max_results)
    hits = backend(asked).drop("role", "most").join(asked.select("query_id", "agent", "role", "most"), ["query_id", "agent"])
    n = F.row_number().over(Window.partitionBy("query_id", "agent").orderBy("pos"))
    few = hits.withColumn("__n", n).where(F.col("__n") <= F.col("most")).drop("__n", "most")
    merged = S.merge_agents(few) if stamp else S.keep_first(few, F.lower(F.regexp_replace(F.substring_index(F.trim(blank(F.col("url"))), "#", 1), r"/+$", "")), ["agent", "pos"], blank_is_key=False)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("agent", "pos")) - 1
    return merged.withColumn("pos", pos.cast("long")).select(*HIT)


def orchestrate(decisions: DataFrame, backend: Backend, cfg: EngineConfig, explicit: DataFrame | None = None) -> DataFrame:
    """decisions (query_id, message, search_query, depth, verified) -> hits: the caller's subqueries where explicit (query_id,
    subqueries) has some, the one query where the question is simple, else the heuristic plan."""
    m = F.col("message")
    given = decisions.join(explicit, "query_id", "left") if explicit is not None else decisions.withColumn("subqueries", F.array().cast("array<string>"))
    own = P.explicit_plan(F.col("search_query"), F.coalesce("subqueries", F.array().cast("array<string>")), cfg.max_agents)
    given = given.withColumn("__own", own).withColumn("__way", F.when(F.size(F.coalesce("subqueries", F.array().cast("array<string>"))) > 0, F.lit("explicit")).when(I.should_orchestrate(m, F.col("depth"), F.col("verified")), F.lit("planned")).otherwise(F.lit("single")))
    by_caller = given.where("__way = 'explicit'").select("query_id", F.posexplode("__own").alias("ord", "query")).withColumn("role", F.concat(F.lit("sub"), F.col("ord") + 1))
    single = given.where("__way = 'single'").select("query_id", F.lit(0).alias("ord"), F.col("search_query").alias("query"), F.lit("primary").alias("role"))
    planned = P.plan(given.where("__way = 'planned'").select("query_id", "message"), cfg.year, cfg.max_agents).select("query_id", F.col("ord").cast("int").alias("ord"), "query", "role")
    plans = by_caller.select("query_id", "ord", "query", "role").unionByName(single).unionByName(planned)
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    marked = plans.withColumn("role", F.when(several, F.col("role")).otherwise(F.lit("primary")))
    return staged(run_agents(staged(marked), backend, cfg.max_results))


def clean(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Merged hits with stale ones last and those off the asked place gone; pos is the new order."""
    order = S.demote_stale(hits, messages).select("query_id", "pos", F.col("rank").alias("__live"))
    live = staged(hits.join(order, ["query_id", "pos"]).withColumn("pos", (F.col("__live") - 1).cast("long")).drop("__live"))
    near = S.place_relevant(live, messages).select("query_id", "pos", F.col("rank").alias("__near"))
    placed = live.join(near, ["query_id", "pos"])
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("__near", "pos")) - 1
    return staged(placed.withColumn("pos", pos.cast("long")).select(*HIT))


def sanitized(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"title": T.clean_blob(F.col("title"), title=True), "snippet": T.clean_blob(F.col("snippet")), "enriched_text": T.clean_blob(F.col("enriched_text"))})


def cross_checked(hits: DataFrame, decisions: DataFrame, backend: Backend, most: int = 14) -> DataFrame:
    """hits with up to `most` rows of a second search for the categories that need one; an address once."""
    asked = decisions.where(F.col("category").isin(*CROSS_CHECKED) & (F.col("depth") != "fast") & (F.trim(blank(F.col("search_query"))) != ""))
    asked = asked.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    sent = asked.select("query_id", F.lit(0).cast("long").alias("agent"), F.lit("cross_check").alias("role"), F.concat(F.trim("search_query"), F.lit(CROSS_SUFFIX)).alias("query"), F.lit(most).cast("long").alias("most"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    extra = backend(sent).withColumn("__n", n).where(F.col("__n") <= most).select(*HIT)
    both = S.merge_rows(hits.select(*HIT), extra)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("side", "pos")) - 1
    return both.withColumn("pos", pos.cast("long")).select(*HIT)


def page_text(pages: DataFrame) -> DataFrame:
    """pages (url, structured, scraped, http) -> (url, text, way): the first way that gave 40 characters of unblocked text."""
    good = lambda c: F.when((F.length(F.trim(blank(F.col(c)))) >= 40) & ~T.is_block_page(blank(F.col(c))), F.trim(c))
    ways = [c for c in ("structured", "scraped", "http") if c in pages.columns]
    way = F.coalesce(*[F.when(good(c).isNotNull(), F.lit(c)) for c in ways])
    return pages.select("url", F.coalesce(*[good(c) for c in ways]).alias("text"), way.alias("way"))


def enrich(hits: DataFrame, messages: DataFrame, texts: DataFrame, budget: DataFrame, cfg: EngineConfig, allowed: DataFrame | None = None, max_chars: int = 96_000) -> DataFrame:
    """hits with enriched_text read from texts (url, text), wave by wave in the order of the hits until the evidence suffices.

    budget (query_id, pages) is how many hits may have a text, those that have one included; allowed (query_id, url) limits
    the reading to its addresses where a query has some. messages has depth.
    """
    held = hits.withColumn("__has", (F.trim(blank(F.col("enriched_text"))) != "").cast("int"))
    held = held.withColumn("__held", F.sum("__has").over(Window.partitionBy("query_id")))
    open_ = S.eligible_pages(held)
    if allowed is not None:
        some = allowed.select("query_id").distinct().withColumn("__some", F.lit(True))
        named = allowed.select("query_id", F.trim("url").alias("url")).distinct().withColumn("__named", F.lit(True))
        open_ = open_.join(some, "query_id", "left").join(named, ["query_id", "url"], "left").where(F.col("__some").isNull() | F.col("__named"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    asked = open_.withColumn("__n", n).join(budget, "query_id").where(F.col("__n") + F.col("__held") <= F.col("pages"))
    asked = asked.withColumn("wave", F.floor((F.col("__n") - 1) / cfg.enrich_concurrency).cast("long")).select(*HIT, "wave")
    known = texts.where("text is not null").groupBy("url").agg(F.min("text").alias("__text"))
    read = staged(asked.join(known, "url").withColumn("enriched_text", F.substring("__text", 1, max_chars)).select(*HIT, "wave"))
    stopped = E.early_stop(read, messages.select("query_id", "message", "depth"), F.col("depth"))
    got = stopped.select("query_id", "pos", F.col("enriched_text").alias("__read"))
    return staged(hits.join(got, ["query_id", "pos"], "left").withColumn("enriched_text", F.coalesce("__read", "enriched_text")).select(*HIT))


def after_fetch(hits: DataFrame, decisions: DataFrame, texts: DataFrame, cfg: EngineConfig, backend: Backend | None = None, allowlist: DataFrame | None = None) -> DataFrame:
    """hits -> the rows an answer is made of, ranked and with page texts.

    decisions: query_id, message, search_query, category, depth, draft, require_full. Second search for the categories that need
    it, cleaning, ranking, addresses that the caller wants read (allowlist), the best addresses of research drafts, the
    budget of pages, reading in waves, and only rows with a text where whole articles are required.
    """
    fast = (F.col("depth") == "fast") & ~F.col("require_full") | F.col("draft")
    known = staged(decisions.withColumn("__fast", fast).withColumn("depth", F.when(F.col("__fast"), F.lit("fast")).otherwise(F.lit("deep"))))
    rows = cross_checked(hits, known, backend) if backend is not None else hits.select(*HIT)
    ranked = S.rerank(sanitized(rows), known.select("query_id", F.col("search_query").alias("message")), cfg.max_results)
    rows = staged(ranked.withColumn("pos", (F.col("rank") - 1).cast("long")).withColumn("relevance", F.least("score", F.lit(1.0))).select(*HIT))
    floor = S.research_picks(rows.join(known.where(F.col("draft") & I.is_deep_research(F.col("message"))).select("query_id"), "query_id", "left_semi"))
    wanted = floor.select("query_id", "url", F.col("pick").alias("ord"))
    if allowlist is not None:
        own = allowlist.select("query_id", "url", F.col("ord").cast("long").alias("ord"))
        wanted = own.unionByName(wanted.join(own.select("query_id").distinct(), "query_id", "left_anti"))
    wanted = staged(wanted)
    rows = staged(S.ensure_urls(rows, wanted))
    counted = known.join(rows.groupBy("query_id").agg(F.count("*").alias("__n")), "query_id").join(wanted.groupBy("query_id").agg(F.count("*").alias("__w")), "query_id", "left")
    counted = counted.join(E.enrich_budget(rows, cfg.page_enrich, cfg.adaptive_cap), "query_id", "left")
    pages = P.enrich_limit(F.col("__n"), F.col("draft"), F.coalesce("__w", F.lit(0)), F.col("require_full"), F.col("__fast"), F.coalesce("budget", F.lit(0)), cfg.page_enrich)
    rows = enrich(rows, known, texts, counted.select("query_id", pages.alias("pages")), cfg, wanted.select("query_id", "url"))
    strict = known.select("query_id", "require_full")
    whole = (F.trim(blank(F.col("enriched_text"))) != "") & F.startswith(F.col("url"), F.lit("https://"))
    return rows.join(strict, "query_id").where(~F.col("require_full") | whole).select(*HIT)


def follow_up(rows: DataFrame, decisions: DataFrame, texts: DataFrame, backend: Backend, cfg: EngineConfig, force: Column | None = None) -> DataFrame:
    """One reflection pass: queries whose evidence is thin (or forced) search their gaps, and the new rows are merged and read.

    Other queries' rows stay as they are.
    """
    report = E.assess(rows, decisions).select("query_id", "thin", F.when(F.col("gaps") == "", F.array().cast("array<string>")).otherwise(F.split("gaps", ",")).alias("gap_list"))
    asked = decisions.join(report, "query_id").where(F.col("thin") | (force if force is not None else F.lit(False)))
    plans = staged(asked.select("query_id", F.posexplode(P.gap_queries(F.col("message"), F.col("gap_list"), cfg.year)).alias("ord", "query")).withColumn("role", F.lit("gap_fill")))
    new = run_agents(plans, backend, max(8, min(cfg.max_results, 16)))
    which = plans.select("query_id").distinct()
    first = rows.select(*HIT).join(which, "query_id", "left_semi")
    both = S.merge_rows(first, new)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("side", "pos")) - 1
    merged = staged(both.withColumn("pos", pos.cast("long")).select(*HIT))
    near = S.place_relevant(merged, decisions).select("query_id", "pos")
    merged = staged(merged.join(near, ["query_id", "pos"]))
    lacking = merged.groupBy("query_id").agg(F.count_if(F.trim(blank(F.col("enriched_text"))) == "").alias("need"), F.count("*").alias("all"))
    pages = lacking.select("query_id", (F.col("all") - F.col("need") + F.least("need", F.lit(max(4, min(10, cfg.page_enrich))))).cast("long").alias("pages"))
    read = enrich(merged, decisions.withColumn("depth", F.lit("deep")), texts, pages, cfg)
    return staged(rows.select(*HIT).join(which, "query_id", "left_anti").unionByName(read))


def criticised(rows: DataFrame, decisions: DataFrame, texts: DataFrame, backend: Backend, cfg: EngineConfig) -> DataFrame:
    """rows after one more forced follow-up of the queries whose figures are all outliers or missing, if deep or asked at length."""
    found = P.critic(P.figures(rows)).select("query_id", "needs_more")
    poor = staged(decisions.join(found, "query_id", "left").where(F.coalesce("needs_more", F.lit(True)) & ((F.col("depth") == "deep") | (F.length("message") >= 40))))
    again = follow_up(rows.join(poor.select("query_id"), "query_id", "left_semi"), poor.drop("needs_more"), texts, backend, cfg, F.lit(True))
    return rows.select(*HIT).join(poor.select("query_id"), "query_id", "left_anti").unionByName(again)


def deep_boost(pages: Column, n_plans: Column, chars: Column) -> tuple[Column, Column]:
    """Pages and characters a page of a planned search: more pages by plans, 18 at most, and 32,000 characters more, 160,000 at most."""
    return F.greatest(pages, F.least(F.lit(18), pages + 2 * n_plans)), F.least(F.lit(160_000), chars + 32_000)


def is_fast(depth: Column, require_full: Column) -> Column:
    return ~require_full & (depth == "fast")


def skipped(decisions: DataFrame) -> DataFrame:
    """The empty answer of queries that aren't searched."""
    return decisions.select("query_id", F.lit(False).alias("found"), F.lit("").alias("query_used"), F.lit("").alias("synthesized"), F.lit("").alias("citations"), F.lit(0).cast("long").alias("total"))


def answer(messages: DataFrame, backend: Backend, texts: DataFrame, cfg: EngineConfig | None = None, decisions: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """messages (query_id, message) -> (query_id, found, query_used, synthesized, citations, total): the whole engine, lazily.

    Decide by the rules (or by decisions of the caller), rewrite, plan, search, merge, clean, add facts, rank and read, one
    follow-up where the evidence is thin, one where the figures fail the critic, and synthesis. Queries that need no search
    or find nothing give the empty answer.
    """
    cfg = cfg or EngineConfig()
    m = F.col("message")
    decided = decisions if decisions is not None else I.legacy_decision(messages, cfg.year)
    for name, value in (("depth", I.effective_depth(m, F.lit("deep"))), ("verified", F.lit(False)), ("draft", F.lit(False)), ("require_full", F.lit(False))):
        decided = decided if name in decided.columns else decided.withColumn(name, value)
    shaped = F.when(I.is_current_fact(m), I.shape_live_query(m, F.col("search_query"))).otherwise(I.augment_for_media(F.col("search_query"), m, I.media_intent(m)))
    searched = staged(decided.where("should_search").withColumn("search_query", shaped))
    hits = clean(orchestrate(searched, backend, cfg), searched)
    if facts is not None:
        with_facts = S.with_facts(hits, facts.select(*HIT))
        pos = F.row_number().over(Window.partitionBy("query_id").orderBy("side", "pos")) - 1
        hits = staged(with_facts.withColumn("pos", pos.cast("long")).select(*HIT))
    rows = staged(after_fetch(hits, searched, texts, cfg, backend))
    rows = criticised(follow_up(rows, searched, texts, backend, cfg), searched, texts, backend, cfg)
    asked = searched.select("query_id", F.col("search_query").alias("message"))
    ranked = staged(S.relevance_floor(S.rerank(rows, asked, cfg.max_rows), cfg.relevance_floor))
    full = ranked.join(searched.select("query_id", "message", F.coalesce("category", F.lit("general")).alias("category")), "query_id")
    block = Y.synthesize(full, asked, cfg.as_of)
    cited = S.ordered_distinct(ranked.where(F.trim("url").rlike("^https?://")), F.trim("url"), cfg.citation_urls, "citations")
    total = rows.groupBy("query_id").agg(F.count("*").alias("total"))
    made = asked.join(block, "query_id").join(cited, "query_id", "left").join(total, "query_id")
    made = staged(made.select("query_id", F.lit(True).alias("found"), F.col("message").alias("query_used"), "synthesized", blank(F.col("citations")).alias("citations"), "total"))
    return made.unionByName(skipped(decided.join(made.select("query_id"), "query_id", "left_anti")))
