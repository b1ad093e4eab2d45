"""The text that an answer is written from: facts, primary sources, grounded figures, excerpts, sources and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.urls import blank
from . import planning as P
from .rowsets import STRUCTURED_MARK, STRUCTURED_SOURCE

# ---- Fixed values: hosts that don't ground a figure, and those left out of the line of sources -------------------
SOCIAL = ("facebook.com", "m.facebook.com", "twitter.com", "x.com", "t.me")
NOT_SOURCES = (*SOCIAL, "reddit.com")
# ------------------------------------------------------------------------------------------------------------------
#: The form of each category's excerpts; others take the general one.
FORMATS = {"currency_rate": "currency", "crypto_price": "price", "stock_price": "price", "interest_rate": "rate", "financial_news": "news"}
FACTS_HEAD, PRIMARY_HEAD, FIGURES_HEAD = "STRUCTURED FACTS (these decide):", "PRIMARY SOURCES (these before others):", "GROUNDED FIGURES (only these are safe to state):"
RULES = "Cite only addresses of this block. State a figure only as an excerpt gives it, with its domain. Where sources differ, give both."
CUT_MARK = "\n…[excerpts cut]…\n"


def _lines(rows: DataFrame, line: Column, most: int, head: str, name: str) -> DataFrame:
    """(query_id, name): the head and a line for each of a query's first `most` rows by rank."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    few = rows.withColumn("__n", n).where(F.col("__n") <= most).select("query_id", F.struct("rank", line.alias("line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda s: s["line"]), "\n")
    return few.groupBy("query_id").agg(F.concat(F.lit(f"{head}\n"), joined, F.lit("\n")).alias(name))


def structured(rows: DataFrame) -> Column:
    return (F.col("source") == STRUCTURED_SOURCE) | F.startswith(blank(F.col("enriched_text")), F.lit(STRUCTURED_MARK))


def placed_figures(rows: DataFrame, messages: DataFrame, around: int = 160) -> DataFrame:
    """(query_id, pos, n, raw, value, domain, context, place_ok): figures with the text round their first mention, and whether
    that or the row's title names a place the question asks for; without such a place every figure is in place."""
    body = F.when(F.trim(blank(F.col("enriched_text"))) != "", F.trim("enriched_text")).otherwise(F.trim(blank(F.col("snippet"))))
    asked = messages.select("query_id", F.transform(F.slice(I.place_tokens(F.col("message")), 1, 4), F.lower).alias("places"))
    texts = rows.select("query_id", "pos", F.substring(body, 1, 20_000).alias("body"), F.lower(blank(F.col("title"))).alias("title"), U.domain(F.col("url")).alias("domain"))
    each = P.figures(rows).join(texts, ["query_id", "pos"]).join(asked, "query_id")
    at = F.greatest(F.expr("locate(raw, body)"), F.lit(1))
    start = F.greatest(at - around, F.lit(1))
    context = T.collapse(F.substr("body", start, F.length("raw") + (at - start) + around))
    out = each.withColumn("context", F.substring(context, 1, around))
    near = F.lower(context)
    ok = (F.size("places") == 0) | F.exists("places", lambda p: F.contains(near, p) | F.contains(F.col("title"), p))
    return out.select("query_id", "pos", "n", "raw", "value", "domain", "context", ok.alias("place_ok"))


def grounded(figs: DataFrame, most: int = 16) -> DataFrame:
    """(query_id, i, raw, domain, context): the first figures in place; those of social hosts only where no others are."""
    by = Window.partitionBy("query_id")
    own = figs.where("place_ok").withColumn("__n", F.row_number().over(by.orderBy("pos", "n"))).where(F.col("__n") <= most)
    good = ~F.col("domain").isin(*SOCIAL)
    kept = own.withColumn("__any", F.max(good).over(by)).where(~F.col("__any") | good)
    return kept.withColumn("i", (F.row_number().over(by.orderBy("__n")) - 1).cast("long")).select("query_id", "i", "raw", "domain", "context")


def excerpts(ranked: DataFrame, most: int = 28, limit: int = 240) -> DataFrame:
    """ranked (.., rank, message, category) -> (query_id, content): each category's header and lines, news with bold titles."""
    shown = T.display_snippet(F.lit(None).cast("string"), F.col("snippet"), limit)
    dated = F.concat(F.lit(" ("), F.col("source"), F.when(blank(F.col("date")) != "", F.concat(F.lit(", "), F.col("date"))).otherwise(F.lit("")), F.lit(")"))
    cited = T.citation_suffix(F.col("url"))
    news = F.concat(F.lit("  • **"), F.substring("title", 1, 160), F.lit("**"), dated, F.lit("\n    "), shown, cited)
    line = F.when(F.col("category") == "financial_news", news).otherwise(F.concat(F.lit("  • "), shown, dated, cited))
    label = T.section_label("general", F.col("message"))
    for category, kind in FORMATS.items():
        label = F.when(F.col("category") == category, T.section_label(kind, F.col("message"))).otherwise(label)
    lines = ranked.where(F.col("rank") <= most).select("query_id", label.alias("label"), F.struct("rank", line.alias("line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda s: s["line"]), "\n")
    return lines.groupBy("query_id").agg(F.concat(F.max("label"), F.lit("\n"), joined).alias("content"))


def sources_line(ranked: DataFrame, most: int = 24) -> DataFrame:
    """(query_id, sources): distinct sources in rank order, social ones only where there are no others."""
    first = ranked.where(blank(F.col("source")) != "").groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    fine = ~F.col("source").isin(*NOT_SOURCES)
    kept = first.withColumn("__any", F.max(fine).over(Window.partitionBy("query_id"))).where(~F.col("__any") | fine)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source"))
    few = kept.withColumn("__n", n).where(F.col("__n") <= most)
    return few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "source"))), lambda s: s["source"]), " | ").alias("sources"))


def synthesize(ranked: DataFrame, messages: DataFrame, as_of: str, rules: str = RULES, cut: int = 24_000, notes: DataFrame | None = None) -> DataFrame:
    """ranked hits (.., rank, message, category) -> (query_id, synthesized, sources).

    Facts of structured rows (8), primary sources (10), grounded figures (16), excerpts, cut where a block stands before
    them, a note where notes (query_id, note) has one, sources and rules.
    """
    body = F.when(blank(F.col("enriched_text")) != "", F.trim("enriched_text")).otherwise(blank(F.col("snippet")))
    short = F.regexp_replace(F.substring(F.when(blank(F.col("snippet")) != "", F.col("snippet")).otherwise(blank(F.col("enriched_text"))), 1, 280), "\n", " ")
    facts = _lines(ranked.where(structured(ranked)), F.concat(F.lit("  • "), F.substring(body, 1, 900)), 8, FACTS_HEAD, "facts")
    primary_row = F.concat(F.lit("  • "), F.substring(F.trim(blank(F.col("title"))), 1, 120), F.lit(" | "), F.trim(blank(F.col("url"))), F.lit("\n    "), short)
    primary = _lines(ranked.where(U.is_primary_source(F.col("url")) | structured(ranked)), primary_row, 10, PRIMARY_HEAD, "prim")
    figure = F.concat(F.lit("  • "), F.col("raw"), F.lit(" ("), F.col("domain"), F.lit(") — "), F.substring("context", 1, 110))
    figs = _lines(grounded(placed_figures(ranked, messages)).withColumn("rank", F.col("i")), figure, 16, FIGURES_HEAD, "figs")
    said = notes if notes is not None else messages.select("query_id", F.lit(None).cast("string").alias("note"))
    out = excerpts(ranked).join(messages.select("query_id", "message"), "query_id")
    for part in (facts, primary, figs, sources_line(ranked), said):
        out = out.join(part, "query_id", "left")
    any_block = F.coalesce("facts", "prim", "figs").isNotNull()
    content = F.when(any_block & (F.length("content") > cut), F.concat(F.substring("content", 1, cut), F.lit(CUT_MARK))).otherwise(F.col("content"))
    note = F.when(blank(F.col("note")) != "", F.concat(F.lit("Source cross-check: "), F.trim("note"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit('LIVE WEB DATA (search: "'), F.col("message"), F.lit(f'")\nSnapshot: {as_of}\n'),
        blank(F.col("facts")), blank(F.col("prim")), blank(F.col("figs")), content, F.lit("\n"), note,
        F.lit("Sources: "), blank(F.col("sources")), F.lit(f"\n{rules}\n"),
    )
    return out.select("query_id", text.alias("synthesized"), blank(F.col("sources")).alias("sources"))


def str_list(values: Column, limit: int) -> Column:
    """The first `limit` values, trimmed, without blank ones."""
    return F.slice(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), 1, limit)


def candidate_urls(citations: Column, urls: Column) -> Column:
    """Up to 24 citations, then further https addresses of the first 16 hits, stopping at 16 in all.

    The count is looked at after each hit, so a list that has more citations gains one address at most.
    """
    start = F.slice(citations, 1, 24)

    def add(s, u):
        url = F.trim(blank(u))
        fits = ~s["done"] & F.startswith(url, F.lit("https://")) & ~F.array_contains(s["kept"], url)
        kept = F.when(fits, F.array_append(s["kept"], url)).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), (s["done"] | (F.size(kept) >= 16)).alias("done"))

    return F.aggregate(F.slice(urls, 1, 16), F.struct(start.alias("kept"), F.lit(False).alias("done")), add, lambda s: s["kept"])


def tool_json(contexts: DataFrame, cap: int = 120_000) -> DataFrame:
    """contexts (.., query_used, useful, verified, citations, urls, category, search_date, total, synthesized, draft) plus json."""
    cap = max(24_000, min(cap, 400_000))
    text = F.trim(blank(F.col("synthesized")))
    cut = F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n…"))).otherwise(text)
    cited = F.slice("citations", 1, 24)
    return contexts.withColumn(
        "json",
        F.to_json(
            F.struct(
                F.col("useful").alias("ok"), F.when(F.col("draft"), F.lit("draft")).otherwise(F.lit("deep")).alias("phase"), "query_used", "useful",
                F.col("verified").alias("verified_sources_required"), cited.alias("citation_urls"), candidate_urls(cited, F.col("urls")).alias("candidate_urls"),
                "category", "search_date", F.col("total").alias("total_results"), cut.alias("synthesized"), F.when(~F.col("useful"), F.lit("no_useful_results")).alias("error"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )


def missing_star_facts(verdicts: DataFrame, drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """(draft_id, repo, raw, value): a repository's count that an answer should have stated and didn't, the first by name.

    facts (query_id, repo, stars). A draft is in the clear if one of its star claims is supported, or its text or any
    claim has a count of its facts (2 %, or 5).
    """
    stars = F.col("stars").cast("double")
    compact = F.regexp_replace(F.col("text"), r"[\s,\x{00a0}]", "")
    supported = verdicts.where("kind = 'stars' and verdict = 'supported'").select("draft_id").distinct()
    met = drafts.join(facts, "query_id")
    told = met.where(F.contains(compact, F.col("stars").cast("long").cast("string"))).select("draft_id")
    close = N.approx_equal(F.col("value"), stars, 0.02, 5.0)
    near = met.select("draft_id", "stars").join(verdicts.where("value is not null").select("draft_id", "value"), "draft_id").where(close).select("draft_id")
    covered = supported.union(told).union(near).distinct()
    first = met.select("draft_id", "repo", "stars").join(covered, "draft_id", "left_anti").groupBy("draft_id").agg(F.min(F.struct("repo", "stars")).alias("f"))
    return first.select("draft_id", "f.repo", F.concat(F.col("f.stars").cast("long"), F.lit(" stars")).alias("raw"), F.col("f.stars").cast("double").alias("value"))


def star_facts(evidence: DataFrame) -> DataFrame:
    """(query_id, repo, stars) from the marked fact texts of evidence (query_id, text); a text after its mark, the first count."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\[STRUCTURED:github_api\]\s*repo=\S+.*?stars=\d+"), F.lit(0)))
    each = evidence.select("query_id", block.alias("b"))
    repo, count = F.regexp_extract("b", r"repo=(\S+)", 1), F.regexp_extract("b", r"stars=(\d+)", 1).cast("long")
    return each.select("query_id", repo.alias("repo"), count.alias("stars")).groupBy("query_id", "repo").agg(F.max("stars").alias("stars"))


def with_star_precedence(verdicts: DataFrame, facts: DataFrame, drafts: DataFrame) -> DataFrame:
    """verdicts whose star claims are judged by the facts (query_id, repo, stars) of the draft's query alone, where it has any."""
    stars = F.col("stars").cast("double")
    close = N.approx_equal(F.col("value"), stars, 0.02, F.greatest(F.lit(5.0), stars * 0.005))
    asked = verdicts.where("kind = 'stars'").select("draft_id", "n", "value").join(drafts.select("draft_id", "query_id"), "draft_id")
    judged = asked.join(facts, "query_id").groupBy("draft_id", "n").agg(F.max(F.coalesce(close, F.lit(False))).alias("__ok"))
    own = F.when(F.col("__ok"), F.lit("supported")).otherwise(F.lit("conflict"))
    return verdicts.join(judged, ["draft_id", "n"], "left").withColumn("verdict", F.when(F.col("__ok").isNotNull(), own).otherwise(F.col("verdict"))).drop("__ok")


def verify_json(verdicts: DataFrame, drafts: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """(draft_id, json): the claim report of each draft: claims by verdict, a note, follow-up queries, and whether repair is needed.

    citations (draft_id, citation_ok) counts where it is given. Drafts without claims are fine unless a citation is missing.
    """
    bad = F.col("verdict").isin("unsupported", "conflict")
    item = F.struct("n", "raw", "value", "kind", "verdict")
    of = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("n", "raw")))), lambda s: s["raw"])
    ordered = F.transform(F.slice(F.array_sort(F.collect_list(F.when(bad, F.struct((F.col("verdict") == "conflict").alias("c"), "n", "raw")))), 1, 6), lambda s: F.concat(F.lit("verify figure "), F.trim(s["raw"])))
    report = verdicts.groupBy("draft_id").agg(F.array_sort(F.collect_list(item)).alias("claims"), of("unsupported").alias("unsupported"), of("conflict").alias("conflicts"), F.array_distinct(ordered).alias("gap_queries"))
    none = F.array().cast("array<string>")
    out = drafts.select("draft_id").join(report, "draft_id", "left")
    out = out.join(citations, "draft_id", "left") if citations is not None else out.withColumn("citation_ok", F.lit(None).cast("boolean"))
    n = F.coalesce(F.size("claims"), F.lit(0))
    out = out.select("draft_id", "citation_ok", F.greatest(n, F.lit(0)).alias("n"), *[F.coalesce(c, none).alias(c) for c in ("unsupported", "conflicts", "gap_queries")])
    ok = (F.size("unsupported") == 0) & (F.size("conflicts") == 0) & F.coalesce("citation_ok", F.lit(True))
    note = (
        F.when(F.col("n") == 0, F.lit("No numeric claims in the draft."))
        .when(ok, F.concat(F.lit("Checked "), F.col("n"), F.lit(" claims; all supported.")))
        .otherwise(F.concat(F.lit("Checked "), F.col("n"), F.lit(" claims; unsupported="), F.size("unsupported"), F.lit(" conflict="), F.size("conflicts"), F.lit(".")))
    )
    made = F.struct(ok.alias("ok"), F.lit("verify").alias("phase"), note.alias("note"), "unsupported", "conflicts", "gap_queries", "citation_ok", F.when(~ok, F.lit("claims_need_repair")).alias("error"))
    return out.select("draft_id", F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))


def looks_like_research(x: Column) -> Column:
    """700 characters and four claims: an answer worth a verification."""
    s = F.trim(blank(x))
    return (F.length(s) >= 700) & (F.size(N.claims(s, 12)) >= 4)
