"""Plans, blocks, payloads and figures, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import numbers as N
from ..functions.regex import sql_text
from ..functions import portals as Po
from ..operators import evidence as E
from ..operators import planning as P
from ..operators import rowsets as S
from ..sources import providers as Pr
from ..sources import relations as R
from .intent_plans import YEAR, _LEAD, _TOPIC_CUT, collapse, edge, has, nouns_sql
from .rowset_plans import _RANKED, ASSESS
from .text_plans import parse_sql

_H, _Q = R.HITS, R.QUERIES_SQL
_TOPIC = f"""(select *, trim(case when ({edge("t", 120)}) = '' then substr(message, 1, 120) else {edge("t", 120)} end) as topic from (select *, trim({collapse(f"regexp_replace(regexp_replace(regexp_replace(trim(message), {_LEAD}, ''), '(?s)[:：].*$', ''), {_TOPIC_CUT}, '')")}, ' ,;') as t from {_Q}))"""
_PRIMARY = f"({has('message', P.FILINGS)} or {has('message', P.GOVERNMENT)} or {has('message', P.OPEN_SOURCE)})"


def _lens(role: str, tail: str) -> str:
    return f"{{'role': '{role}', 'query': topic || '{tail.replace('{y}', str(YEAR))}'}}"


_LENSES = f"""list_filter([{_lens("overview", " overview statistics trends {y}")}, {_lens("data", " data figures numbers {y}")},
 case when {has("message", P.FILINGS)} then {_lens("primary_filings", " investor relations OR annual report OR earnings OR regulatory filing {y}")} end, case when {has("message", P.FILINGS)} then {_lens("primary_ir", " press release financial results OR 10-K OR 10-Q {y}")} end,
 case when {has("message", P.GOVERNMENT)} then {_lens("primary_gov", " official statistics OR government report OR national statistics office {y}")} end, case when {has("message", P.OPEN_SOURCE)} then {_lens("primary_gh", " site:github.com stars license")} end,
 case when {has("message", P.PRICE)} then {_lens("prices_data", " prices costs rates median average {y}")} when not {_PRIMARY} then {_lens("prices_data", " costs rates fees {y}")} end, case when {has("message", P.BEST)} then {_lens("best_value", " best options ranking comparison")} end,
 case when {has("message", P.AREA)} then {_lens("breakdown", " neighborhoods districts areas comparison")} when {has("message", P.SEGMENT)} then {_lens("breakdown", " categories levels types segments comparison")} when not {_PRIMARY} then {_lens("breakdown", " categories types segments comparison")} end,
 {_lens("context_risks", " news outlook risks regulations {y}")}, case when regexp_matches(message, '[\\x{{0400}}-\\x{{04FF}}]') then {_lens("locale", " {y}")} end], lambda x: x is not null)[1:5]"""
_GAP = "list_contains(g, '{}')"
_NUM = f"({_GAP.format('missing_numbers')} or {_GAP.format('thin_page_text')} or len(g) = 0)"
_WEAK = f"({_GAP.format('weak_place_overlap')} and len(pl) > 0)"
_GAPS = f"""list_filter(list_transform(list_filter([case when {_NUM} then base || ' statistics data numbers prices rates {YEAR}' end, case when {_NUM} then base || ' {YEAR}' end, case when {_WEAK} then concat_ws(' ', place, array_to_string(nouns[1:5], ' '), '{YEAR}') end,
 case when {_WEAK} then concat_ws(' ', place, array_to_string(nouns[1:5], ' '), 'average median range', '{YEAR}') end, case when {_WEAK} then concat_ws(' ', place, substr(topic, 1, 80)) end, case when {_GAP.format("too_few_hosts")} or {_GAP.format("too_few_results")} then base || ' report analysis overview {YEAR}' end,
 case when len(pl) > 0 and len(nouns) > 0 then concat_ws(' ', place, array_to_string(nouns[1:4], ' '), '{YEAR}') end, case when len(pl) > 0 and regexp_matches(message, '[А-Яа-яЁё]') then place || ' data {YEAR}' when len(pl) > 0 then place || ' {YEAR} official statistics' end], lambda x: x is not null), lambda x: {collapse("x")}), lambda x: length(x) >= 8)"""
_GAP_ROWS = f"""(select query_id, w, list_transform(w, lambda x: lower(x)) as wl from (select query_id, {_GAPS} as w from (select *, case when len(pl) > 0 then trim(place || ' ' || topic) else topic end as base from (select q.*, e.g, places[1:4] as pl, array_to_string(places[1:3], ' ') as place,
 substr(trim({collapse(f"regexp_replace(regexp_replace(trim(message), {sql_text('(?i)' + I.INSTRUCTION_PREFIX)}, ''), '(?s)[:：].*$', '')")}, ' ,;'), 1, 140) as topic from {nouns_sql(_Q)} q join {ASSESS} e on q.query_id = e.query_id))))"""
_F = sql_text("(?i)" + N.FIGURE)
_FA = sql_text(f"(?i)^(?:{N.FIGURE})")
_FIGURES = f"""(select *, row_number() over (partition by query_id, pos order by i) - 1 as n from (select query_id, pos, i, substr(trim(r), 1, 48) as raw, {parse_sql(f"coalesce(nullif(regexp_extract(r, {_FA}, 2), ''), regexp_extract(r, {_FA}, 3))")} as value from (select query_id, pos, unnest(m) as r, generate_subscripts(m, 1) as i
 from (select query_id, pos, regexp_extract_all(substr(case when trim(coalesce(enriched_text, '')) <> '' then trim(enriched_text) else trim(coalesce(snippet, '')) end, 1, 20000), {_F}, 0) as m from {_H}))) where value > 0)"""
_LINE = r"""'  • ' || substr(trim(snippet), 1, 240) || ' (' || source || case when coalesce(date, '') <> '' then ', ' || date else '' end || ')' || case when regexp_matches(trim(url), '^https?://') then chr(10) || '    URL: ' || trim(url) else '' end"""


def _ranked(spark, d):
    q = R.queries(spark, d)
    return S.rerank(R.hits(spark, d), q, 28).join(q, "query_id")


def _gap_queries(spark, d):
    q = R.queries(spark, d)
    gaps = E.assess(R.hits(spark, d), q).select("query_id", F.when(F.col("gaps") == "", F.array().cast("array<string>")).otherwise(F.split("gaps", ",")).alias("g"))
    rows = q.join(gaps, "query_id").select("query_id", P.gap_queries(F.col("message"), F.col("g"), YEAR).alias("w"))
    return rows.select("query_id", F.array_join("w", "|").alias("queries"))


def _round_trip(spark, d):
    q = R.queries(spark, d)
    return P.from_payload(P.payload(R.hits(spark, d), q, 300)).select("query_id", "pos", "url", "date", "relevance", "enriched_text")


_SUBS = "[' Alpha ' || (id % 7), message, 'alpha ' || (id % 7), '', 'Beta', 'beta ', 'gamma', 'delta', 'eps']"


def _explicit(spark, d):
    m = R.messages(spark, d).where("id % 2 = 1")
    n = (F.col("id") % 7).cast("string")
    subs = F.array(F.concat(F.lit(" Alpha "), n), F.col("message"), F.concat(F.lit("alpha "), n), *[F.lit(x) for x in ("", "Beta", "beta ", "gamma", "delta", "eps")])
    return m.select("id", F.array_join(P.explicit_plan(F.lit("Primary one"), subs), "|").alias("plan"))


_REPO = [sql_text(p.replace(r"\b", "")) for p in P.REPO_PATTERNS]
_REPOS = "list_filter(list_transform(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(message, {p}, 1)" for p in _REPO[:2]) + f"), regexp_extract_all(message, {_REPO[2]}, 1)), lambda r: regexp_replace(r, '\\.git$', '')), lambda r: not list_contains({list(P.NOT_REPOS)}, lower(split_part(r, '/', -1))))"

def _cycle(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))


def _direct(spark, d):
    c = R.read(spark, d, "customer")
    key = F.col("c_custkey")
    box = F.struct(F.lit("").alias("answer"), F.col("c_mktsegment").alias("snippet"), F.col("c_name").alias("title"), F.concat(F.lit("https://www.a.com/"), key).alias("link"))
    card = F.when(key % 2 == 0, F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("type"), F.lit("about it").alias("description"), F.create_map(F.lit("k"), F.col("c_nationkey").cast("string"), F.lit("empty"), F.lit("")).alias("attributes")))
    stories = F.when(key % 3 == 0, F.array(*[F.struct(F.lit(f"story {i}").alias("title"), F.lit(f"https://n{i}.org/x").alias("link"), F.lit("desk").alias("source")) for i in range(4)]))
    return Pr.direct_answers(c.select(key.alias("query_id"), F.to_json(F.struct(box.alias("answerBox"), card.alias("knowledgeGraph"), stories.alias("topStories"))).alias("body")))


def _append(spark, d):
    facts = P.fact_row(spark.createDataFrame([("microsoft/autogen", 31000), ("pallets/flask", 68000)], "full_name string, stars long"))
    return P.append_facts(R.queries(spark, d).select("query_id", F.col("message").alias("text")), facts)


def _shrink(spark, d):
    rows = R.hits(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "snippet", "enriched_text"))).alias("results"))
    return P.shrink(rows.withColumn("synthesized", F.repeat(F.lit("text "), 6000)), 60_000, (20_000,)).select("query_id", "json")


PLANS = {
    "pln_01_heuristic_plan": (lambda spark, d: P.plan(R.queries(spark, d), YEAR), f"select query_id, i - 1 as ord, x.role as role, substr({collapse('x.query')}, 1, 240) as query from (select query_id, unnest(l) as x, generate_subscripts(l, 1) as i from (select query_id, {_LENSES} as l from {_TOPIC}))"),
    "pln_03_explicit_plan": (
        _explicit,
        f"select id, array_to_string(case when len(k) < 5 then list_concat(['Primary one'], k) else list_concat(['Primary one'], k[2:5]) end, '|') as plan from (select id, (list_filter(w, lambda x, i: list_position(wl, lower(x)) = i))[1:5] as k from (select *, list_transform(w, lambda x: lower(x)) as wl from (select id, list_filter(list_transform({_SUBS}, lambda x: trim(x)), lambda x: x <> '') as w from {R.MESSAGES_SQL} where id % 2 = 1)))",
    ),
    "pln_08_gap_queries": (_gap_queries, f"select query_id, array_to_string(list_transform((list_filter(w, lambda x, i: list_position(wl, lower(x)) = i))[1:5], lambda x: substr(x, 1, 240)), '|') as queries from {_GAP_ROWS}"),
    "url_16_repositories": (
        lambda spark, d: R.messages(spark, d).select("id", F.array_join(P.repositories(F.col("message")), "|").alias("repos")),
        f"select id, array_to_string((list_filter(w, lambda x, i: list_position(wl, lower(x)) = i))[1:8], '|') as repos from (select *, list_transform(w, lambda x: lower(x)) as wl from (select id, {_REPOS} as w from {R.MESSAGES_SQL}))",
    ),
    "syn_01_general_block": (
        lambda spark, d: P.block(_ranked(spark, d), "general"),
        rf"select query_id, case when regexp_matches(max(message), '[\x{{0400}}-\x{{04FF}}]') then '🔍 Актуальная информация:' else '🔍 Current information:' end || chr(10) || string_agg({_LINE}, chr(10) order by rank) as content from {_RANKED} where rank <= 28 group by query_id",
    ),
    "syn_03_payload_round_trip": (
        _round_trip,
        f"select query_id, row_number() over (partition by query_id order by pos) - 1 as pos, url, date, relevance, case when length(trim(enriched_text)) > 300 then substr(trim(enriched_text), 1, 300) || chr(10) || '…[truncated-for-cache]' else nullif(trim(enriched_text), '') end as enriched_text from {_H}",
    ),
    "clm_01_figures": (lambda spark, d: P.figures(R.hits(spark, d)), f"select query_id, pos, n, raw, value from {_FIGURES} where n < 12"),
    "src_16_fact_rows": (
        lambda spark, d: P.fact_row(R.read(spark, d, "supplier").select(F.col("s_name").alias("full_name"), F.col("s_suppkey").alias("stars"), F.col("s_nationkey").alias("forks"))),
        "select s_name as full_name, 'github_api' as source, 1.15::double as relevance, '[STRUCTURED:github_api] repo=' || s_name || chr(10) || 'stars=' || s_suppkey || chr(10) || 'forks=' || s_nationkey as enriched_text from supplier",
    ),
    "src_17_text_chunks": (
        lambda spark, d: R.read(spark, d, "documents").select("doc_id", F.array_join(P.chunks(F.regexp_replace("text", r"[.\n]", "    ")), "|").alias("chunks")),
        r"select doc_id, array_to_string((list_filter(list_transform((regexp_split_to_array(regexp_replace(text, '[.\n]', '    ', 'g'), '\s{3,}'))[1:10], lambda x: trim(x)), lambda x: length(x) > 60 and length(x) < 600))[1:5], '|') as chunks from documents",
    ),
    "qry_11_decision_json": (lambda spark, d: R.messages(spark, d).select("id", P.decision_json(F.concat(F.lit('x {"a": 1} {"search": true, "q": "}'), F.regexp_replace("message", r'["\\\n\r]', " "), F.lit('"} tail {'))).alias("decision")), None),
    "eng_02_enrich_limit": (
        lambda spark, d: R.messages(spark, d).select("id", P.enrich_limit(F.col("id") % 30, F.col("id") % 2 == 0, F.col("id") % 5, F.col("id") % 3 == 0, F.col("id") % 7 == 0, F.lit(9)).alias("pages")),
        f"select id, cast(case when id % 2 = 0 and id % 5 = 0 then 0 when id % 2 = 0 then least(id % 30, id % 5, 8) when id % 5 > 0 then least(id % 30, greatest(id % 5, 1)) when id % 3 = 0 then id % 30 when id % 7 = 0 then 6 else 9 end as bigint) as pages from {R.MESSAGES_SQL}",
    ),
    "src_08_market_and_freshness": (
        lambda spark, d: R.messages(spark, d).select("id", Pr.market(I.language(F.col("message"))).alias("market"), Pr.freshness(_cycle(("d1", "w1", "d7", "m1", "m3", "y1", ""))).alias("freshness")),
        r"select id, case when length(regexp_replace(message, '[^\x{0400}-\x{04FF}]', '', 'g')) > length(message) * 0.2 then 'ru-RU' else 'en-US' end as market, list_extract(['Day', 'Week', 'Week', 'Month', 'Month', null, 'Month'], id % 7 + 1) as freshness from " + R.MESSAGES_SQL,
    ),
    "src_03_direct_answers": (
        _direct,
        """select query_id, ord, title, url, snippet, source, relevance from (select c_custkey as query_id, 0 as ord, c_name as title, 'https://www.a.com/' || c_custkey as url, c_name || '. ' || c_mktsegment as snippet, 'a.com' as source, 1.0::double as relevance from customer
 union all select c_custkey, 1, c_name, '', c_mktsegment || '. about it. k: ' || c_nationkey, 'google_knowledge_graph', 0.98 from customer where c_custkey % 2 = 0
 union all select c_custkey, 2 + i, 'story ' || i, 'https://n' || i || '.org/x', 'story ' || i || ' — desk', 'n' || i || '.org', 0.9 from customer, (select unnest(range(3)) as i) where c_custkey % 3 = 0)""",
    ),
    "url_18_portal_link": (
        lambda spark, d: R.messages(spark, d).select("id", Po.deep_link(F.col("message"), "portal.example", "cinema", "2026-01-30").alias("link")),
        "select id, coalesce('https://portal.example/' || case " + " ".join(f"when {has('message', p)} then '{c}'" for p, c in Po.CITIES.items()) + """ end || '/cinema?date_from=' || strftime(date '2026-01-30' + case when contains(lower(message), 'послезавтра') then 2 when contains(lower(message), 'завтра') then 1 else 0 end, '%Y-%m-%d'), 'https://portal.example/') as link from """ + R.MESSAGES_SQL,
    ),
    "agg_10_critic": (
        lambda spark, d: P.critic(P.figures(R.hits(spark, d))),
        f"""select query_id, count(*) as figures, count(*) filter (o) as outliers, count(*) filter (not o) = 0 as needs_more from (select *, c >= 4 and mid > 0 and (value / mid >= 10 or mid / value >= 10) as o from (select query_id, value, count(*) over w as c,
 list_extract(list_sort(list(value) over w), cast(floor(count(*) over w / 2) as bigint) + 1) as mid from (select * from {_FIGURES} where n < 12) window w as (partition by query_id))) group by query_id""",
    ),
    "set_05_append_facts": (_append, None),
    "set_17_shrink_payload": (_shrink, None),
    "win_02_early_stop": (
        lambda spark, d: E.early_stop(E.waves(R.hits(spark, d).where("enriched_text is not null"), 2, 8), R.queries(spark, d), F.when(F.col("query_id") % 3 == 0, F.lit("fast")).otherwise(F.lit("deep"))).select("query_id", "pos", "wave"),
        None,
    ),
}
