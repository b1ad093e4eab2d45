"""Model answers, sessions, synthesis, chains, schedules and the engine as a whole, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import intent as I
from ..functions import portals as Po
from ..functions import text as T
from ..functions import urls as U
from ..functions.regex import sql_list
from ..operators import claims as C
from ..operators import engine as En
from ..operators import guards as G
from ..operators import models as M
from ..operators import planning as P
from ..operators import rowsets as S
from ..operators import sessions as Se
from ..operators import synthesis as Y
from ..operators.smalltalk import trivial_by_table
from ..sources import backends as B
from ..sources import cache as Ca
from ..sources import relations as R
from ..sources.staging import staged
from ..streaming import windows as W
from .guard_plans import _CALLS, _E, _HITS, _LIMIT_OK, _TRIP_OK, _TRIP_STEP, VERDICTS, _chain_calls, _drafts, _events, _evidence
from .intent_plans import _DEEP, _DEFINITE_NO, _SHORT_NO, _TIMED, _TRIVIAL, _YES, _N, YEAR, any_of, collapse, contains_any, has, optimize, places_sql
from .planning_plans import _FIGURES, _GAP_ROWS, _LENSES, _TOPIC
from .rowset_plans import _HK, _RANKED, ASSESS, parts_of
from .text_plans import CLAIMS_SQL, TEXTS_SQL
from .url_plans import PRIMARY

_H, _Q, _MSG = R.HITS, R.QUERIES_SQL, R.MESSAGES_SQL
CFG = EngineConfig(as_of=f"{YEAR}-01-01")

# ---- model answers: made from the row's number, of every shape that a model gives ---------------------------------
ANSWERS = (
    'Sure: {"search": true, "query": " rate now ", "category": "currency_rate", "depth": "fast", "reason": "asks a rate", "url": "https://a.org"} done',
    '{"search": false, "reason": "chat"}',
    "no json at all",
    '{"search": true, "category": "nonsense", "verified_sources_required": "yes", "url": "a.org"}',
    None,
)


def _answered(spark, d):
    return R.messages(spark, d).withColumn("answer", F.get(F.array(*[F.lit(a).cast("string") for a in ANSWERS]), (F.col("id") % len(ANSWERS)).cast("int")))


_K = f"(id % {len(ANSWERS)})"
_SEMANTIC = f"""select id, message, {_K} in (0, 3) as should_search, case {_K} when 0 then 'currency_rate' when 3 then 'general' end as category,
 case {_K} when 0 then 'rate now' when 3 then {optimize("message", "'general'")} else '' end as search_query, case when {_K} in (2, 4) then 0.0 else 0.88 end::double as confidence,
 case {_K} when 0 then 'asks a rate' when 1 then 'chat' when 3 then 'semantic_classifier' else 'semantic LLM: no JSON' end as reason,
 case when {_K} = 3 then 'deep' else 'fast' end as depth, {_K} = 3 as verified, case when {_K} = 0 then 'https://a.org' else '' end as url from {_MSG}"""
_RULES = f"""select id, message, not no and (yes is not null or timed) as should_search, case when no then null when yes is not null then yes when timed then 'general' end as category,
 case when no or (yes is null and not timed) then '' else {optimize("message", "coalesce(yes, 'general')")} end as search_query, case when no then 0.0 when yes is not null then 0.95 when timed then 0.8 else 0.0 end::double as confidence,
 case when no then 'Tier 1: heuristic skip' when yes is not null then 'Tier 2: matched ' || yes when timed then 'Tier 2: time trigger + domain term' else 'No signal found, default no-search' end as reason
 from (select *, {_DEFINITE_NO} as no, {_YES} as yes, {_TIMED} as timed from {_MSG})"""
_TRIVIAL_NO = f"(select id, {_TRIVIAL} or {_SHORT_NO} or {any_of('trim(message)', I.TRIVIAL_NO)} as skip from (select *, {_N} as n from {_MSG}))"
_CLASSIFY = f"""select s.id, case when t.skip then false when {_K.replace("id", "s.id")} in (2, 4) then r.should_search else s.should_search end as should_search,
 case when t.skip then null when {_K.replace("id", "s.id")} in (2, 4) then r.category else s.category end as category, case when t.skip then '' when {_K.replace("id", "s.id")} in (2, 4) then r.search_query else s.search_query end as search_query,
 case when t.skip then 0.0 when {_K.replace("id", "s.id")} in (2, 4) then r.confidence else s.confidence end as confidence,
 case when t.skip then 'trivial_skip_llm_primary' when {_K.replace("id", "s.id")} in (2, 4) then r.reason else s.reason end as reason from ({_SEMANTIC}) s join ({_RULES}) r on s.id = r.id join {_TRIVIAL_NO} t on t.id = s.id"""

_PLAN_ANSWER = '{"agents": [{"id": "p1", "role": "prices", "query": " price of it today "}, {"query": "tiny"}, {"role": "", "query": "risks and outlook of it"}]}'


def _planned_answers(spark, d):
    two, one = F.lit(f"Plan: {_PLAN_ANSWER}."), F.lit('{"agents": [{"query": "only one query"}]}')
    return R.queries(spark, d).withColumn("answer", F.when(F.col("query_id") % 3 == 0, two).when(F.col("query_id") % 3 == 1, one))


_HEURISTIC = f"select query_id, i - 1 as ord, x.role as role, substr({collapse('x.query')}, 1, 240) as query from (select query_id, unnest(l) as x, generate_subscripts(l, 1) as i from (select query_id, {_LENSES} as l from {_TOPIC}))"


def _gap_plan(spark, d):
    q = R.queries(spark, d)
    from ..operators import evidence as E

    report = E.assess(R.hits(spark, d), q).select("query_id", "thin", F.when(F.col("gaps") == "", F.array().cast("array<string>")).otherwise(F.split("gaps", ",")).alias("g"))
    answer = F.when(F.col("query_id") % 4 == 0, F.lit('{"queries": ["  first  gap query ", "short", "First gap query", "second gap query"]}'))
    rows = q.join(report, "query_id").withColumn("answer", answer)
    return rows.select("query_id", F.array_join(M.gap_plan(F.col("message"), F.col("answer"), F.col("g"), F.col("thin"), F.col("query_id") % 5 == 0, YEAR), "|").alias("queries"))


def _picked(spark, d):
    ranked = S.rerank(R.hits(spark, d), R.queries(spark, d), 24)
    answers = R.queries(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, F.lit('I keep {"keep": [2, 0, "2", 99, -1, "x", 1]}')).otherwise(F.lit("none")).alias("answer"))
    return M.pick(ranked, answers, 4).select("query_id", "pick", "pos")


def _echo(prompt: str) -> str:
    if prompt == "Say: ":
        raise ValueError("nothing to say")
    return f"{len(prompt)} {prompt[:10]}"


# ---- sessions: the hits of eight queries in turn are a conversation -----------------------------------------------
def _contexts(spark, d):
    h = R.hits(spark, d)
    return h.select(F.floor(F.col("query_id") / 8).alias("conversation"), (F.col("query_id") % 8).alias("turn"), "pos", F.when(F.col("pos") % 3 == 2, F.lit("https://same.org/x")).otherwise(F.col("url")).alias("url"), F.when(F.col("pos") % 3 == 2, F.lit("one")).otherwise(F.col("source")).alias("source"), F.when(F.col("pos") % 3 == 2, F.lit("the same words of more than forty characters each time")).otherwise(F.col("snippet")).alias("snippet"), F.lit(None).cast("string").alias("enriched_text"))


_CONTEXT_LINES = f"""(select c, row_number() over (partition by c order by turn, pos, line) as n, line from (select c, turn, pos, '• [' || coalesce(source, '') || '] ' || excerpt || chr(10) || '  ' || url as line
 from (select *, trim(substr(snippet, 1, 720)) as excerpt, row_number() over (partition by c, turn order by pos) as i from (select query_id // 8 as c, query_id % 8 as turn, pos, trim(case when pos % 3 = 2 then 'https://same.org/x' else url end) as url,
 case when pos % 3 = 2 then 'one' else source end as source, case when pos % 3 = 2 then 'the same words of more than forty characters each time' else snippet end as snippet from {_H})) where i <= 16 and starts_with(url, 'https://') and length(excerpt) >= 40))"""
_RING = f"""with recursive l as (select * from {_CONTEXT_LINES}), r as (select c, n, [line] as s from l where n = 1
 union all select l.c, l.n, case when list_contains(r.s, l.line) then r.s else list_slice(list_append(r.s, l.line), -10, -1) end from r join l on l.c = r.c and l.n = r.n + 1)"""
_RING_END = "(select c, s from r qualify row_number() over (partition by c order by n desc) = 1)"


def _previewed(spark, d):
    answers = R.queries(spark, d).select(F.floor(F.col("query_id") / 8).alias("conversation"), F.when(F.col("query_id") % 2 == 0, F.col("message")).otherwise(F.lit(" ")).alias("text"), "query_id")
    return Se.with_preview(answers, Se.memory(_contexts(spark, d), 10), 3).select("query_id", "text")


# ---- claims and facts ---------------------------------------------------------------------------------------------
def _star_rows(spark, d):
    """Facts of every third query."""
    return R.queries(spark, d).where("query_id % 3 = 0").select("query_id", F.concat(F.lit("owner/r"), F.col("query_id")).alias("repo"), (F.col("query_id") % 40 * 1000 + 25000).alias("stars"))


_STAR_ROWS = f"(select query_id, 'owner/r' || query_id as repo, query_id % 40 * 1000 + 25000 as stars from {_Q} where query_id % 3 = 0)"
_STAR_CLOSE = "(abs(v.value - f.stars) <= {t} or abs(v.value - f.stars) / greatest(abs(v.value), abs(f.stars), 1.0) <= 0.02)"


def _verdicts(spark, d):
    return C.verify(_drafts(spark, d), _evidence(spark, d))


# ---- synthesis ----------------------------------------------------------------------------------------------------
def _for_synthesis(spark, d):
    q = R.queries(spark, d)
    category = F.get(F.array(*[F.lit(c) for c in ("general", "financial_news", "currency_rate")]), (F.col("query_id") % 3).cast("int"))
    return S.rerank(R.hits(spark, d), q, 28).join(q.withColumn("category", category), "query_id"), q


_DATED = "' (' || source || case when coalesce(date, '') <> '' then ', ' || date else '' end || ')'"
_CITED = "case when regexp_matches(trim(url), '^https?://') then chr(10) || '    URL: ' || trim(url) else '' end"
_GENERAL_LINE = f"'  • ' || substr(trim(snippet), 1, 240) || {_DATED} || {_CITED}"
_NEWS_LINE = f"'  • **' || substr(title, 1, 160) || '**' || {_DATED} || chr(10) || '    ' || substr(trim(snippet), 1, 240) || {_CITED}"
_LABELS = {0: "general", 1: "news", 2: "currency"}
_LABEL = "case " + " ".join(rf"when query_id % 3 = {k} then case when regexp_matches(max(message), '[\x{{0400}}-\x{{04FF}}]') then '{T.SECTION_LABELS[v][0]}' else '{T.SECTION_LABELS[v][1]}' end" for k, v in _LABELS.items()) + " end"
_EXCERPTS = f"select query_id, {_LABEL} || chr(10) || string_agg(case when query_id % 3 = 1 then {_NEWS_LINE} else {_GENERAL_LINE} end, chr(10) order by rank) as content from {_RANKED} where rank <= 28 group by query_id"
_SOURCES = f"""select query_id, string_agg(source, ' | ' order by rank, source) as sources from (select *, row_number() over (partition by query_id order by rank, source) as n from (select *, bool_or(fine) over (partition by query_id) as any_fine
 from (select query_id, source, min(rank) as rank, not list_contains({sql_list(Y.NOT_SOURCES)}, source) as fine from {_RANKED} where rank <= 28 and coalesce(source, '') <> '' group by query_id, source)) where fine or not any_fine) where n <= 24 group by query_id"""


def _contexts_for_tool(spark, d):
    h = R.hits(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda s: s["url"]).alias("urls"))
    cited = F.slice(F.filter("urls", lambda u: F.startswith(u, F.lit("http"))), 1, 5)
    q = R.queries(spark, d).join(h, "query_id")
    return q.select("query_id", F.col("message").alias("query_used"), (F.col("query_id") % 2 == 0).alias("useful"), (F.col("query_id") % 3 == 0).alias("verified"), cited.alias("citations"), "urls", F.lit("general").alias("category"), F.lit("2026-01-01").alias("search_date"), F.size("urls").cast("long").alias("total"), F.repeat(F.lit("x"), 24_010).alias("synthesized"), (F.col("query_id") % 5 == 0).alias("draft"))


_URLS_OF = f"(select q.query_id, q.message, u.urls, list_filter(u.urls, lambda x: starts_with(x, 'http'))[1:5] as cited from {_Q} q join (select query_id, list(url order by pos) as urls from {_H} group by query_id) u on q.query_id = u.query_id)"
_NEW_URLS = "list_filter(list_transform(urls[1:16], lambda x: trim(x)), lambda x: starts_with(x, 'https://') and not list_contains(cited, x))"
_CANDIDATES = f"(select *, list_concat(cited, (list_filter(w, lambda x, i: list_position(w, x) = i))[1:16 - len(cited)]) as candidates from (select *, {_NEW_URLS} as w from {_URLS_OF}))"


# ---- chains, caches, schedules ------------------------------------------------------------------------------------
def _backend_rows(spark, d):
    name = F.get(F.array(*[F.lit(n) for n in ("tavily", "serper", "other", "bing", "brave")]), (F.col("c_custkey") % 5).cast("int"))
    return R.read(spark, d, "customer").select((F.floor(F.col("c_custkey") / 5) % 50).alias("tenant"), name.alias("name"), F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).when(F.col("c_custkey") % 11 != 0, F.lit("key")).alias("key"))


_BACKENDS = f"(select c_custkey // 5 % 50 as tenant, list_extract(['tavily', 'serper', 'other', 'bing', 'brave'], c_custkey % 5 + 1) as name from customer where c_custkey % 7 <> 0 and c_custkey % 11 <> 0)"


def _cache_tables(spark, d):
    e = _events(spark, d)
    entries = e.where("event_type = 'purchase'").select("key", "t", F.when(F.col("event_id") % 2 == 0, 7200.0).otherwise(86400.0).alias("ttl_s"), F.col("event_id").cast("string").alias("body"))
    return entries, e.where("event_type = 'click'").select(F.col("event_id").alias("id"), "key", "t")


_STORED = "(select user_id as key, epoch_us(ts) / 1e6 as st, max(event_id::varchar) as body from events where event_type = 'purchase' group by 1, 2)"


def _backend(hits):
    """Each agent of a query finds two of three hits of it, by its own number."""

    def find(asked):
        return asked.select("query_id", "agent", "role").join(hits, "query_id").where((F.col("pos") + F.col("agent")) % 3 != 0).withColumn("enriched_text", F.lit(None).cast("string"))

    return find


def _texts(hits):
    return hits.where("enriched_text is not null").select("url", F.col("enriched_text").alias("text"))


def _engine(run):
    """run(hits, decisions, backend, texts) over hits and decisions that are staged once."""

    def query(spark, d):
        hits = staged(R.hits(spark, d))
        return run(hits, staged(_decisions(spark, d)), _backend(hits), _texts(hits))

    return query


def _decisions(spark, d):
    q = R.queries(spark, d)
    return I.legacy_decision(q, YEAR).where("should_search").withColumns({"verified": F.lit(False), "depth": F.when(F.col("query_id") % 3 == 0, F.lit("fast")).otherwise(F.lit("deep")), "draft": F.col("query_id") % 7 == 0, "require_full": F.col("query_id") % 11 == 0})


def _pages_by_way(spark, d):
    h = R.hits(spark, d)
    return h.select("query_id", "pos", F.concat(F.lit("u"), "query_id", F.lit("/"), "pos").alias("url"), F.when(F.col("pos") % 2 == 0, F.col("enriched_text")).alias("structured"), F.when(F.col("pos") % 3 == 0, F.col("snippet")).otherwise(F.lit("Access denied " + "x" * 40)).alias("scraped"), F.col("snippet").alias("http"))


_BLOCKED = contains_any("lower({})", T.BLOCK_PHRASES)
_ISLAND = "sum(new) over (partition by user_id order by ts, event_id)"
_SLIDES = "(select ts, event_type, unnest([s, s - interval 12 hours]) as start from (select ts, event_type, time_bucket(interval 12 hours, ts::timestamp, timestamp '2000-01-01') as s from events))"
_HOLD = "struct_extract({s}, 'h')"
_TRIP = "struct_extract({s}, 'b')"
_H_OK = _LIMIT_OK.replace("{s}", _HOLD)
_H_LIST = _HITS.replace("{s}", _HOLD)
_B_OK = _TRIP_OK.replace("{s}", _TRIP)
_GUARD_STEP = f"case when {_H_OK} then {{{{'h': list_append({_H_LIST}, e.t), 'b': {_TRIP_STEP.replace('{s}', _TRIP)}}}}} else {{{{'h': {_H_LIST}, 'b': {_TRIP}}}}} end"


def _guarded_sql() -> str:
    start = "{'h': cast([] as double[]), 'b': [0.0::double, -1e18::double]}"
    decide, step = f"{_H_OK} and {_B_OK}", _GUARD_STEP
    at = lambda text, s: text.replace("{s}", s).replace("{{", "{").replace("}}", "}")
    return f"""with recursive {_E}, r as (select key, n, event_id, {at(decide, start)} as allowed, {at(step, start)} as s from e where n = 1
 union all select e.key, e.n, e.event_id, {at(decide, "r.s")}, {at(step, "r.s")} from r join e on e.key = r.key and e.n = r.n + 1) select key, event_id, allowed from r"""


def _lexicon(spark):
    return spark.createDataFrame([("phrase", t) for t in I.TRIVIAL_PHRASES] + [("token", t) for t in I.TRIVIAL_TOKENS], "kind string, term string")


PLANS = {
    "qry_02_trivial_by_table": (lambda spark, d: trivial_by_table(R.messages(spark, d), _lexicon(spark)), f"select id, {_TRIVIAL} as trivial from (select *, {_N} as n from {_MSG})"),
    "qry_13_semantic_decision": (lambda spark, d: M.semantic_decision(_answered(spark, d), YEAR).drop("message", "answer"), f"select * exclude (message) from ({_SEMANTIC})"),
    "qry_09_classify": (lambda spark, d: M.classify(_answered(spark, d), YEAR).drop("message", "answer"), _CLASSIFY),
    "qry_21_portal_query": (
        lambda spark, d: R.messages(spark, d).select("id", Po.biased_query(F.col("message"), F.col("message"), "portal.example").alias("search_query")),
        "select id, case when (" + " or ".join(has("message", p) for p in Po.CITIES) + f") and not contains(lower(trim(message)), 'portal.example') then trim(trim(message) || ' site:portal.example') else message end as search_query from {_MSG}",
    ),
    "udf_01_generated_answers": (
        lambda spark, d: M.generate(R.messages(spark, d), F.concat(F.lit("Say: "), F.col("message")), _echo).select("id", "answer"),
        f"select id, case when message = '' then null else length('Say: ' || message) || ' Say: ' || substr(message, 1, 5) end as answer from {_MSG}",
    ),
    "udf_01_stored_answers": (
        lambda spark, d: M.ask(R.messages(spark, d), F.col("message"), R.messages(spark, d).where("id % 2 = 0").select(F.sha2("message", 256).alias("prompt_hash"), F.length("message").cast("string").alias("answer"))).select("id", "answer"),
        f"select m.id, case when a.message is not null then length(m.message)::varchar end as answer from {_MSG} m left join (select distinct message from {_MSG} where id % 2 = 0) a on m.message = a.message",
    ),
    "pln_04_build_plans": (
        lambda spark, d: M.build_plans(_planned_answers(spark, d), YEAR),
        f"""select query_id, ord, 'a' || (ord + 1) as agent_id, role, query from ({_HEURISTIC}) where query_id % 3 <> 0 union all
 select query_id, unnest([0, 1]) as ord, unnest(['p1', 'a3']), unnest(['prices', 'agent_3']), unnest(['price of it today', 'risks and outlook of it']) from {_Q} where query_id % 3 = 0""",
    ),
    "pln_05_plan_order": (
        lambda spark, d: En.in_plan_order(
            P.plan(R.queries(spark, d), YEAR).withColumn("agent_id", F.concat(F.lit("a"), F.col("ord"))),
            R.hits(spark, d).select("query_id", "pos", F.concat(F.lit("a"), F.col("pos") % 7).alias("agent")),
        ).select("query_id", "agent", "pos", "ord", "role"),
        f"select h.query_id, 'a' || (pos % 7) as agent, pos, coalesce(p.ord, 1000000) as ord, p.role from {_H} h left join ({_HEURISTIC}) p on h.query_id = p.query_id and pos % 7 = p.ord",
    ),
    "pln_07_fanout_queries": (
        lambda spark, d: En.requests(P.plan(R.queries(spark, d), YEAR), 24),
        f"select query_id, ord as agent, role, query, case when n <= 1 then 24 else greatest(4, 24 // n + 3) end as most from (select *, count(*) over (partition by query_id) as n from ({_HEURISTIC}))",
    ),
    "pln_09_gap_plan": (
        _gap_plan,
        f"""select g.query_id, case when g.query_id % 5 <> 0 and not thin then '' when g.query_id % 4 = 0 then 'first gap query|second gap query' else array_to_string(list_transform((list_filter(w, lambda x, i: list_position(wl, lower(x)) = i))[1:5], lambda x: substr(x, 1, 240)), '|') end as queries
 from {_GAP_ROWS} g join (select query_id as q, thin from {ASSESS}) e on e.q = g.query_id""",
    ),
    "rnk_04_model_picks": (
        _picked,
        f"select query_id, row_number() over (partition by query_id order by case rank when 3 then 1 when 1 then 2 else 3 end) as pick, pos from {_RANKED} where query_id % 2 = 0 and rank <= 3 union all select query_id, rank, pos from {_RANKED} where query_id % 2 = 1 and rank <= 4",
    ),
    "win_04_session_memory": (
        lambda spark, d: Se.memory(_contexts(spark, d), 10).select(F.col("conversation").cast("long").alias("conversation"), "n", "line"),
        f"{_RING} select c as conversation, unnest(range(len(s))) as n, unnest(s) as line from {_RING_END}",
    ),
    "win_05_session_preview": (
        _previewed,
        f"""{_RING} select q.query_id, case when s is not null and trim(t) <> '' then chr(10) || '--- SESSION_WEB_MEMORY (reuse only if relevant; cite URLs verbatim) ---' || chr(10) || array_to_string(s[-3:], chr(10)) || chr(10) || repeat('-', 68) || chr(10) || chr(10) || t else t end as text
 from (select query_id, query_id // 8 as c, case when query_id % 2 = 0 then message else ' ' end as t from {_Q}) q left join {_RING_END} x on x.c = q.c""",
    ),
    "win_08_per_agent": (
        lambda spark, d: R.messages(spark, d).select("id", En.per_agent((F.col("id") % 6).cast("int"), 20).alias("most")),
        f"select id, case when id % 6 <= 1 then 20 else greatest(4, 20 // (id % 6) + 3) end as most from {_MSG}",
    ),
    "set_14_string_list": (
        lambda spark, d: R.messages(spark, d).select("id", F.array_join(Y.str_list(F.array(F.concat(F.lit(" "), F.col("message")), F.lit("  "), F.lit(" b "), F.lit("c"), F.lit("d")), 3), "|").alias("kept")),
        f"select id, array_to_string((list_filter(list_transform([' ' || message, '  ', ' b ', 'c', 'd'], lambda x: trim(x)), lambda x: x <> ''))[1:3], '|') as kept from {_MSG}",
    ),
    "set_15_candidate_urls": (
        lambda spark, d: _contexts_for_tool(spark, d).select("query_id", F.array_join(Y.candidate_urls(F.col("citations"), F.col("urls")), " ").alias("candidates")),
        f"select query_id, array_to_string(candidates, ' ') as candidates from {_CANDIDATES}",
    ),
    "set_16_split_keys": (
        lambda spark, d: R.messages(spark, d).select("id", F.array_join(B.split_keys(F.concat(F.lit("'k1', k2;\"k3\"  k1,;"), F.col("id"))), "|").alias("keys")),
        f"select id, 'k1|k2|k3|' || id as keys from {_MSG}",
    ),
    "agg_11_research_answer": (
        lambda spark, d: R.hits(spark, d).select("query_id", "pos", Y.looks_like_research(F.repeat(F.col("snippet"), 5)).alias("research")),
        f"""select h.query_id, h.pos, length(trim(repeat(h.snippet, 5))) >= 700 and coalesce(c.n, 0) >= 4 as research from {_H} h left join (select id, count(*) as n from {CLAIMS_SQL.replace(TEXTS_SQL, f"(select 'hit' as origin, query_id * 1000 + pos as id, repeat(snippet, 5) as text from {_H})")} group by id) c on c.id = h.query_id * 1000 + h.pos""",
    ),
    "clm_03_star_precedence": (
        lambda spark, d: Y.with_star_precedence(_verdicts(spark, d), _star_rows(spark, d), _drafts(spark, d)).select("draft_id", "n", "verdict"),
        f"""select v.draft_id, v.n, case when v.kind = 'stars' and f.stars is not null then case when coalesce({_STAR_CLOSE.format(t="greatest(5.0, f.stars * 0.005)")}, false) then 'supported' else 'conflict' end else v.verdict end as verdict
 from {VERDICTS} v left join {_STAR_ROWS} f on f.query_id = v.draft_id // 1000""",
    ),
    "clm_07_missing_facts": (
        lambda spark, d: Y.missing_star_facts(_verdicts(spark, d), _drafts(spark, d), _star_rows(spark, d)),
        f"""select d.draft_id, f.repo, f.stars || ' stars' as raw, f.stars::double as value from (select query_id * 1000 + pos as draft_id, query_id, snippet as text from {_H}) d join {_STAR_ROWS} f on d.query_id = f.query_id
 where not contains(regexp_replace(d.text, '[\\s,\\x{{00a0}}]', '', 'g'), f.stars::varchar) and not exists (select 1 from {VERDICTS} v where v.draft_id = d.draft_id and ((v.kind = 'stars' and v.verdict = 'supported') or (v.value is not null and {_STAR_CLOSE.format(t="5.0")})))""",
    ),
    "clm_10_grounded_figures": (
        lambda spark, d: Y.grounded(Y.placed_figures(R.hits(spark, d), R.queries(spark, d))).select("query_id", "i", "raw", "domain"),
        f"""select query_id, row_number() over (partition by query_id order by pos, n) - 1 as i, raw, domain from (select *, bool_or(good) over (partition by query_id) as any_good from (select *, not list_contains({sql_list(Y.SOCIAL)}, domain) as good, row_number() over (partition by query_id order by pos, n) as place
 from (select f.query_id, f.pos, f.n, f.raw, t.domain, len(t.places[1:4]) = 0 or len(list_filter(list_transform(t.places[1:4], lambda x: lower(x)), lambda p: contains(lower(substr({collapse("substr(t.body, greatest(strpos(t.body, f.raw) - 160, 1), length(f.raw) + (greatest(strpos(t.body, f.raw), 1) - greatest(strpos(t.body, f.raw) - 160, 1)) + 160)")}, 1, 160)), p) or contains(t.title, p))) > 0 as ok
 from (select * from {_FIGURES} where n < 12) f join (select h.query_id, h.pos, h.domain, q.places, lower(coalesce(title, '')) as title, substr(case when trim(coalesce(enriched_text, '')) <> '' then trim(enriched_text) else trim(coalesce(snippet, '')) end, 1, 20000) as body
 from {parts_of(_HK)} h join {places_sql(_Q)} q on h.query_id = q.query_id) t on f.query_id = t.query_id and f.pos = t.pos) where ok) where place <= 16) where good or not any_good""",
    ),
    "syn_01_excerpts_by_category": (lambda spark, d: Y.excerpts(_for_synthesis(spark, d)[0]), _EXCERPTS),
    "syn_02_sources_line": (lambda spark, d: Y.sources_line(_for_synthesis(spark, d)[0]), _SOURCES),
    "syn_02_synthesis": (lambda spark, d: Y.synthesize(*_for_synthesis(spark, d), CFG.as_of), None),
    "syn_04_tool_json": (
        lambda spark, d: Y.tool_json(_contexts_for_tool(spark, d), 24_000).select("query_id", F.get_json_object("json", "$.phase").alias("phase"), F.get_json_object("json", "$.error").alias("error"), F.length(F.get_json_object("json", "$.synthesized")).alias("chars"), F.size(F.from_json(F.get_json_object("json", "$.candidate_urls"), "array<string>")).alias("candidates"), F.get_json_object("json", "$.query_used").alias("query_used")),
        f"select query_id, case when query_id % 5 = 0 then 'draft' else 'deep' end as phase, case when query_id % 2 = 1 then 'no_useful_results' end as error, 24002 as chars, len(candidates) as candidates, message as query_used from {_CANDIDATES}",
    ),
    "syn_05_verify_json": (
        lambda spark, d: Y.verify_json(_verdicts(spark, d), _drafts(spark, d)).select("draft_id", F.get_json_object("json", "$.ok").alias("ok"), F.get_json_object("json", "$.note").alias("note"), F.get_json_object("json", "$.error").alias("error")),
        f"""select draft_id, case when bad = 0 then 'true' else 'false' end as ok, case when n = 0 then 'No numeric claims in the draft.' when bad = 0 then 'Checked ' || n || ' claims; all supported.' else 'Checked ' || n || ' claims; unsupported=' || u || ' conflict=' || c || '.' end as note, case when bad > 0 then 'claims_need_repair' end as error
 from (select d.draft_id, count(v.draft_id) as n, count(*) filter (verdict = 'unsupported') as u, count(*) filter (verdict = 'conflict') as c, count(*) filter (verdict in ('unsupported', 'conflict')) as bad from (select query_id * 1000 + pos as draft_id from {_H}) d left join {VERDICTS} v on v.draft_id = d.draft_id group by d.draft_id)""",
    ),
    "eng_03_deep_boost": (
        lambda spark, d: R.messages(spark, d).select("id", *[c.cast("long").alias(n) for n, c in zip(("pages", "chars"), En.deep_boost((F.col("id") % 20).cast("int"), (F.col("id") % 6).cast("int"), (F.col("id") % 9 * 20_000).cast("int")), strict=True)]),
        f"select id, greatest(id % 20, least(18, id % 20 + 2 * (id % 6))) as pages, least(160000, id % 9 * 20000 + 32000) as chars from {_MSG}",
    ),
    "ops_01_fast_path": (
        lambda spark, d: R.messages(spark, d).select("id", En.is_fast(F.when(F.col("id") % 3 == 0, F.lit("fast")).otherwise(F.lit("deep")), F.col("id") % 2 == 0).alias("fast")),
        f"select id, id % 3 = 0 and id % 2 <> 0 as fast from {_MSG}",
    ),
    "ops_03_skipped": (lambda spark, d: En.skipped(R.queries(spark, d)), f"select query_id, false as found, '' as query_used, '' as synthesized, '' as citations, 0::bigint as total from {_Q}"),
    "ops_05_switches": (
        lambda spark, d: R.messages(spark, d).select("id", B.switched_on(F.get(F.array(*[F.lit(x) for x in (" Off", "0", "no", "yes", "", "1", "FALSE")]), (F.col("id") % 7).cast("int")), False).alias("on")),
        f"""select id, id % 7 in (3, 5) as "on" from {_MSG}""",
    ),
    "chn_03_fallback_chain": (
        lambda spark, d: B.chain(_backend_rows(spark, d)),
        f"select tenant, row_number() over (partition by tenant order by p) - 1 as place, name from (select distinct tenant, name, list_position({sql_list(B.PRIORITY)}, name) as p from {_BACKENDS}) where p > 0",
    ),
    "chn_04_configured": (
        lambda spark, d: _backend_rows(spark, d).groupBy("tenant").agg(F.count_if(B.configured(F.col("key"))).alias("configured")),
        "select c_custkey // 5 % 50 as tenant, count(*) filter (c_custkey % 7 <> 0 and c_custkey % 11 <> 0) as configured from customer group by 1",
    ),
    "enr_02_fetch_cascade": (
        lambda spark, d: En.page_text(_pages_by_way(spark, d)),
        f"""select 'u' || query_id || '/' || pos as url, case when a then trim(enriched_text) when b then trim(snippet) end as text, case when a then 'structured' when b and pos % 3 = 0 then 'scraped' when b then 'http' end as way
 from (select *, pos % 2 = 0 and length(trim(coalesce(enriched_text, ''))) >= 40 and not (length(enriched_text) < 2000 and {_BLOCKED.format("enriched_text")}) as a, length(trim(snippet)) >= 40 and not (length(snippet) < 2000 and {_BLOCKED.format("snippet")}) as b from {_H})""",
    ),
    "eng_01_after_fetch": (_engine(lambda h, q, b, t: En.after_fetch(h.withColumn("enriched_text", F.when(F.col("pos") % 4 == 0, F.col("enriched_text"))), q, t, CFG, b)), None),
    "eng_04_answer": (_engine(lambda h, q, b, t: En.answer(q, b, t, CFG, decisions=q)), None),
    "pln_06_orchestrate": (_engine(lambda h, q, b, t: En.orchestrate(q, b, CFG)), None),
    "pln_10_follow_up": (_engine(lambda h, q, b, t: En.follow_up(h, q, t, b, CFG)), None),
    "pln_11_criticised": (_engine(lambda h, q, b, t: En.criticised(h, q, t, b, CFG)), None),
    "pln_12_cross_check": (_engine(lambda h, q, b, t: En.cross_checked(h, q, b).select("query_id", "pos", "url")), None),
    "enr_01_enrich": (
        _engine(lambda h, q, b, t: En.enrich(h.withColumn("enriched_text", F.lit(None).cast("string")), q, t, q.select("query_id", F.lit(6).alias("pages")), CFG).select("query_id", "pos", F.col("enriched_text").isNotNull().alias("read"))),
        None,
    ),
    "str_09_limited_workers": (
        lambda spark, d: G.worker_schedule(_chain_calls(spark, d).select("query_id", F.col("priority").alias("pos"), "latency"), 2, 35.0),
        f"""with recursive c as (select query_id, priority as pos, latency, row_number() over (partition by query_id order by priority, latency) as n from {_CALLS}),
 r as (select query_id, pos, n, latency as finished, list_sort([0.0::double, latency]) as free from c where n = 1
 union all select c.query_id, c.pos, c.n, r.free[1] + c.latency, list_sort([r.free[2], r.free[1] + c.latency]) from r join c on c.query_id = r.query_id and c.n = r.n + 1) select query_id, pos, round(finished, 6) as finished, finished <= 35 as kept from r""",
    ),
    "str_10_limiter_then_breaker": (lambda spark, d: G.fold(_events(spark, d), G.guarded(3, 86400.0, 2, 172800.0), "allowed"), _guarded_sql()),
    "str_11_sliding_windows": (
        lambda spark, d: W.windowed_counts(R.read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")), ["event_type"], "1 day", "12 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n"),
        f"select strftime(start, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from {_SLIDES} group by 1, 2",
    ),
    "str_11_sessions": (
        lambda spark, d: W.sessions(R.read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")), ["user_id"], "2 days").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n"),
        f"""select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts) + interval 2 days) as stop, count(*) as n from (select *, {_ISLAND} as island from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 days then 0 else 1 end as new from events)) group by user_id, island""",
    ),
    "src_18_cache_lookup": (
        lambda spark, d: Ca.lookup(*_cache_tables(spark, d)).select("id", "stored", "body"),
        f"""select c.event_id as id, case when alive then st end as stored, case when alive then body end as body from (select c.*, p.st, p.body, c.t < p.st + case when p.body::bigint % 2 = 0 then 7200.0 else 86400.0 end as alive
 from (select event_id, user_id as key, epoch_us(ts) / 1e6 as t from events where event_type = 'click') c asof left join {_STORED} p on c.key = p.key and c.t >= p.st) c""",
    ),
}
