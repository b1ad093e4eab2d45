"""Claims, providers, guards and chains, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.regex import re2, sql_text
from ..functions.text import DATE_PATTERNS
from ..operators import claims as C
from ..operators import guards as G
from ..operators import rowsets as S
from ..sources import providers as P
from ..sources import relations as R
from .rowset_plans import _HK, parts_of
from .text_plans import _C, CLAIMS_SQL, claim_value_sql
from .url_plans import PRIMARY

_H = R.HITS


def _drafts(spark, d):
    return R.hits(spark, d).select((F.col("query_id") * 1000 + F.col("pos")).alias("draft_id"), "query_id", F.col("snippet").alias("text"))


def _evidence(spark, d):
    return R.hits(spark, d).where("enriched_text is not null").select("query_id", "pos", "url", F.col("enriched_text").alias("text"))


def _near(rel: str, tolerance: str) -> str:
    return f"(abs(value - x) <= {tolerance} or abs(value - x) / greatest(abs(value), abs(x), 1.0) <= {rel})"


_MATCH, _NEAR = _near("0.08", "0.5"), _near("0.25", "greatest(1.0, value * 0.05)")
_EV = f"(select query_id, prim, enriched_text as text from (select *, {PRIMARY} as prim from {parts_of(_HK)}) where enriched_text is not null)"
_EV_NUMBERS = f"(select * from (select query_id, prim, {claim_value_sql('raw')} as x from (select query_id, prim, unnest(regexp_extract_all(text, {_C}, 0)) as raw from {_EV})) where x is not null)"
_CLAIMS = f"(select id as draft_id, id // 1000 as query_id, n, raw, value, kind from {CLAIMS_SQL} where origin = 'hit' and n < 24)"
_WORDS = r"(select query_id, string_agg(regexp_replace(lower(text), '\s+', '', 'g'), ' ') as words from " + _EV + " group by query_id)"
VERDICTS = rf"""(select c.draft_id, c.n, c.raw, c.value, c.kind, case when c.value is null then case when literal then 'supported' else 'unverified' end
 when coalesce(h.has_primary, false) then case when coalesce(p_match, false) then 'supported' when coalesce(p_near, false) or coalesce(any_match, false) or literal then 'conflict' else 'unsupported' end
 when literal or coalesce(any_match, false) then 'supported' when coalesce(n_near, 0) >= 2 then 'conflict' else 'unsupported' end as verdict
 from (select c.*, coalesce(contains(w.words, regexp_replace(lower(raw), '\s+', '', 'g')), false) as literal from {_CLAIMS} c left join {_WORDS} w on c.query_id = w.query_id) c
 left join (select query_id, bool_or(prim) as has_primary from {_EV_NUMBERS} group by query_id) h on h.query_id = c.query_id
 left join (select draft_id, n, bool_or(prim and {_MATCH}) as p_match, bool_or(prim and {_NEAR}) as p_near, bool_or({_MATCH}) as any_match, count(*) filter ({_NEAR}) as n_near from {_CLAIMS} c join {_EV_NUMBERS} e on c.query_id = e.query_id where value is not null group by draft_id, n) f on f.draft_id = c.draft_id and f.n = c.n)"""


def _events(spark, d):
    e = R.read(spark, d, "events")
    outcome = F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_type") == "view", F.lit("empty")).otherwise(F.lit("ok"))
    return e.select(F.col("user_id").alias("key"), G.seconds(F.col("ts")).alias("t"), "event_id", outcome.alias("outcome"), "event_type")


def _guard(guard, name, outcome="outcome"):
    return lambda spark, d: G.fold(_events(spark, d).withColumn("outcome", F.col(outcome)), guard, name)


#: Events of each user in order, numbered.
_E = """e as (select user_id as key, epoch_us(ts) / 1e6 as t, event_id, event_type, case event_type when 'error' then 'error' when 'view' then 'empty' else 'ok' end as outcome,
 row_number() over (partition by user_id order by ts, event_id) as n from events)"""


def folded(start: str, step: str, name: str, decide: str) -> str:
    """A recursive fold: start gives the first state, step the next, decide the decision on the state before."""
    return f"""with recursive {_E}, r as (select key, n, event_id, {decide.format(**{"s": start})} as {name}, {step.format(s=start)} as s from e where n = 1
 union all select e.key, e.n, e.event_id, {decide.format(s="r.s")}, {step.format(s="r.s")} from r join e on e.key = r.key and e.n = r.n + 1) select key, event_id, {name} from r"""


_DAY = 86400.0
_HITS = "list_filter({s}, lambda x: x >= e.t - 86400.0)"
_LIMIT_OK = f"len({_HITS}) < 3"
_LIMIT_STEP = f"case when {_LIMIT_OK} then list_append({_HITS}, e.t) else {_HITS} end"
_TRIP_OK = "e.t >= {s}[2]"
_TRIP_STEP = "case when e.t < {s}[2] or e.outcome = 'empty' then {s} when e.outcome = 'ok' then [0.0, {s}[2]] when {s}[1] + 1 >= 2 then [0.0, e.t + 172800.0] else [{s}[1] + 1, {s}[2]] end"
_TTL = {"purchase": 7200.0, "click": 14400.0}


def _chain_calls(spark, d):
    e = R.read(spark, d, "events")
    return e.select((F.floor(F.col("event_id") / 4)).alias("query_id"), (F.col("event_id") % 4).alias("priority"), F.round("value", 4).alias("latency"), F.col("event_type").isin("click", "purchase").alias("ok"))


_CALLS = "(select event_id // 4 as query_id, event_id % 4 as priority, round(value, 4) as latency, event_type in ('click', 'purchase') as ok from events)"
_HEDGE = f"""(select query_id, max(case when ok0 then l0 else greatest(l0, coalesce(first_ok, last)) end) as wall, min(case when ok0 then 0 when ok and priority > 0 and done <= greatest(l0, coalesce(first_ok, last)) then priority end) as winner
 from (select *, min(case when ok then done end) over (partition by query_id) as first_ok, max(done) over (partition by query_id) as last from (select c.*, z.latency as l0, z.ok as ok0, case when c.priority > 0 then least(z.latency, 20.0) + c.latency end as done from {_CALLS} c join {_CALLS} z on c.query_id = z.query_id and z.priority = 0)) group by query_id)"""


def _responses(spark, d, provider, fields, wrap):
    rows = R.hits(spark, d).withColumn("query_id", R.within(F.col("query_id"), 10))  # a body holds 200 hits at most
    item = F.struct(*[e.alias(n) for n, e in fields(F.col).items()])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((F.col("pos") * 1000 + F.length("url")).alias("o"), "url", "snippet", item.alias("item")))), lambda s: s["item"])
    return P.parse(rows.groupBy("query_id").agg(F.to_json(wrap(in_order)).alias("body")), provider)


_SRC = f"(select *, row_number() over (partition by query_id order by o, url, snippet) - 1 as i from (select * replace ({R.within_sql(10)} as query_id), pos * 1000 + length(url) as o from {parts_of(_HK)}))"


def parsed_sql(min_chars: int, key: str, place: str, step: float, date: str, title: str, source: str, own: str = "null", cut: str = "substr({}, 1, 2000)") -> str:
    clean = r"trim(regexp_replace(trim(snippet), '\s+', ' ', 'g'))"
    return f"""select query_id, acc as pos, {title} as title, trim(url) as url, {cut.format(clean)} as snippet, {date} as date, {source} as source, round(greatest(0.0, least(1.0, coalesce({own}, 1.0 - {place} * {step}))), 6)::double as relevance
 from (select *, row_number() over (partition by query_id order by i) - 1 as acc from (select *, row_number() over (partition by query_id, {key} order by i) as again from {_SRC} where length(trim(snippet)) >= {min_chars}) where again = 1) where acc < 10"""


_OWN_KEY = "case when domain <> '' then domain else ' ' || i end"
_TITLE = "case when trim(title) <> '' then trim(title) when domain <> '' then domain else 'result' end"
_DATES = "coalesce(" + ", ".join(f"nullif(regexp_extract(trim(snippet), {sql_text(re2(p))}, 1), '')" for p in DATE_PATTERNS) + ")"
_none = "cast(null as varchar)"

PLANS = {
    "clm_09_verify_claims": (lambda spark, d: C.verify(_drafts(spark, d), _evidence(spark, d)), f"select draft_id, n, raw, value, kind, verdict from {VERDICTS}"),
    "clm_12_report": (
        lambda spark, d: C.report(C.verify(_drafts(spark, d), _evidence(spark, d))),
        f"""select draft_id, count(*) as claims, count(*) filter (verdict = 'supported') as supported, count(*) filter (verdict = 'unsupported') as unsupported, count(*) filter (verdict = 'conflict') as conflicts,
 count(*) filter (verdict in ('unsupported', 'conflict')) = 0 as ok from {VERDICTS} group by draft_id""",
    ),
    "clm_08_citations": (
        lambda spark, d: C.citations_ok(R.hits(spark, d).select((F.col("query_id") * 1000 + F.col("pos")).alias("id"), "query_id", F.col("snippet").alias("text")), R.hits(spark, d).select((F.col("query_id") + 1).alias("query_id"), "url")),
        f"""select a.id, coalesce(bool_or(contains(a.text, u.u) or (u.h <> '' and (contains(lower(a.text), u.h) or list_contains(list_transform(regexp_extract_all(a.text, '(?i)https?://[^\\s)\\]"''>]+'), lambda x: replace(lower(regexp_extract(x, '//([^/?#]*)', 1)), 'www.', '')), u.h)))), false) as ok
 from (select query_id * 1000 + pos as id, query_id, snippet as text from {_H}) a left join (select query_id + 1 as query_id, trim(url) as u, bare as h from {parts_of(_HK)}) u on a.query_id = u.query_id group by a.id""",
    ),
    "join_08_star_facts": (
        lambda spark, d: C.star_verdicts(R.read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(0).alias("n"), F.col("o_custkey").cast("double").alias("value")), R.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("stars"))),
        "select query_id, 0 as n, bool_or(abs(value - stars) <= greatest(5.0, stars * 0.005) or abs(value - stars) / greatest(value, stars, 1.0) <= 0.02) as supported from (select o_orderkey as query_id, o_custkey as value, l_suppkey as stars from orders join lineitem on o_orderkey = l_orderkey) group by query_id",
    ),
    "str_01_limiter": (_guard(G.limiter(3, _DAY), "admitted"), folded("cast([] as double[])", _LIMIT_STEP, "admitted", _LIMIT_OK)),
    "str_02_breaker": (_guard(G.breaker(2, 172800.0), "allowed"), folded("[0.0, -1e18]", _TRIP_STEP, "allowed", _TRIP_OK)),
    "str_03_budget": (
        lambda spark, d: G.within_budget(_events(spark, d).withColumn("useful", F.col("outcome") == "ok"), 16),
        "select key, event_id, coalesce(sum((outcome = 'ok')::int) over (partition by key order by n rows between unbounded preceding and 1 preceding), 0) < 16 as admitted from (with " + _E + " select * from e)",
    ),
    "str_04_cooldown": (
        lambda spark, d: G.fold(_events(spark, d).withColumn("outcome", F.col("event_type")).withColumn("t", F.row_number().over(S.Window.partitionBy("key").orderBy("t", "event_id")).cast("double")), G.cooldown(4), "suppressed"),
        folded("['', '-1000000000']", "case when e.event_type = {s}[1] and e.n - {s}[2]::bigint < 4 then {s} else [e.event_type, e.n::varchar] end", "suppressed", "e.event_type = {s}[1] and e.n - {s}[2]::bigint < 4"),
    ),
    "str_05_ttl_cache": (
        _guard(G.ttl_cache(_TTL, 28800.0), "hit", "event_type"),
        folded("-1e18::double", "case when e.t < {s} then {s} else e.t + case e.event_type when 'purchase' then 7200.0 when 'click' then 14400.0 else 28800.0 end end", "hit", "e.t < {s}"),
    ),
    "str_06_cache_key": (
        lambda spark, d: R.messages(spark, d).select("id", F.substring(F.sha2(F.concat_ws("|", F.lit("v1"), F.lower(F.substring("message", 1, 80)), F.lit("lang_en"), F.lit("m3"), F.lit("12")), 256), 1, 40).alias("cache_key"), F.greatest(F.lit(30), F.least(F.lit(240), F.when(F.col("id") % 2 == 0, F.lit(120)).otherwise(F.lit(300)))).cast("long").alias("ttl")),
        f"select id, substr(sha256('v1|' || lower(substr(message, 1, 80)) || '|lang_en|m3|12'), 1, 40) as cache_key, cast(greatest(30, least(240, case when id % 2 = 0 then 120 else 300 end)) as bigint) as ttl from {R.MESSAGES_SQL}",
    ),
    "str_07_serial_chain": (
        lambda spark, d: G.serial_chain(_chain_calls(spark, d)),
        f"select query_id, max(w) as winner, round(sum(latency), 6) as wall from (select *, min(case when ok then priority end) over (partition by query_id) as w from {_CALLS}) where w is null or priority <= w group by query_id",
    ),
    "str_08_hedged_chain": (lambda spark, d: G.hedged_chain(_chain_calls(spark, d), 20.0), f"select query_id, winner, round(wall, 6) as wall from {_HEDGE}"),
    "str_09_deadline": (
        lambda spark, d: _chain_calls(spark, d).where("ok and latency <= 35").groupBy("query_id").agg(F.count("*").alias("kept")),
        f"select query_id, count(*) as kept from {_CALLS} where ok and latency <= 35 group by query_id",
    ),
    "str_10_limiter_and_breaker": (_guard(G.guarded(3, _DAY, 2, 172800.0), "allowed"), None),
    "str_11_event_windows": (
        lambda spark, d: R.read(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n"),
        "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
    ),
    "rnk_07_first_provider": (
        lambda spark, d: _chain_calls(spark, d).where("ok").groupBy("query_id").agg(F.min_by("latency", "priority").alias("latency")),
        f"select query_id, arg_min(latency, priority) as latency from {_CALLS} where ok group by query_id",
    ),
    "rnk_08_percentile": (
        lambda spark, d: G.percentile(_chain_calls(spark, d), "priority", "latency", 0.95),
        f"select priority, list_extract(v, cast(round_even(0.95 * (len(v) - 1), 0) as bigint) + 1) as p from (select priority, list_sort(list(latency)) as v from {_CALLS} group by priority)",
    ),
    "agg_13_backend_counters": (
        lambda spark, d: _events(spark, d).groupBy((F.col("key") % 4).alias("backend")).agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "ok").alias("successes")),
        "select user_id % 4 as backend, count(*) as calls, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type not in ('error', 'view')) as successes from events group by 1",
    ),
    "agg_14_availability": (
        lambda spark, d: _chain_calls(spark, d).groupBy("query_id").agg(*[F.max((F.col("ok") & (F.col("priority") < k)).cast("int")).alias(f"k{k}") for k in (1, 2, 3, 4)]).agg(*[F.round(100 * F.avg(f"k{k}"), 6).alias(f"available_{k}") for k in (1, 2, 3, 4)]),
        "select " + ", ".join(f"round(100 * avg(k{k}), 6) as available_{k}" for k in (1, 2, 3, 4)) + " from (select query_id, " + ", ".join(f"max((ok and priority < {k})::int) as k{k}" for k in (1, 2, 3, 4)) + f" from {_CALLS} group by query_id)",
    ),
    "src_19_metrics_text": (
        lambda spark, d: _events(spark, d).groupBy("event_type").count().select(F.concat(F.lit('web_search_events_total{type="'), "event_type", F.lit('"} '), F.col("count")).alias("line")),
        """select 'web_search_events_total{type="' || event_type || '"} ' || count(*) as line from events group by event_type""",
    ),
    "src_02_serper": (
        lambda spark, d: _responses(spark, d, P.SERPER, lambda c: dict(link=c("url"), title=c("title"), snippet=c("snippet"), date=c("date")), lambda a: F.struct(a.alias("organic"))),
        parsed_sql(20, _OWN_KEY, "i", 0.08, "date", _TITLE, "case when domain <> '' then domain else 'serper' end"),
    ),
    "src_04_brave": (
        lambda spark, d: _responses(spark, d, P.BRAVE, lambda c: dict(url=c("url"), title=c("title"), description=c("snippet")), lambda a: F.struct(F.struct(a.alias("results")).alias("web"))),
        parsed_sql(20, _OWN_KEY, "i", 0.08, _none, _TITLE, "case when domain <> '' then domain else 'brave' end"),
    ),
    "src_05_bing": (
        lambda spark, d: _responses(spark, d, P.BING, lambda c: dict(url=c("url"), name=c("title"), snippet=c("snippet"), datePublished=c("date")), lambda a: F.struct(F.struct(a.alias("value")).alias("webPages"))),
        parsed_sql(0, _OWN_KEY, "acc", 0.1, "date", _TITLE, "domain", cut="{}"),
    ),
    "src_06_tavily": (
        lambda spark, d: _responses(spark, d, P.TAVILY, lambda c: dict(url=c("url"), title=c("title"), content=c("snippet"), score=F.when(c("pos") % 2 == 0, c("relevance") * 1.5)), lambda a: F.struct(a.alias("results"))),
        parsed_sql(20, "domain", "i", 0.08, _none, _TITLE, "case when domain <> '' then domain else 'tavily' end", own="case when source_pos % 2 = 0 then relevance * 1.5 end").replace(_SRC, _SRC.replace("pos * 1000", "pos as source_pos, pos * 1000")),
    ),
    "src_07_google_cse": (
        lambda spark, d: _responses(spark, d, P.CSE, lambda c: dict(link=c("url"), title=c("title"), snippet=c("snippet")), lambda a: F.struct(a.alias("items"))),
        parsed_sql(0, "domain", "acc", 0.1, _DATES, "trim(title)", "domain", cut="{}"),
    ),
}
