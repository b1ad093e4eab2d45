"""Row sets, ranks and evidence, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import numbers as N
from ..functions import text as T
from ..functions.regex import sql_list, sql_text
from ..operators import evidence as E
from ..operators import rowsets as S
from ..sources import relations as R
from .intent_plans import contains_any, has, nouns_sql, places_sql
from .text_plans import PAGE_NUMBERS_SQL, _ISLANDS
from .url_plans import ADJUST, BLOCKED, KEY, PRIMARY, _reason_sql

_H = R.HITS
_Q = R.QUERIES_SQL
_BLANK_KIND = "cast(null as varchar) as kind"


def parts_of(source: str) -> str:
    """source with url and kind, plus the URL's parts."""
    return rf"""(select *, split_part(lower(netloc), ':', 1) as host, replace(lower(netloc), 'www.', '') as bare, replace(netloc, 'www.', '') as domain, lower(path) || '?' || lower(query) as pq
 from (select *, regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) as netloc, regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from {source}))"""


_HK = f"(select *, {_BLANK_KIND} from {_H})"
_MERGE = "case when lower(trim(coalesce(url, ''))) <> '' then lower(trim(url)) else lower(substr(coalesce(snippet, ''), 1, 72) || '|' || source) end"
_BODY = "case when coalesce(enriched_text, '') <> '' then enriched_text else coalesce(snippet, '') end"
SCORE = f"""greatest(0.0, round(relevance + least(0.1 * len(list_filter(regexp_split_to_array(lower(message), '\\s+'), lambda w: length(w) > 3 and contains(lower({_BODY}), w))), 0.4)
 + case when regexp_matches({_BODY}, '\\d[\\d\\.,]+') then 0.15 else 0.0 end + case when coalesce(date, '') <> '' then 0.1 else 0.0 end - case when {contains_any(f"lower({_BODY})", T.NOISE_PHRASES)} then 0.3 else 0.0 end
 + case when trim(coalesce(url, '')) <> '' then {ADJUST} else 0.0 end + case when source = '{S.STRUCTURED_SOURCE}' or starts_with(coalesce(enriched_text, ''), '{S.STRUCTURED_MARK}') then 1.5 else 0.0 end, 6))"""
_KINDS = f"case when {has('message', I.VIDEO)} and {has('message', I.IMAGE)} then 'mixed' when {has('message', I.VIDEO)} then 'video' when {has('message', I.IMAGE)} then 'image' end"


def ranked_sql(kind: str) -> str:
    joined = f"(select h.*, q.message, {kind} as kind from {_H} h join {_Q} q on h.query_id = q.query_id)"
    return f"(select *, row_number() over (partition by query_id order by score desc, pos) as rank from (select *, {SCORE} as score from {parts_of(joined)}))"


_RANKED = ranked_sql("cast(null as varchar)")
_FLOOR = f"(select * from (select *, max(case when least(score, 1.0) >= 0.06 then 1 else 0 end) over (partition by query_id) as any_good from {ranked_sql(_KINDS)}) where case when any_good = 1 then least(score, 1.0) >= 0.06 else rank <= 14 end)"


def _by_query(spark, d):
    return R.hits(spark, d), R.queries(spark, d)


def _synth(spark, d):
    return S.relevance_floor(S.rerank(*_by_query(spark, d), 50, with_media=True))


def _halves(spark, d):
    h = R.hits(spark, d)
    return h.where("pos % 2 = 0"), h.withColumn("query_id", R.within(F.col("query_id"), 20)).where("pos % 3 = 0")


_HALVES = f"(select *, 0 as side from {_H} where pos % 2 = 0 union all select {R.within_sql(20)}, * exclude (query_id), 1 from {_H} where pos % 3 = 0)"
_ELIGIBLE = f"""(select h.* from (select *, row_number() over () as i from {parts_of(_HK)}) h where trim(coalesce(enriched_text, '')) = '' and starts_with(url, 'https://') and not {BLOCKED}
 and exists (select 1 from ({_reason_sql().replace(R.URLS, f"(select query_id * 1000 + pos as id, url from {_H})")}) p where p.id = h.query_id * 1000 + h.pos and p.reason = ''))"""
_TEXT = "concat_ws(chr(10), trim(coalesce(title, '')), trim(coalesce(url, '')), case when trim(coalesce(enriched_text, '')) <> '' then trim(enriched_text) else trim(coalesce(snippet, '')) end)"
_PLACED = "len(list_filter(list_transform(places[1:4], lambda x: lower(x)), lambda x: contains(lower({}), x))) > 0"
ASSESS = f"""(select *, array_to_string(g, ',') as gaps, len(g) >= 2 or len(list_filter(g, lambda x: x <> 'too_few_hosts')) > 0 as thin from (select *, list_filter([case when row_count < 4 then 'too_few_results' end,
 case when enriched_chars < 2500 and snippet_chars < 5000 then 'thin_page_text' end, case when numeric_hits < 3 then 'missing_numbers' end, case when n_places > 0 and place_hits / row_count < 0.35 then 'weak_place_overlap' end,
 case when hosts < 3 then 'too_few_hosts' end], lambda x: x is not null) as g from (select query_id, cast(sum(length(trim(coalesce(enriched_text, '')))) as bigint) as enriched_chars,
 cast(sum(case when trim(coalesce(enriched_text, '')) = '' then length(trim(coalesce(snippet, ''))) else 0 end) as bigint) as snippet_chars,
 cast(sum(len(regexp_extract_all(substr({_TEXT}, 1, 12000), {sql_text("(?i)" + N.MENTION)}))) as bigint) as numeric_hits, cast(count(*) filter ({_PLACED.format(_TEXT)}) as bigint) as place_hits,
 count(distinct nullif(bare, '')) as hosts, count(*) as row_count, count(*) filter (trim(coalesce(enriched_text, '')) <> '') as enriched_rows, max(len(places[1:4])) as n_places
 from (select h.*, q.places from {parts_of(_HK)} h join {places_sql(_Q)} q on h.query_id = q.query_id) group by query_id)))"""
_NUMS = f"(select query_id, pos, v from (select query_id, pos, {PAGE_NUMBERS_SQL} as v from {_H} where trim(coalesce(enriched_text, '')) <> '') where len(v) > 0)"
_X = f"(select query_id, pos, unnest(v[1:16]) as x from {_NUMS})"
CONFLICT = f"""(select q.query_id, coalesce(p.pages, 0) > 0 as has_numbers, coalesce(p.pages, 0) >= 2 and s.query_id is null as conflict from (select distinct query_id from {_H}) q
 left join (select query_id, count(*) as pages from {_NUMS} group by query_id) p on p.query_id = q.query_id
 left join (select distinct a.query_id from {_X} a join {_X} b on a.query_id = b.query_id and a.pos < b.pos and (abs(a.x - b.x) <= 1.0 or abs(a.x - b.x) / greatest(abs(a.x), abs(b.x), 1e-9) <= 0.08)) s on s.query_id = q.query_id)"""
_READY = f"""(select a.query_id, case when n = 0 then 'no_enriched' when conflict then 'numeric_conflict' when not place_ok then 'weak_place' when depth = 'fast' and n >= 2 and (has_numbers or chars >= 600) then 'fast_multi_agree'
 when depth = 'fast' and has_numbers and (asked < 100 or chars >= 400) then 'fast_single_solid' when depth = 'fast' then 'fast_need_more' when thin then 'deep_thin:' || array_to_string(g[1:4], ',') when n < 3 then 'deep_need_hosts' else 'deep_sufficient' end as reason
 from (select query_id, max(case when query_id % 3 = 0 and length(trim(message)) < 160 and not {has("trim(message)", I.RESEARCH_SHAPE)} then 'fast' else 'deep' end) as depth, count(*) filter (body <> '') as n, sum(length(body)) as chars, max(length(trim(message))) as asked,
 bool_or(len(places[1:4]) = 0 or (body <> '' and {_PLACED.format("concat_ws(chr(10), coalesce(title, ''), coalesce(url, ''), substr(body, 1, 4000))")})) as place_ok
 from (select h.*, trim(coalesce(enriched_text, '')) as body, q.message, q.places from {_H} h join {places_sql(_Q)} q on h.query_id = q.query_id) group by query_id) a
 join {CONFLICT} c on a.query_id = c.query_id join {ASSESS} e on a.query_id = e.query_id)"""
_FRONT = "lower(concat_ws(chr(10), coalesce(title, ''), coalesce(url, ''), coalesce(snippet, '')))"
_PLACE_ROWS = f"""(select *, case when infront and n_hits > 0 then 1 else 0 end as p_hit from (select h.query_id, pos, relevance, len(places) = 0 and len(nouns) = 0 as idle, len(places[1:4]) = 0 or {_PLACED.format(_FRONT)} as infront,
 case when len(nouns) = 0 then 1 else len(list_filter(nouns[1:8], lambda n: contains({_FRONT} || chr(10) || lower(substr(coalesce(enriched_text, ''), 1, 4000)), n))) end as n_hits from {_H} h join {nouns_sql(_Q)} q on h.query_id = q.query_id))"""
_SEEN = "concat_ws(' ', coalesce(title, ''), coalesce(url, ''), coalesce(snippet, ''))"
_CURRENT = f"({has('message', I.WEATHER)} or {has('message', I.FX)} or ({has('message', I.SPOT)} and ({has('message', I.NOW)} or length(message) < 80)) or ({has('message', I.NOW)} and length(message) < 120))"
_STALE = f"(({has('message', I.WEATHER)} and {has(_SEEN, I.STALE_WEATHER)}) or ({has('message', I.FX)} and {has(_SEEN, I.STALE_FX)}))"
_TOKENS = f"(select doc_id, lower(unnest(w)) as w, generate_subscripts(w, 1) as spot from (select doc_id, list_filter(regexp_extract_all(text, '{T.TOKEN}'), lambda x: length(x) >= 4) as w from documents))"
RATIO = f"""(select d.doc_id, coalesce(round(case when total < 40 then 0.0 else coalesce(case when glue then b else a end, 0) / total end, 6), 0.0) as ratio from documents d left join (
 select doc_id, max(total) as total, max(case when rank = 1 then n end) as a, max(case when rank = 2 then n end) as b, bool_or(rank = 1 and list_contains({sql_list(T.GLUE_WORDS)}, w)) as glue from (
 select *, row_number() over (partition by doc_id order by n desc, spot) as rank, sum(n) over (partition by doc_id) as total from (select doc_id, w, count(*) as n, min(spot) as spot from {_TOKENS} group by doc_id, w)) where rank <= 2 group by doc_id) r on d.doc_id = r.doc_id)"""
GRAMS = f"""(select doc_id, round(count(distinct gram) / count(gram), 6) as diversity from (select doc_id, array_to_string(w[i:i + 4], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 3, 3)) as i
 from (select doc_id, regexp_extract_all(lower(trim(text)), '{T.TOKEN}') as w from documents where length(trim(text)) >= 1200) where len(w) >= 80)) group by doc_id)"""


def _wanted(spark, d):
    return R.urls(spark, d).where("id % 5 = 1").select(R.query_of(F.floor(F.col("id") / 2)).cast("long").alias("query_id"), F.col("id").alias("ord"), "url")


def _part_prices(spark, d):
    p = R.read(spark, d, "part")
    return p.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 50 == 0, F.col("p_retailprice") * 20).otherwise(F.col("p_retailprice")).alias("price"))


PLANS = {
    "set_01_merge_rows": (
        lambda spark, d: S.merge_rows(*_halves(spark, d)).select("query_id", "side", "pos", "url"),
        f"select query_id, side, pos, url from (select *, row_number() over (partition by query_id, {_MERGE} order by side, pos) as n from {_HALVES}) where n = 1",
    ),
    "set_02_merge_agents": (
        lambda spark, d: S.merge_agents(R.hits(spark, d).withColumn("agent", F.col("pos") % 3).withColumn("role", F.concat(F.lit("r"), F.col("agent"))).withColumn("query_id", R.within(F.col("query_id"), 8)).withColumn("url", F.when(F.col("pos") % 5 != 0, F.col("url")))).select("query_id", "agent", "pos", "url", "snippet"),
        f"""select query_id, agent, pos, url, '[agent:r' || agent || '] ' || coalesce(snippet, '') as snippet from (select *, row_number() over (partition by query_id, case when k = '' then 'row ' || i else k end order by agent, pos, snippet) as n
 from (select *, row_number() over () as i, lower(regexp_replace(split_part(trim(coalesce(url, '')), '#', 1), '/+$', '')) as k from (select {R.within_sql(8)} as query_id, pos % 3 as agent, pos, case when pos % 5 <> 0 then url end as url, snippet from {_H}))) where n = 1""",
    ),
    "set_03_first_of_domain": (
        lambda spark, d: S.first_of_domain(R.hits(spark, d), True).select("query_id", "pos", "url"),
        f"select query_id, pos, url from (select *, row_number() over (partition by query_id, domain order by pos) as n from {parts_of(_HK)}) where n = 1",
    ),
    "set_04_facts_first": (
        lambda spark, d: S.with_facts(R.hits(spark, d), R.hits(spark, d).where("pos = 0").withColumn("url", F.lit("https://github.com/Owner/Name"))).select("query_id", "side", "pos", "url"),
        f"""select query_id, side, pos, url from (select *, row_number() over (partition by query_id, case when k = '' then 'row ' || side || pos else k end order by side, pos) as n from (select *, case when contains(regexp_extract(u, '^(?:[a-z][a-z0-9+.]*:)?//([^/?#]*)', 1), 'github.com') and len(parts) >= 2 then 'github.com/' || parts[1] || '/' || parts[2] else u end as k
 from (select *, list_filter(string_split(regexp_extract(u, '^(?:(?:[a-z][a-z0-9+.]*:)?//[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') as parts from (select *, lower(regexp_replace(split_part(url, '#', 1), '/+$', '')) as u from (select query_id, 1 as side, pos, url from {_H} union all select query_id, 0, pos, 'https://github.com/Owner/Name' from {_H} where pos = 0))))) where n = 1""",
    ),
    "set_06_ensure_urls": (
        lambda spark, d: S.ensure_urls(R.hits(spark, d), _wanted(spark, d)).select("query_id", "pos", "url", "source", "relevance"),
        f"""select query_id, pos, url, source, relevance from {_H} union all select query_id, -ord - 1, url, 'enrich_allowlist', 1.1::double from (select *, row_number() over (partition by query_id, key order by ord) as n from (select id // 2 // {R.BLOCK} * {R.N_QUERIES} + id // 2 % {R.N_QUERIES} as query_id, id as ord, trim(url) as url, {KEY} as key from {R.URLS} where id % 5 = 1 and starts_with(trim(url), 'https://')))
 where n = 1 and not exists (select 1 from (select query_id as hq, {KEY} as hk from {_H}) where hq = query_id and hk = key)""",
    ),
    "set_07_new_urls": (
        lambda spark, d: S.new_urls(R.hits(spark, d).where("pos < 3"), R.hits(spark, d)),
        f"select query_id, count(*) as new_urls from (select distinct query_id, url from {_H} where url <> '' except select query_id, url from {_H} where pos < 3) group by query_id",
    ),
    "set_08_demote_stale": (
        lambda spark, d: S.demote_stale(*_by_query(spark, d)),
        f"select query_id, pos, row_number() over (partition by query_id order by case when not {_CURRENT} then 0 when {_STALE} then 2 when {has(_SEEN, I.LIVE)} then 0 else 1 end, pos) as rank from (select h.*, q.message from {_H} h join {_Q} q on h.query_id = q.query_id)",
    ),
    "set_09_place_relevant": (
        lambda spark, d: S.place_relevant(*_by_query(spark, d)),
        f"""select query_id, pos, case when idle then pos + 1 else rank end as rank from (select *, row_number() over (partition by query_id order by p_hit desc, n_hits desc, relevance desc, pos) as rank, sum(p_hit) over (partition by query_id) as matched from {_PLACE_ROWS})
 where idle or case when matched > 0 then p_hit = 1 else rank <= 8 end""",
    ),
    "set_10_strict_articles": (
        lambda spark, d: R.hits(spark, d).where((F.trim(F.coalesce("enriched_text", F.lit(""))) != "") & F.startswith("url", F.lit("https://"))).select("query_id", "pos", "url"),
        f"select query_id, pos, url from {_H} where trim(coalesce(enriched_text, '')) <> '' and starts_with(url, 'https://')",
    ),
    "set_11_eligible_pages": (lambda spark, d: S.eligible_pages(R.hits(spark, d)).select("query_id", "pos", "url"), f"select query_id, pos, url from {_ELIGIBLE}"),
    "set_12_relevance_floor": (lambda spark, d: _synth(spark, d).select("query_id", "pos", "rank"), f"select query_id, pos, rank from {_FLOOR}"),
    "set_13_citations": (
        lambda spark, d: S.ordered_distinct(_synth(spark, d).where(F.trim("url").rlike("^https?://")), F.trim("url"), 48, "citations"),
        f"select query_id, array_to_string((list(url order by rank))[1:48], ' | ') as citations from (select query_id, trim(url) as url, min(rank) as rank from {_FLOOR} where regexp_matches(trim(url), '^https?://') group by query_id, trim(url)) group by query_id",
    ),
    "rnk_01_score": (
        lambda spark, d: S.rerank(*_by_query(spark, d), 1000).select("query_id", "pos", "score", F.least("score", F.lit(1.0)).alias("relevance")),
        f"select query_id, pos, score, least(score, 1.0) as relevance from {_RANKED}",
    ),
    "rnk_03_rerank_top": (lambda spark, d: S.rerank(*_by_query(spark, d), 5).select("query_id", "pos", "rank", "url", "score"), f"select query_id, pos, rank, url, score from {_RANKED} where rank <= 5"),
    "rnk_05_media_order": (lambda spark, d: S.rerank(*_by_query(spark, d), 50, with_media=True).select("query_id", "pos", "rank"), f"select query_id, pos, rank from {ranked_sql(_KINDS)} where rank <= 50"),
    "rnk_06_research_picks": (
        lambda spark, d: S.research_picks(R.hits(spark, d)),
        f"""select query_id, row_number() over (partition by query_id order by n) as pick, url from (select *, row_number() over (partition by query_id, url order by n) as again from (select *, row_number() over (partition by query_id order by prim desc, adj desc, relevance desc, pos) as n
 from (select *, {PRIMARY}::int as prim, {ADJUST} as adj from {parts_of(_HK)} where starts_with(url, 'https://') and not {BLOCKED})) where (n = 1 and prim = 1) or adj >= -0.5) where again = 1 qualify pick <= 5""",
    ),
    "url_15_entry_urls": (
        lambda spark, d: S.entry_urls(R.hits(spark, d), F.lit(None).cast("string")).select("query_id", "rank", "url"),
        None,
    ),
    "agg_01_assess_evidence": (
        lambda spark, d: E.assess(*_by_query(spark, d)),
        f"select query_id, enriched_chars, snippet_chars, numeric_hits, place_hits, hosts, row_count, enriched_rows, gaps, thin from {ASSESS}",
    ),
    "agg_03_numeric_conflict": (lambda spark, d: E.conflicts(R.hits(spark, d)), f"select query_id, has_numbers, conflict from {CONFLICT}"),
    "agg_04_answer_ready": (
        lambda spark, d: E.answer_ready(*_by_query(spark, d), F.when(F.col("query_id") % 3 == 0, F.lit("fast")).otherwise(F.lit("deep"))),
        f"select query_id, reason in ('fast_multi_agree', 'fast_single_solid', 'deep_sufficient') as ready, reason from {_READY}",
    ),
    "agg_05_repetition_ratio": (lambda spark, d: E.repetition_ratio(R.read(spark, d, "documents").select("doc_id", "text"), "doc_id"), f"select doc_id, ratio from {RATIO}"),
    "agg_06_gram_diversity": (
        lambda spark, d: E.gram_diversity(E.long_enough(R.read(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "diversity"),
        f"select doc_id, diversity from {GRAMS}",
    ),
    "agg_07_answer_quality": (
        lambda spark, d: E.answer_quality(R.read(spark, d, "documents").select("doc_id", "text"), "doc_id"),
        rf"""select doc_id, reasons, reasons = '' as ok from (select d.doc_id, case when trim(text) = '' then 'empty' else array_to_string(list_filter([case when length(trim(text)) >= 80 and coalesce(i.run, 0) >= 8 then 'phrase_loop' end, case when r.ratio >= 0.22 then 'token_repetition' end,
 case when length(text) >= 200 and (regexp_matches(right(rtrim(text), 400), '(?:\.{{3,}}|……){{2,}}') or regexp_matches(right(rtrim(text), 400), '\.{{6,}}\s*$')) then 'ellipsis_collapse' end, case when g.diversity < 0.35 then 'low_ngram_diversity' end], lambda x: x is not null), ',') end as reasons
 from documents d join {RATIO} r on d.doc_id = r.doc_id left join {GRAMS} g on d.doc_id = g.doc_id left join {_ISLANDS} i on i.doc_id = d.doc_id)""",
    ),
    "agg_08_enrich_budget": (
        lambda spark, d: E.enrich_budget(R.hits(spark, d)),
        rf"""select query_id, cast(least(14, 4 + case when m < 95 then 2 else 0 end + case when len(v) >= 4 and (list_max(v) - list_min(v)) / list_avg(v) > 0.035 then 1 else 0 end) as bigint) as budget from (select query_id, median(nullif(length(trim(snippet)), 0)) as m, flatten(list(case when n <= 3 then v else [] end)) as v from (
 select *, list_transform(list_filter(list_transform(regexp_extract_all(trim(snippet), '\d[\d\.,]*'), lambda x: replace(x, ',', '.')), lambda x: regexp_matches(x, '^\d+\.?\d*$')), lambda x: x::double) as v, row_number() over (partition by query_id order by pos) as n from {_H}) where n <= 5 group by query_id)""",
    ),
    "agg_09_outliers": (
        lambda spark, d: E.outliers(_part_prices(spark, d), "p_brand", "price").select("p_partkey", "outlier"),
        "select p_partkey, coalesce(n >= 4 and price > 0 and mid > 0 and (price / mid >= 10 or mid / price >= 10), false) as outlier from (select *, count(*) over w as n, list_extract(list_sort(list(price) over w), cast(floor(count(*) over w / 2) as bigint) + 1) as mid from (select p_partkey, p_brand, case when p_partkey % 50 = 0 then p_retailprice * 20 else p_retailprice end as price from part) window w as (partition by p_brand))",
    ),
    "win_01_waves": (
        lambda spark, d: E.waves(S.eligible_pages(R.hits(spark, d))).select("query_id", "pos", "wave"),
        f"select query_id, pos, (n - 1) // 2 as wave from (select *, row_number() over (partition by query_id order by pos) as n from {_ELIGIBLE}) where n <= 6",
    ),
    "join_01_page_text": (
        lambda spark, d: R.hits(spark, d).select("query_id", "pos", "url").join(R.read(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")), "url", "left"),
        f"select h.query_id, h.pos, h.url, p.page_id from {_H} h left join (select url, min(page_id) as page_id from pages group by url) p on h.url = p.url",
    ),
}
