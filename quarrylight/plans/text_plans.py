"""Text, HTML and numbers, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.regex import re2, sql_list, sql_text
from ..sources import relations as R
from .intent_plans import collapse, contains_any

_H = R.HITS


def _pages(cols):
    return lambda spark, d: R.read(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in cols(F.col("html")).items()])


def _docs(cols):
    return lambda spark, d: R.read(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in cols(F.col("text")).items()])


def _hits(cols):
    return lambda spark, d: R.hits(spark, d).select("query_id", "pos", *[c.alias(n) for n, c in cols(F.col).items()])


def head_tail_sql(x: str, limit: int) -> str:
    budget = limit - len(T.GAP_MARK)
    head = budget // 2
    mark = " || ".join("chr(10)" if c == "\n" else sql_text(c) for c in ("\n", T.GAP_MARK.strip("\n"), "\n"))
    return f"case when length({x}) <= {limit} then {x} else substr({x}, 1, {head}) || {mark} || right({x}, {budget - head}) end"


def clean_sql(x: str, limit: int) -> str:
    s = collapse(rf"regexp_replace(trim(coalesce({x}, '')), '(http://\S{{0,113}}|https://\S{{0,112}})\S*', '\1', 'g')")
    return f"case when {contains_any(f'lower({s})', T.SPAM_FRAGMENTS)} then '' else substr({s}, 1, {limit}) end"


_CHROME = r"(trim(x) = '' or regexp_matches(trim(x), '^[\s\-|:=]+$') or not regexp_matches(trim(x), '[A-Za-zА-Яа-яЁёӘәІіҢңҒғҮүҰұҚқӨөҺһ0-9]'))"
_ISLANDS = r"""(select doc_id, max(n) as run from (select doc_id, tok, count(*) as n from (select *, pos - row_number() over (partition by doc_id, tok order by pos) as island from
 (select doc_id, lower(unnest(toks)) as tok, generate_subscripts(toks, 1) as pos from (select doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: true) as toks from documents))) where length(tok) between 4 and 40 group by doc_id, tok, island) group by doc_id)"""


def parse_sql(x: str) -> str:
    s = rf"replace(replace(trim({x}), ' ', ''), chr(160), '')"
    commas = f"(length({s}) - length(replace({s}, ',', '')))"
    p = f"""case when {commas} > 0 and contains({s}, '.') then case when strpos(reverse({s}), ',') < strpos(reverse({s}), '.') then replace(replace({s}, '.', ''), ',', '.') else replace({s}, ',', '') end
 when {commas} = 1 and length(split_part({s}, ',', -1)) <= 2 then replace({s}, ',', '.') else replace({s}, ',', '') end"""
    return rf"case when regexp_matches({p}, '^[+-]?(\d+\.?\d*|\.\d+)$') then try_cast({p} as double) end"


def scale_sql(x: str) -> str:
    return f"case lower(trim({x})) " + " ".join(f"when '{u}' then {f!r}" for u, f in N.SCALES.items()) + " else 1.0 end"


_C = sql_text("(?i)" + N.CLAIM)
_CA = sql_text(f"(?i)^(?:{N.CLAIM})")


def claim_value_sql(r: str) -> str:
    g = lambda i: f"regexp_extract({r}, {_CA}, {i})"
    unit = f"case when lower({g(5)}) in ('k', 'тыс', 'млн', 'million', 'млрд', 'billion') then {scale_sql(g(5))} else 1.0 end"
    return f"case when {g(2)} <> '' then ({parse_sql(g(2))}) * {scale_sql(g(3))} else ({parse_sql(g(4))}) * {unit} end"


_DATES = "coalesce(" + ", ".join(f"nullif(regexp_extract(snippet, {sql_text(re2(p))}, 1), '')" for p in T.DATE_PATTERNS) + ")"
_ORDERS = "(select o_orderkey, '$' || cast(round(o_totalprice, 2) as decimal(18,2))::varchar || case o_orderkey % 4 when 0 then ' million' when 1 then ' billion' when 2 then 'k' else '' end || ' against ' || o_custkey || ' stars and ' || (o_orderkey % 100) || ',' || (o_custkey % 90 + 10) || '%' as text from orders)"


def orders(spark, d):
    o = R.read(spark, d, "orders")
    k = F.col("o_orderkey")
    unit = F.when(k % 4 == 0, F.lit(" million")).when(k % 4 == 1, F.lit(" billion")).when(k % 4 == 2, F.lit("k")).otherwise(F.lit(""))
    price = F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("$"), price, unit, F.lit(" against "), F.col("o_custkey"), F.lit(" stars and "), k % 100, F.lit(","), F.col("o_custkey") % 90 + 10, F.lit("%"))
    return o.select("o_orderkey", text.alias("text"))


def _exploded(source, fn, key):
    def run(spark, d):
        return source(spark, d).select(*key, F.posexplode(fn(F.col("text"))).alias("n", "x")).select(*key, F.col("n").cast("long").alias("n"), "x.*")

    return run


def _all_texts(spark, d):
    hits = R.hits(spark, d).select(F.lit("hit").alias("origin"), (F.col("query_id") * 1000 + F.col("pos")).alias("id"), F.col("snippet").alias("text"))
    return hits.union(orders(spark, d).select(F.lit("order"), "o_orderkey", "text"))


TEXTS_SQL = f"(select 'hit' as origin, query_id * 1000 + pos as id, snippet as text from {_H} union all select 'order', o_orderkey, text from {_ORDERS})"
_KIND = f"lower(regexp_extract(r, {_CA}, 5))"
_STARS = sql_text("(?i)" + N.STARS)
_CLAIM_ROWS = rf"""(select origin, id, 1 as pass, unnest(s) as r, generate_subscripts(s, 1) as i from (select *, regexp_extract_all(regexp_replace(text, '[*`_]+', ' ', 'g'), {_STARS}, 0) as s from {TEXTS_SQL})
 union all select origin, id, 2, unnest(s), generate_subscripts(s, 1) from (select *, regexp_extract_all(regexp_replace(text, '[*`_]+', ' ', 'g'), {_C}, 0) as s from {TEXTS_SQL}))"""
CLAIMS_SQL = rf"""(select origin, id, row_number() over (partition by origin, id order by pass, i) - 1 as n, raw, value, kind from (
 select *, row_number() over (partition by origin, id, lower(raw) order by pass, i) as again from (select *, trim(r, ' ' || chr(10)) as raw,
 case when pass = 1 then ({parse_sql(f"regexp_extract(r, {_STARS}, 1)")}) * case when regexp_matches(r, {sql_text("(?i)" + N.THOUSAND)}) then 1000.0 else 1.0 end else {claim_value_sql("r")} end as value,
 case when pass = 1 or contains({_KIND}, 'star') or contains({_KIND}, 'зв') then 'stars' when contains({_KIND}, '%') then 'percent' when contains({_KIND}, 'гвт') or contains({_KIND}, 'мвт') or {_KIND} in ('gw', 'mw') then 'power' else 'number' end as kind
 from {_CLAIM_ROWS}) where pass = 1 or length(raw) >= 2) where again = 1)"""

#: Delimiters that two numbers may share are doubled first, for want of lookaround.
PAGE_NUMBERS_SQL = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(substr(coalesce(enriched_text, ''), 1, 8000), '(\s)', '\1\1', 'g'), ',(\d{3,})', ', ,\1', 'g'), '(\d)-(\d)', '\1--\2', 'g'),
 '(?:^|[^\p{L}\p{N}_./])(-?\d{1,4}(?:[.,]\d{1,2})?)(?:$|[^\p{L}\p{N}_./])', 1), lambda t: replace(t, ',', '.')::double)[1:24]"""

PLANS = {
    "txt_01_html_to_text": (_pages(lambda h: dict(readable=T.html_to_text(h))), f"select page_id, {R.READABLE_SQL} as readable from pages"),
    "txt_02_head_and_tail": (
        _pages(lambda h: dict(excerpt=T.head_and_tail(T.html_to_text(h), 700))),
        f"select page_id, {head_tail_sql('x', 700)} as excerpt from (select page_id, {R.READABLE_SQL} as x from pages)",
    ),
    "txt_03_clean_blob": (_docs(lambda t: dict(cleaned=T.clean_blob(t))), f"select doc_id, {clean_sql('text', 8000)} as cleaned from documents"),
    "txt_04_sanitize_hits": (
        _hits(lambda c: dict(title=T.clean_blob(c("title"), title=True), snippet=T.clean_blob(c("snippet")), enriched_text=T.clean_blob(c("enriched_text")))),
        f"select query_id, pos, {clean_sql('title', 240)} as title, {clean_sql('snippet', 8000)} as snippet, {clean_sql('enriched_text', 8000)} as enriched_text from {_H}",
    ),
    "txt_05_markdown_chrome": (
        lambda spark, d: R.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "x")).select("doc_id", F.col("n").cast("long").alias("n"), T.is_markdown_chrome(F.col("x")).alias("chrome")),
        f"select doc_id, n - 1 as n, {_CHROME} as chrome from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)",
    ),
    "txt_06_phrase_loop": (_docs(lambda t: dict(looped=T.has_phrase_loop(t))), None),
    "txt_07_token_loop": (
        _docs(lambda t: dict(looped=T.has_token_loop(t))),
        f"select d.doc_id, length(trim(d.text)) >= 80 and coalesce(i.run, 0) >= 8 as looped from documents d left join {_ISLANDS} i on d.doc_id = i.doc_id",
    ),
    "txt_08_ellipsis_collapse": (
        _docs(lambda t: dict(collapsed=T.ellipsis_collapse(F.concat(t, F.when(F.col("doc_id") % 3 == 0, F.lit(" ... ...")).otherwise(F.lit(" end. ......")))))),
        r"""select doc_id, length(s) >= 200 and (regexp_matches(right(s, 400), '(?:\.{3,}|……){2,}') or regexp_matches(right(s, 400), '\.{6,}\s*$')) as collapsed
 from (select doc_id, text || case when doc_id % 3 = 0 then ' ... ...' else ' end. ......' end as s from documents)""",
    ),
    "txt_09_section_label": (
        lambda spark, d: R.messages(spark, d).select("id", T.section_label("news", F.col("message")).alias("label"), T.section_label("price", F.col("message"), "📈").alias("priced")),
        rf"""select id, case when regexp_matches(message, '[\x{{0400}}-\x{{04FF}}]') then '{T.SECTION_LABELS["news"][0]}' else '{T.SECTION_LABELS["news"][1]}' end as label,
 '📈 ' || case when regexp_matches(message, '[\x{{0400}}-\x{{04FF}}]') then '{T.SECTION_LABELS["price"][0]}' else '{T.SECTION_LABELS["price"][1]}' end as priced from {R.MESSAGES_SQL}""",
    ),
    "txt_10_display_snippet": (
        _hits(lambda c: dict(shown=T.display_snippet(c("enriched_text"), c("snippet"), 120, 400))),
        f"""select query_id, pos, case when trim(coalesce(enriched_text, '')) <> '' then substr(trim(enriched_text), 1, greatest(120, least(400, length(trim(enriched_text))))) else substr(trim(snippet), 1, 120) end as shown from {_H}""",
    ),
    "txt_11_date_in_snippet": (_hits(lambda c: dict(found=T.date_in(c("snippet")))), f"select query_id, pos, {_DATES} as found from {_H}"),
    "txt_12_citation_suffix": (
        lambda spark, d: R.urls(spark, d).select("id", T.citation_suffix(F.col("url")).alias("suffix")),
        f"select id, case when regexp_matches(trim(url), '^https?://') then chr(10) || '    URL: ' || trim(url) else '' end as suffix from {R.URLS}",
    ),
    "txt_14_result_insufficient": (
        _docs(lambda t: dict(insufficient=T.result_insufficient(F.col("doc_id") % 7 != 0, t, F.col("doc_id") % 3))),
        f"""select doc_id, case when doc_id % 7 = 0 then true when doc_id % 3 > 0 and length(trim(text)) >= 40 then false else length(trim(text)) < 120
 or (length(trim(text)) < 320 and {contains_any("lower(text)", T.FOOTER_PHRASES)}) or ({contains_any("substr(lower(trim(text)), 1, 800)", T.WEAK_SIGNALS)} and length(trim(text)) < 600) end as insufficient from documents""",
    ),
    "src_14_block_page": (
        _hits(lambda c: dict(blocked=T.is_block_page(c("snippet")))),
        f"select query_id, pos, {contains_any('lower(snippet)', T.BLOCK_PHRASES)} and length(snippet) < 2000 as blocked from {_H}",
    ),
    "src_13_page_text": (
        lambda spark, d: R.hits(spark, d).select("query_id", "pos", "url").join(
            R.read(spark, d, "pages").select("url", T.html_to_text(F.col("html")).alias("page_text")).where(F.length("page_text") >= 40).groupBy("url").agg(F.max("page_text").alias("page_text")), "url"
        ),
        f"select h.query_id, h.pos, h.url, p.page_text from {_H} h join (select url, max(x) as page_text from (select url, {R.READABLE_SQL} as x from pages) where length(x) >= 40 group by url) p on h.url = p.url",
    ),
    "num_01_parse_number": (
        lambda spark, d: R.read(spark, d, "orders").select("o_orderkey", N.parse_number(F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))).alias("value"), N.parse_number(F.concat(F.col("o_custkey"), F.lit("."), F.col("o_orderkey") % 1000, F.lit(","), F.col("o_orderkey") % 100)).alias("european"), N.parse_number(F.col("o_orderpriority")).alias("not_number")),
        "select o_orderkey, round(o_totalprice, 2) as value, cast(o_custkey || '' || (o_orderkey % 1000) || '.' || (o_orderkey % 100) as double) as european, cast(null as double) as not_number from orders",
    ),
    "num_02_scale": (
        lambda spark, d: R.messages(spark, d).select("id", N.scale_of(F.element_at(F.array(*[F.lit(x) for x in ("B", "млн", "k", "stars", "")]), (F.col("id") % 5 + 1).cast("int"))).alias("factor")),
        f"select id, {scale_sql(f'list_extract({sql_list(("B", "млн", "k", "stars", ""))}, id % 5 + 1)')} as factor from {R.MESSAGES_SQL}",
    ),
    "num_04_evidence_numbers": (
        _exploded(_all_texts, N.evidence_numbers, ("origin", "id")),
        f"""select origin, id, row_number() over (partition by origin, id order by i) - 1 as n, value, raw from (select *, {claim_value_sql("raw")} as value from (select origin, id, unnest(m) as raw, generate_subscripts(m, 1) as i
 from (select *, regexp_extract_all(text, {_C}, 0) as m from {TEXTS_SQL}))) where value is not null""",
    ),
    "clm_02_extract_claims": (_exploded(_all_texts, N.claims, ("origin", "id")), f"select origin, id, n, raw, value, kind from {CLAIMS_SQL} where n < 24"),
    "num_06_page_numbers": (
        lambda spark, d: R.hits(spark, d).select("query_id", "pos", F.posexplode(N.page_numbers(F.col("enriched_text"))).alias("n", "value")).select("query_id", "pos", F.col("n").cast("long").alias("n"), "value"),
        f"select query_id, pos, n - 1 as n, value from (select query_id, pos, unnest(v) as value, generate_subscripts(v, 1) as n from (select query_id, pos, {PAGE_NUMBERS_SQL} as v from {_H}))",
    ),
    "num_07_close_pairs": (
        lambda spark, d: R.read(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("x")).join(R.read(spark, d, "part").select(F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("y")), F.col("b") == F.col("a") + 1).select("a", "b", N.numbers_close(F.col("x"), F.col("y")).alias("close"), N.approx_equal(F.col("x"), F.col("y")).alias("equal")),
        """select a.p_partkey as a, b.p_partkey as b, d <= 1.0 or d / greatest(abs(a.p_retailprice), abs(b.p_retailprice), 1e-9) <= 0.08 as close, d <= 0.5 or d / greatest(abs(a.p_retailprice), abs(b.p_retailprice), 1.0) <= 0.08 as equal
 from part a join part b on b.p_partkey = a.p_partkey + 1, lateral (select abs(a.p_retailprice - b.p_retailprice) as d)""",
    ),
    "num_09_mention_count": (
        _hits(lambda c: dict(mentions=N.mention_count(F.substring(c("snippet"), 1, 12000)).cast("long"))),
        f"select query_id, pos, cast(len(regexp_extract_all(substr(snippet, 1, 12000), {sql_text('(?i)' + N.MENTION)})) as bigint) as mentions from {_H}",
    ),
}
