"""Questions: classification and rewriting, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions.regex import re2, sql_list, sql_text
from ..sources import relations as R

YEAR = 2026
_M = R.MESSAGES_SQL


def _on_messages(cols):
    """A query of columns over the questions; they are built once a session is there."""
    return lambda spark, d: R.messages(spark, d).select("id", *[c.alias(n) for n, c in cols(F.col("message")).items()])


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {sql_text(re2(pattern))})"


def any_of(x: str, patterns) -> str:
    return "(" + " or ".join(has(x, p) for p in patterns) + ")"


def contains_any(x: str, parts) -> str:
    return f"(len(list_filter({sql_list(parts)}, lambda s: contains({x}, s))) > 0)"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_N = collapse("regexp_replace(lower(message), '[!?.,;:…]+', ' ', 'g')")
_WORDS = f"len(list_filter(string_split({collapse('message')}, ' '), lambda w: w <> ''))"
_TRIVIAL = f"(n = '' or list_contains({sql_list(I.TRIVIAL_PHRASES)}, n) or (len(string_split(n, ' ')) <= 5 and list_has_all({sql_list(I.TRIVIAL_TOKENS)}, string_split(n, ' '))))"
_SHORT_NO = f"({_WORDS} <= 2 and {contains_any('lower(message)', I.NO_KEYWORDS)})"
_DEFINITE_NO = f"({_SHORT_NO} or {any_of('trim(message)', I.TRIVIAL_NO + I.MORE_NO)})"
_YES = "case " + " ".join(f"when {any_of('lower(message)', p)} then '{c}'" for c, p in I.YES_RULES) + " end"
_TIMED = f"({any_of('lower(message)', I.TIME_TRIGGERS)} and {contains_any('lower(message)', I.TIME_SENSITIVE)})"


def optimize(x: str, category: str) -> str:
    q = f"trim({x})"
    for p in I.REQUEST_NOISE:
        q = f"regexp_replace({q}, {sql_text('(?i)' + p)}, '', 'g')"
    q = f"trim(trim(trim({q}), '?.!,;:'))"
    tail = "case " + category + " " + " ".join(f"when '{c}' then {sql_text(t.replace('{year}', str(YEAR)))}" for c, t in I.QUERY_TEMPLATES.items()) + " else '' end"
    w = f"list_filter(string_split({collapse(q)}, ' '), lambda w: w <> '')"
    return f"trim(case when len({w}) > 10 then array_to_string(({w})[1:10], ' ') else {q} end || {tail})"


def edge(x: str, limit: int) -> str:
    return f"case when length({x}) <= {limit} then {x} else regexp_replace(substr({x}, 1, {limit}), '(?s) [^ ]*$', '') end"


_SPACES = "(length(q) - length(replace(q, ' ', '')))"
_PLACE_RE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:в|in|at|для|по|of|регионе|районе|city\s+of|country\s+of)\s+([" + I._LETTER + "][" + I._LETTER + r"-]{1,})"
_DEEP = f"""(length(m) >= 40 and ({has("m", I.RESEARCH_INTENT)} or (length(m) >= 160 and length(m) - length(regexp_replace(m, '[,.?]', '', 'g')) >= 2 and {has("m", I.RESEARCH_TOPIC)})))"""
_TRIMMED = f"(select *, trim(message) as m from {_M})"
_LEAD = sql_text("(?i)" + I.LEAD_VERB)
_CUT = sql_text(r"(?is),?\s*(и\s+на\s+основе|и\s+дай|дай\s+прогноз|обязательно|структурируй|based\s+on|give\s+a\s+forecast|must\s+cite)(?:$|[^\p{L}\p{N}_].*$)")
_TOPIC_CUT = sql_text(r"(?is),?\s*(и\s+на\s+основе|и\s+сделай|структурируй|только\s+по\s+источникам|предложи|with\s+justification|based\s+on\s+sources)(?:$|[^\p{L}\p{N}_].*$)")
_FUNCTION = sql_list(I.FUNCTION_WORDS)
_PLACES_ONE = rf"""list_filter(list_transform(regexp_extract_all(message, {sql_text(_PLACE_RE)}, 1), lambda w: trim(w, ' -.,;:')),
 lambda w: length(w) >= 2 and not list_contains({_FUNCTION}, lower(w)) and not (length(w) <= 4 and regexp_matches(w, '\p{{Lu}}') and w = upper(w)))"""
_FIRST = "list_filter({0}, lambda w, i: list_position({0}l, lower(w)) = i)"


def places_sql(source: str) -> str:
    """source with message, plus places."""
    return f"""(select *, ({_FIRST.format("p")})[1:8] as places from (select *, list_transform(p, lambda x: lower(x)) as pl from (select *, {_PLACES_ONE} as p from {source})))"""


_NOUN_WORDS = rf"""list_filter(regexp_extract_all(regexp_replace(trim(message), {sql_text("(?i)" + I.INSTRUCTION_PREFIX)}, ''), '[A-Za-zА-Яа-яЁё]{{4,}}'),
 lambda w: not list_contains({_FUNCTION}, lower(w)) and not list_contains(placesl, lower(w)) and not (length(w) <= 4 and w = upper(w)))"""


def nouns_sql(source: str) -> str:
    """source with message, plus places and nouns."""
    words = f"(select *, {_NOUN_WORDS} as w from (select *, list_transform(places, lambda x: lower(x)) as placesl from {places_sql(source)}))"
    return f"""(select *, (list_filter(wl, lambda x, i: list_position(wl, x) = i))[1:10] as nouns from (select *, list_transform(w, lambda x: lower(x)) as wl from {words}))"""


_LIVE_SQL = " ".join(
    f"when {cond} then case when {has('lower(message)', live)} then trim(message) else trim(trim(message) || '{tail}') end"
    for cond, live, tail in (
        (has("message", I.WEATHER), r"(current|today|сейчас|live|right\s+now)", " current weather today temperature"),
        (has("message", I.FX), r"(current|live|today|сейчас|spot)", " current live rate today official"),
        (f"{has('message', I.SPOT)} and length(message) < 100", r"(current|live|today|сейчас|spot|price)", " current price today"),
    )
)
_KIND = f"case when {has('message', I.VIDEO)} and {has('message', I.IMAGE)} then 'mixed' when {has('message', I.VIDEO)} then 'video' when {has('message', I.IMAGE)} then 'image' end"
_LOW = "lower(trim(message) || ' ' || message)"


def _site(names, tag: str) -> str:
    return f"when {contains_any(_LOW, names)} then case when contains({_LOW}, 'site:{tag}') then '' else ' (site:{tag})' end"


_SITES = f"""case when kind in ('video', 'mixed') then case {_site(("tiktok", "тикток"), "tiktok.com")} {_site(("rutube", "рутуб"), "rutube.ru")} {_site(("vimeo",), "vimeo.com")}
 when contains({_LOW}, 'site:youtube.com') or contains({_LOW}, 'youtu.be') then '' else ' (site:youtube.com OR site:youtu.be)' end else '' end
 || case when kind in ('image', 'mixed') and not contains({_LOW}, 'freepik') then ' (site:freepik.com OR site:pinterest.com OR site:unsplash.com)' else '' end"""
_DEPTH = "case when id % 3 = 0 then 'fast' else 'deep' end"


def _depth():
    return F.when(F.col("id") % 3 == 0, F.lit("fast")).otherwise(F.lit("deep"))


def _legacy(spark, d):
    return I.legacy_decision(R.messages(spark, d), YEAR).drop("message")


def _effective(spark, d):
    """The last six texts of a conversation before its newest, a separator, and the newest."""
    turns = R.read(spark, d, "conversations").select("conv_id", "turn", "text")
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    tail = F.filter(F.transform(F.collect_list("text").over(w), lambda t: F.trim(t)), lambda t: t != "")
    head = F.concat(F.array_join(tail, "\n"), F.lit("\n---\nТекущее сообщение:\n"))
    return turns.select("conv_id", "turn", F.when(F.size(tail) > 0, F.concat(head, F.trim("text"))).otherwise(F.col("text")).alias("effective"))


PLANS = {
    "qry_01_normalize_trivial": (_on_messages(lambda m: dict(normalized=I.normalize_trivial(m))), f"select id, {_N} as normalized from {_M}"),
    "qry_02_trivial_message": (_on_messages(lambda m: dict(trivial=I.is_trivial(m))), f"select id, {_TRIVIAL} as trivial from (select *, {_N} as n from {_M})"),
    "qry_03_greeting": (
        _on_messages(lambda m: dict(greeting=I.is_greeting(m))),
        f"select id, n <> '' and (list_has_any(string_split(n, ' '), {sql_list(I.GREETING_HINTS)}) or {contains_any('n', I.GREETING_PHRASES)}) as greeting from (select *, {_N} as n from {_M})",
    ),
    "qry_04_no_search": (
        _on_messages(lambda m: dict(trivial_no=I.is_trivial_no(m), definitely_no=I.is_definitely_no(m))),
        f"select id, {_TRIVIAL} or {_SHORT_NO} or {any_of('trim(message)', I.TRIVIAL_NO)} as trivial_no, {_DEFINITE_NO} as definitely_no from (select *, {_N} as n from {_M})",
    ),
    "qry_05_optimize_query": (
        _on_messages(lambda m: dict(search_query=I.optimize_query(m, F.element_at(F.array(*[F.lit(c) for c in I.CATEGORIES]), (F.col("id") % 11 + 1).cast("int")), YEAR))),
        f"select id, {optimize('message', f'list_extract({sql_list(I.CATEGORIES)}, id % 11 + 1)')} as search_query from {_M}",
    ),
    "qry_06_yes_category": (_on_messages(lambda m: dict(category=I.yes_category(m))), f"select id, {_YES} as category from {_M}"),
    "qry_07_time_rule": (_on_messages(lambda m: dict(timed=I.has_time_trigger(m) & I.has_time_sensitive(m))), f"select id, {_TIMED} as timed from {_M}"),
    "qry_08_legacy_cascade": (
        _legacy,
        f"""select id, not no and (yes is not null or timed) as should_search, case when no then null when yes is not null then yes when timed then 'general' end as category,
 case when no or (yes is null and not timed) then '' else {optimize("message", "coalesce(yes, 'general')")} end as search_query,
 case when no then 0.0 when yes is not null then 0.95 when timed then 0.8 else 0.0 end::double as confidence,
 case when no then 'Tier 1: heuristic skip' when yes is not null then 'Tier 2: matched ' || yes when timed then 'Tier 2: time trigger + domain term' else 'No signal found, default no-search' end as reason
 from (select *, {_DEFINITE_NO} as no, {_YES} as yes, {_TIMED} as timed from {_M})""",
    ),
    "qry_10_effective_message": (
        _effective,
        r"""select conv_id, turn, case when len(tail) > 0 then array_to_string(tail, chr(10)) || chr(10) || '---' || chr(10) || 'Текущее сообщение:' || chr(10) || trim(text) else text end as effective
 from (select *, list_filter(list_transform(coalesce(list(text) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding), []), lambda t: trim(t)), lambda t: t <> '') as tail from conversations)""",
    ),
    "qry_12_llm_fields": (
        _on_messages(lambda m: dict(truthy=I.truthy(m), depth=I.depth_from_llm(m), category=I.category_from_llm(F.element_at(F.split(m, " "), 1)))),
        f"""select id, lower(trim(message)) in ('1', 'true', 'yes', 'on') as truthy, case when lower(trim(message)) = 'fast' then 'fast' else 'deep' end as depth,
 case when lower(split_part(message, ' ', 1)) in ('', 'null') then null when list_contains({sql_list(I.CATEGORIES)}, lower(split_part(message, ' ', 1))) then lower(split_part(message, ' ', 1)) else 'general' end as category from {_M}""",
    ),
    "qry_14_forced_decision": (
        _on_messages(lambda m: dict(should_search=F.lit(True), category=F.lit("general"), search_query=F.substring(I.optimize_query(m, F.lit("general"), YEAR), 1, 500))),
        f"select id, true as should_search, 'general' as category, substr({optimize('message', chr(39) + 'general' + chr(39))}, 1, 500) as search_query from {_M}",
    ),
    "qry_15_compact_query": (
        _on_messages(lambda m: dict(compact=I.compact_query(m, F.lit(""), YEAR))),
        f"""select id, case when q <> '' and length(q) <= 180 and {_SPACES} <= 24 and not {has("q", I.ESSAY)} then substr({collapse("q")}, 1, 240) when q = '' then ''
 else case when ({edge("c", 240)}) = '' then substr(q, 1, 240) else {edge("c", 240)} end end as compact
 from (select *, {collapse(f"case when ({optimize('cleaned', chr(39) + 'general' + chr(39))}) = '' then cleaned else {optimize('cleaned', chr(39) + 'general' + chr(39))} end")} as c
 from (select *, case when length(cut) < 8 then q else cut end as cleaned from (select *, trim(regexp_replace(trim(regexp_replace(q, {_LEAD}, '')), {_CUT}, ''), ' ,;:') as cut from (select *, trim(message) as q from {_M}))))""",
    ),
    "qry_16_needs_compaction": (
        _on_messages(lambda m: dict(too_long=I.needs_compaction(m))),
        f"select id, length(q) > 240 or {_SPACES} > 28 as too_long from (select *, message as q from {_M})",
    ),
    "qry_17_current_fact": (
        _on_messages(lambda m: dict(current_fact=I.is_current_fact(m))),
        f"""select id, {has("message", I.WEATHER)} or {has("message", I.FX)} or ({has("message", I.SPOT)} and ({has("message", I.NOW)} or length(message) < 80)) or ({has("message", I.NOW)} and length(message) < 120) as current_fact from {_M}""",
    ),
    "qry_18_live_query": (
        _on_messages(lambda m: dict(shaped=I.shape_live_query(m, F.lit("")))),
        f"select id, substr({collapse(f'case {_LIVE_SQL} else trim(message) end')}, 1, 240) as shaped from {_M}",
    ),
    "qry_19_media_intent": (_on_messages(lambda m: dict(kind=I.media_intent(m))), f"select id, {_KIND} as kind from {_M}"),
    "qry_20_media_query": (
        _on_messages(lambda m: dict(search_query=I.augment_for_media(m, m, I.media_intent(m)))),
        f"select id, trim(trim(message) || {_SITES}) as search_query from (select *, {_KIND} as kind from {_M})",
    ),
    "qry_22_language": (
        _on_messages(lambda m: dict(language=I.language(m))),
        r"select id, case when length(regexp_replace(message, '[^\x{0400}-\x{04FF}]', '', 'g')) > length(message) * 0.2 then 'lang_ru' else 'lang_en' end as language from " + _M,
    ),
    "qry_23_date_restrict": (
        _on_messages(lambda m: dict(restrict=I.date_restrict(I.yes_category(m)))),
        f"select id, case when coalesce(list_contains({sql_list(I.RECENT_CATEGORIES)}, {_YES}), false) then 'd7' else 'm3' end as restrict from {_M}",
    ),
    "qry_24_deep_research": (_on_messages(lambda m: dict(deep=I.is_deep_research(m))), f"select id, {_DEEP} as deep from {_TRIMMED}"),
    "qry_25_orchestrate": (
        _on_messages(lambda m: dict(orchestrate=I.should_orchestrate(m, _depth(), F.col("id") % 5 == 0))),
        f"""select id, m <> '' and not ({has("m", I.SIMPLE_FACT)} and not {has("m", I.COMPARE)} and not {_DEEP}) and ({_DEEP} or ({has("m", I.COMPARE)} and length(m) >= 40)
 or ({_DEPTH} = 'deep' and length(m) >= 120) or (id % 5 = 0 and length(m) >= 80)) as orchestrate from {_TRIMMED}""",
    ),
    "qry_26_effective_depth": (
        _on_messages(lambda m: dict(depth=I.effective_depth(m, _depth()))),
        f"select id, case when {_DEPTH} = 'fast' and length(m) < 160 and not {has('m', I.RESEARCH_SHAPE)} then 'fast' else 'deep' end as depth from {_TRIMMED}",
    ),
    "qry_27_place_tokens": (_on_messages(lambda m: dict(places=F.array_join(I.place_tokens(m), "|"))), f"select id, array_to_string(places, '|') as places from {places_sql(_M)}"),
    "qry_28_content_nouns": (_on_messages(lambda m: dict(nouns=F.array_join(I.content_nouns(m), "|"))), f"select id, array_to_string(nouns, '|') as nouns from {nouns_sql(_M)}"),
    "qry_29_topic_core": (
        _on_messages(lambda m: dict(topic=I.topic_core(m, F.lit("")))),
        f"""select id, trim(case when ({edge("t", 120)}) = '' then substr(message, 1, 120) else {edge("t", 120)} end) as topic from (select *, trim({collapse(f"regexp_replace(regexp_replace(regexp_replace(trim(message), {_LEAD}, ''), '(?s)[:：].*$', ''), {_TOPIC_CUT}, '')")}, ' ,;') as t from {_M})""",
    ),
}
