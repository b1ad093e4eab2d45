"""URL queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.regex import sql_list
from ..sources import relations as R

_NETLOC = r"regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
_PARTS = rf"""(select *, split_part(lower(netloc), ':', 1) as host, replace(lower(netloc), 'www.', '') as bare, replace(netloc, 'www.', '') as domain,
 lower(path) || '?' || lower(query) as pq from (select *, {_NETLOC} as netloc,
 regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from {R.URLS}))"""


def suffix_sql(h: str, suffixes) -> str:
    return f"len(list_filter({sql_list(suffixes)}, lambda s: {h} = s or ends_with({h}, '.' || s))) > 0"


def any_sql(x: str, parts) -> str:
    return f"len(list_filter({sql_list(parts)}, lambda s: contains({x}, s))) > 0"


HTTP = "(starts_with(url, 'http://') or starts_with(url, 'https://'))"
LOGIN = any_sql("pq", U.LOGIN_MARKERS)
MEDIA = f"""(case kind when 'video' then {suffix_sql("host", U.MEDIA_VIDEO)} when 'image' then {suffix_sql("host", U.MEDIA_IMAGE)}
 when 'mixed' then {suffix_sql("host", U.MEDIA_VIDEO + U.MEDIA_IMAGE)} else false end)"""
BLOCKED = f"""(not {HTTP} or host = '' or {suffix_sql("host", U.ALWAYS_BLOCKED)} or {LOGIN}
 or (({suffix_sql("host", U.PINTEREST)} or {suffix_sql("host", U.VIDEO_HOSTS)}) and not {MEDIA}))"""
_LABELS = "string_split(trim(host, '.'), '.')"
GOV = f"""coalesce((len({_LABELS}) >= 2 and {_LABELS}[-1] in ('gov', 'edu')) or (len({_LABELS}) >= 3 and {_LABELS}[-2] in ('gov', 'edu', 'ac')), false)"""


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


PRIMARY = f"""({HTTP} and ({GOV} or {rx("host", U.OFFICIAL_HOST)} or {suffix_sql("host", ("github.com",))} or {rx("host", U.IR_HOST)} or {rx("pq", U.PRIMARY_PATH)}))"""
_W = U.WEIGHTS
ADJUST = f"""round(case when not {HTTP} then {_W["not_http"]} else
 case when {suffix_sql("host", U.ALWAYS_BLOCKED)} then {_W["always_blocked"]}
  when {suffix_sql("host", U.PINTEREST)} then case when kind in ('image', 'mixed') then {_W["pinterest_wanted"]} else {_W["pinterest"]} end
  when {suffix_sql("host", U.VIDEO_HOSTS)} then case when kind in ('video', 'mixed') then {_W["video_wanted"]} else {_W["video"]} end
  when {suffix_sql("host", U.DISCOURAGED)} then {_W["discouraged"]} else 0 end::double
 + case when kind in ('image', 'mixed') and {suffix_sql("host", U.STOCK_IMAGE)} then {_W["stock_image"]} else 0 end
 + case when {LOGIN} then {_W["login"]} else 0 end + case when {rx("pq", U.STRUCTURAL_NOISE)} then {_W["noise"]} else 0 end
 + case when {rx("pq", U.THIN_AGGREGATOR)} then {_W["aggregator"]} else 0 end
 + case when {rx("pq", U.SEO_REPORT)} and not {PRIMARY} then {_W["seo"]} else 0 end
 + case when list_contains({sql_list(U.SHORTENERS)}, host) then {_W["shortener"]} else 0 end + case when {GOV} then {_W["gov_edu"]} else 0 end
 + case when {rx("host", U.OFFICIAL_HOST)} then {_W["official"]} else 0 end + case when {rx("host", U.IR_HOST)} then {_W["ir"]} else 0 end
 + case when {rx("pq", U.PRIMARY_PATH)} then {_W["primary_path"]} else 0 end + case when {suffix_sql("host", ("github.com",))} then {_W["code_host"]} else 0 end
 end, 6)"""
KEY = r"regexp_replace(lower(regexp_replace(split_part(trim(url), '#', 1), '/+$', '')), '^(https?://)www\.', '\1')"
_RAW = "(case when starts_with(trim(url), '//') then 'https:' || trim(url) else trim(url) end)"
_NOT_PUBLIC = " or ".join(f"ip between {a} and {b}" for a, b in map(U.net_range, U.BLOCKED_NETS))
_POLICY = rf"""(select *, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) as scheme,
 case when starts_with(n, '[') then regexp_extract(n, '^\[([^\]]*)\]', 1) else split_part(n, ':', 1) end as h, lower(regexp_extract(raw, '^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1)) as p
 from (select *, regexp_replace(lower(regexp_extract(raw, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^.*@', '') as n from (select *, {_RAW} as raw from {R.URLS})))"""
_IP = r"""(select *, case when regexp_matches(h, '^(\d{1,3}\.){3}\d{1,3}$') and list_max(list_transform(string_split(h, '.'), lambda x: x::int)) < 256 then
 split_part(h, '.', 1)::bigint * 16777216 + split_part(h, '.', 2)::bigint * 65536 + split_part(h, '.', 3)::bigint * 256 + split_part(h, '.', 4)::bigint end as ip from """


def _reason_sql(allowed=(), paths=U.BLOCKED_PATHS) -> str:
    listed = f"when not ({suffix_sql('h', allowed)}) then 'host_not_in_allowlist'" if allowed else ""
    frags = " ".join(f"when contains(p, '{f}') then 'blocked_path:{f}'" for f in paths)
    return rf"""select id, url, case when raw = '' then 'empty_url' when scheme not in ('http', 'https') then 'bad_scheme:' || case scheme when '' then 'none' else scheme end
 when h = '' then 'no_host' when h in {tuple(U.METADATA_HOSTS)} or h = 'localhost' or ends_with(h, '.localhost') or coalesce({_NOT_PUBLIC}, false)
 or regexp_matches(h, '^(::1?|f[cd][0-9a-f]{{2}}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{{2}}:.*)$') then 'blocked_host_private_or_loopback' {listed} {frags} else '' end as reason from {_IP} {_POLICY})"""


def _on_urls(cols):
    """A query of columns over the addresses; they are built once a session is there."""
    return lambda spark, d: R.urls(spark, d).select("id", "url", *[c.alias(n) for n, c in cols(F.col("url"), F.col("kind")).items()])


PLANS = {
    "url_01_policy_validate": (_on_urls(lambda u, k: dict(reason=U.policy_reason(u))), _reason_sql()),
    "url_01_policy_allowlist": (_on_urls(lambda u, k: dict(reason=U.policy_reason(u, ("example.com", ".gov")))), _reason_sql(("example.com", "gov"))),
    "url_02_blocked_for_fetch": (_on_urls(lambda u, k: dict(reason=U.policy_reason(u, paths=()))), _reason_sql(paths=())),
    "url_03_host_not_public": (
        _on_urls(lambda u, k: dict(blocked=U.host_not_public(U.hostname(F.trim(u))))),
        rf"""select id, url, h = '' or h in {tuple(U.METADATA_HOSTS)} or h = 'localhost' or ends_with(h, '.localhost') or coalesce({_NOT_PUBLIC}, false)
 or regexp_matches(h, '^(::1?|f[cd][0-9a-f]{{2}}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{{2}}:.*)$') as blocked from {_IP} {_POLICY})""",
    ),
    "url_05_normalize_http": (
        _on_urls(lambda u, k: dict(normalized=U.normalize_http(u))),
        f"select id, url, case when regexp_matches({_RAW}, '(?i)^https?://') then {_RAW} end as normalized from {R.URLS}",
    ),
    "url_06_url_key": (_on_urls(lambda u, k: dict(url_key=U.url_key(u))), f"select id, url, {KEY} as url_key from {R.URLS}"),
    "url_07_host_path_query": (
        _on_urls(lambda u, k: dict(host=U.host(u), bare_host=U.bare_host(u), path_query=U.path_query(u))),
        f"select id, url, host, bare as bare_host, pq as path_query from {_PARTS}",
    ),
    "url_08_suffix_match": (
        _on_urls(lambda u, k: dict(discouraged=U.has_suffix(U.host(u), U.DISCOURAGED), video=U.has_suffix(U.host(u), U.MEDIA_VIDEO))),
        f"select id, url, {suffix_sql('host', U.DISCOURAGED)} as discouraged, {suffix_sql('host', U.MEDIA_VIDEO)} as video from {_PARTS}",
    ),
    "url_09_login_wall": (_on_urls(lambda u, k: dict(login_wall=U.is_login_wall(u))), f"select id, url, {LOGIN} as login_wall from {_PARTS}"),
    "url_10_blocked_for_browse": (_on_urls(lambda u, k: dict(blocked=U.blocked_for_browse(u, k))), f"select id, url, {BLOCKED} as blocked from {_PARTS}"),
    "url_11_gov_or_edu": (_on_urls(lambda u, k: dict(gov_or_edu=U.is_gov_or_edu(U.host(u)))), f"select id, url, {GOV} as gov_or_edu from {_PARTS}"),
    "url_12_primary_source": (_on_urls(lambda u, k: dict(is_primary=U.is_primary_source(u))), f"select id, url, {PRIMARY} as is_primary from {_PARTS}"),
    "url_13_quality_adjustment": (_on_urls(lambda u, k: dict(adjustment=U.quality_adjustment(u, k))), f"select id, url, {ADJUST} as adjustment from {_PARTS}"),
    "url_14_entry_priority": (
        _on_urls(lambda u, k: dict(priority=U.entry_priority(u, F.lit(0.5), k))),
        f"""select id, url, case when not {BLOCKED} then round(0.5 + {ADJUST} + case when {rx("lower(path)", U.NEWS_PATH)} then {_W["news"]} else 0 end, 6) end as priority from {_PARTS}""",
    ),
    "url_17_repo_key": (
        _on_urls(lambda u, k: dict(repo_key=U.repo_key(u))),
        rf"""select id, url, case when contains(regexp_extract(k, '^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)', 1), 'github.com') and len(parts) >= 2 then 'github.com/' || parts[1] || '/' || parts[2] else k end as repo_key
 from (select *, list_filter(string_split(regexp_extract(k, '^(?:(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') as parts from (select *, lower(regexp_replace(split_part(url, '#', 1), '/+$', '')) as k from {R.URLS}))""",
    ),
    "src_09_domain": (_on_urls(lambda u, k: dict(domain=U.domain(u))), f"select id, url, domain from {_PARTS}"),
    "url_08_browse_key": (_on_urls(lambda u, k: dict(browse_key=U.browse_key(u))), f"select id, url, lower(regexp_replace(split_part(url, '?', 1), '/+$', '')) as browse_key from {R.URLS}"),
}
