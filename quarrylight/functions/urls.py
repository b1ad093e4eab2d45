"""URL functions: parts, keys, shapes, policy and quality weights, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: host suffixes, markers, patterns and weights ------------------------------------------------
ALWAYS_BLOCKED = ("instagram.com", "tiktok.com", "tiktokcdn.com", "pinimg.com", "snapchat.com", "threads.net", "fb.watch", "ytimg.com")
PINTEREST = ("pinterest.com", "pinterest.ru")
VIDEO_HOSTS = ("youtube.com", "youtu.be")
MEDIA_VIDEO = ("youtube.com", "youtu.be", "m.youtube.com", "rutube.ru", "vimeo.com")
MEDIA_IMAGE = (
    "pinterest.com",
    "pinterest.ru",
    "freepik.com",
    "unsplash.com",
    "pixabay.com",
    "shutterstock.com",
    "depositphotos.com",
    "istockphoto.com",
    "stock.adobe.com",
    "gettyimages.com",
)
STOCK_IMAGE = tuple(s for s in MEDIA_IMAGE if "pinterest" not in s)
DISCOURAGED = (
    "facebook.com",
    "m.facebook.com",
    "l.facebook.com",
    "reddit.com",
    "redd.it",
    "twitter.com",
    "x.com",
    "mobile.twitter.com",
    "t.me",
    "telegram.me",
    "linkedin.com",
    "lnk.bio",
    "linktr.ee",
)
SHORTENERS = ("t.co", "bit.ly", "goo.gl", "ow.ly", "tinyurl.com")
LOGIN_MARKERS = ("accounts/login", "/oauth/", "login?next=", "/signin?", "/signup?", "/i/flow/login", "/authorization")
STRUCTURAL_NOISE = r"/(converter|convert)/(shib|doge|pepe|meme)\b|/i/flow/login|/accounts/login"
THIN_AGGREGATOR = r"/(tag|tags|category|categories|author|authors|user|users|search|s|hashtag)/|/(amp)/|/page/\d+"
PRIMARY_PATH = (
    r"/(investor(?:-relations)?|investors|ir|press(?:-releases?)?|newsroom|media(?:-center)?|about(?:-us)?/news|filings?|sec-filings?|"
    r"statistics?|stats|datasets?|publications?|annual[-_]?reports?|financial[-_]?reports?|earnings)/"
)
SEO_REPORT = (
    r"/(market[-_]?(size|share|report|outlook|forecast|analysis)|industry[-_]?(report|analysis|outlook)|research[-_]?report|press-releases?/[^/]+$)"
)
OFFICIAL_HOST = (
    r"(^|\.)(sec\.gov|census\.gov|bls\.gov|data\.gov|worldbank\.org|imf\.org|oecd\.org|who\.int|un\.org|gov\.uk|ons\.gov\.uk|data\.gov\.uk|"
    r"europa\.eu|ec\.europa\.eu|eurostat\.ec\.europa\.eu|destatis\.de|insee\.fr|istat\.it|abs\.gov\.au|statcan\.gc\.ca|stat\.gov\.cn|"
    r"e-stat\.go\.jp|mospi\.gov\.in|gov\.kz|stat\.gov\.kz|egov\.kz|rosstat\.gov\.ru|gks\.ru)$"
)
IR_HOST = r"(^|\.)(investor|investors|ir)\."
NEWS_PATH = r"/(news|world|politics|business|live|articles?)/"
BLOCKED_PATHS = (
    "/login",
    "/signin",
    "/signup",
    "/oauth",
    "/authorize",
    "/checkout",
    "/payment",
    "/billing",
    "/wallet",
    "/account/delete",
    "/password",
    "/reset-password",
)
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata")
#: Address ranges that aren't public: network and prefix length.
BLOCKED_NETS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
WEIGHTS = {
    "not_http": -0.5,
    "always_blocked": -2.5,
    "pinterest_wanted": 0.5,
    "pinterest": -2.8,
    "video_wanted": 0.8,
    "video": -1.05,
    "discouraged": -1.35,
    "stock_image": 0.4,
    "login": -1.1,
    "noise": -2.0,
    "aggregator": -0.55,
    "seo": -0.75,
    "shortener": -1.4,
    "gov_edu": 1.15,
    "official": 0.75,
    "ir": 0.9,
    "primary_path": 0.65,
    "code_host": 0.55,
    "news": 0.15,
}
# ----------------------------------------------------------------------------------------------------------------

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def blank(x: Column) -> Column:
    """Null and empty are one."""
    return F.coalesce(x, F.lit(""))


def is_http(url: Column) -> Column:
    return F.startswith(blank(url), F.lit("http://")) | F.startswith(blank(url), F.lit("https://"))


def netloc(url: Column) -> Column:
    return F.regexp_extract(blank(url), _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-cased host without port."""
    return F.substring_index(F.lower(netloc(url)), ":", 1)


def bare_host(url: Column) -> Column:
    """Lower-cased authority without any www."""
    return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))


def domain(url: Column) -> Column:
    """Authority without any www., case and port as they are."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^[^?#]*\?([^#]*)", 1)


def path_query(url: Column) -> Column:
    """Lower-cased path?query; the question mark is always there."""
    return F.concat(F.lower(path(url)), F.lit("?"), F.lower(query(url)))


def has_suffix(h: Column, suffixes) -> Column:
    """Equal to one of the suffixes or a subdomain of it."""
    out = h.isin(*suffixes)
    for s in suffixes:
        out = out | F.endswith(h, F.lit(f".{s}"))
    return out


def contains_any(x: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def is_login_wall(url: Column) -> Column:
    return contains_any(path_query(url), LOGIN_MARKERS)


def media_allows(h: Column, kind: Column) -> Column:
    video, image = has_suffix(h, MEDIA_VIDEO), has_suffix(h, MEDIA_IMAGE)
    return F.when(kind == "video", video).when(kind == "image", image).when(kind == "mixed", video | image).otherwise(F.lit(False))


def blocked_for_browse(url: Column, kind: Column) -> Column:
    h = host(url)
    needs_intent = has_suffix(h, PINTEREST) | has_suffix(h, VIDEO_HOSTS)
    return ~is_http(url) | (h == "") | has_suffix(h, ALWAYS_BLOCKED) | (needs_intent & ~media_allows(h, kind)) | is_login_wall(url)


def is_gov_or_edu(h: Column) -> Column:
    labels = F.split(F.regexp_replace(h, r"^\.+|\.+$", ""), r"\.")
    last, second = F.element_at(labels, -1), F.get(labels, F.size(labels) - 2)
    return ((F.size(labels) >= 2) & last.isin("gov", "edu")) | ((F.size(labels) >= 3) & F.coalesce(second.isin("gov", "edu", "ac"), F.lit(False)))


def _code_host(h: Column) -> Column:
    return has_suffix(h, ("github.com",))


def is_primary_source(url: Column) -> Column:
    h, p = host(url), path_query(url)
    return is_http(url) & (is_gov_or_edu(h) | h.rlike(OFFICIAL_HOST) | _code_host(h) | h.rlike(IR_HOST) | p.rlike(PRIMARY_PATH))


def quality_adjustment(url: Column, kind: Column) -> Column:
    """Sum of the structural weights, in one fixed order."""
    h, p, w = host(url), path_query(url), WEIGHTS
    kind = blank(kind)
    add = lambda cond, name: F.when(cond, F.lit(w[name])).otherwise(F.lit(0.0))
    first = (
        F.when(has_suffix(h, ALWAYS_BLOCKED), F.lit(w["always_blocked"]))
        .when(has_suffix(h, PINTEREST), F.when(kind.isin("image", "mixed"), F.lit(w["pinterest_wanted"])).otherwise(F.lit(w["pinterest"])))
        .when(has_suffix(h, VIDEO_HOSTS), F.when(kind.isin("video", "mixed"), F.lit(w["video_wanted"])).otherwise(F.lit(w["video"])))
        .when(has_suffix(h, DISCOURAGED), F.lit(w["discouraged"]))
        .otherwise(F.lit(0.0))
    )
    total = (
        first
        + add(kind.isin("image", "mixed") & has_suffix(h, STOCK_IMAGE), "stock_image")
        + add(is_login_wall(url), "login")
        + add(p.rlike(STRUCTURAL_NOISE), "noise")
        + add(p.rlike(THIN_AGGREGATOR), "aggregator")
        + add(p.rlike(SEO_REPORT) & ~is_primary_source(url), "seo")
        + add(h.isin(*SHORTENERS), "shortener")
        + add(is_gov_or_edu(h), "gov_edu")
        + add(h.rlike(OFFICIAL_HOST), "official")
        + add(h.rlike(IR_HOST), "ir")
        + add(p.rlike(PRIMARY_PATH), "primary_path")
        + add(_code_host(h), "code_host")
    )
    return F.round(F.when(is_http(url), total).otherwise(F.lit(w["not_http"])), 6)


def entry_priority(url: Column, relevance: Column, kind: Column) -> Column:
    """Null where browsing is blocked, else relevance plus the adjustment, plus a little for news-like paths."""
    news = F.when(F.lower(path(url)).rlike(NEWS_PATH), F.lit(WEIGHTS["news"])).otherwise(F.lit(0.0))
    return F.when(~blocked_for_browse(url, kind), F.round(relevance + quality_adjustment(url, kind) + news, 6))


def url_key(url: Column) -> Column:
    """Trimmed, without fragment, trailing slashes and leading www., lower-cased."""
    u = F.lower(F.regexp_replace(F.substring_index(F.trim(blank(url)), "#", 1), r"/+$", ""))
    return F.regexp_replace(u, r"^(https?://)www\.", "$1")


def normalize_http(url: Column) -> Column:
    u = F.trim(blank(url))
    u = F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.when(u.rlike(r"(?i)^https?://"), u)


def hostname(url: Column) -> Column:
    """Host as a resolver sees it: no user, port or brackets."""
    n = F.regexp_replace(F.lower(netloc(url)), r"^.*@", "")
    return F.when(F.startswith(n, F.lit("[")), F.regexp_extract(n, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(n, ":", 1))


def _ipv4(h: Column) -> Column:
    parts = F.transform(F.split(h, r"\."), lambda x: x.try_cast("long"))
    value = parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * (1 << 8) + parts[3]
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(h.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), value)


def net_range(net: str) -> tuple[int, int]:
    at, bits = net.split("/")
    a, b, c, d = map(int, at.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return low, low + (1 << (32 - int(bits))) - 1


def host_not_public(h: Column) -> Column:
    """Localhost, metadata hosts, and addresses that aren't public (IPv6: by their literal prefixes)."""
    bare = F.regexp_replace(h, r"\.+$", "")
    ip = _ipv4(bare)
    out = (bare == "") | bare.isin(*METADATA_HOSTS) | (bare == "localhost") | F.endswith(bare, F.lit(".localhost"))
    for net in BLOCKED_NETS:
        out = out | F.coalesce(ip.between(*net_range(net)), F.lit(False))
    return out | bare.rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$")


def policy_reason(url: Column, allowed=(), paths=BLOCKED_PATHS) -> Column:
    """Why a URL may not be visited; empty if it may."""
    raw = F.trim(blank(url))
    raw = F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).otherwise(raw)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    h = hostname(raw)
    out = (
        F.when(raw == "", F.lit("empty_url"))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("bad_scheme:"), F.when(scheme == "", F.lit("none")).otherwise(scheme)))
        .when(h == "", F.lit("no_host"))
        .when(host_not_public(h), F.lit("blocked_host_private_or_loopback"))
    )
    if allowed:
        out = out.when(~has_suffix(h, [a.lower().strip().lstrip(".") for a in allowed]), F.lit("host_not_in_allowlist"))
    for frag in paths:
        out = out.when(F.contains(F.lower(path(raw)), F.lit(frag)), F.lit(f"blocked_path:{frag}"))
    return out.otherwise(F.lit(""))


def repo_key(url: Column) -> Column:
    """code host/owner/name for repository pages, else the URL without fragment and trailing slashes, lower-cased."""
    key = F.lower(F.regexp_replace(F.substring_index(blank(url), "#", 1), r"/+$", ""))
    parts = F.filter(F.split(path(key), "/"), lambda x: x != "")
    repo = F.contains(netloc(key), F.lit("github.com")) & (F.size(parts) >= 2)
    return F.when(repo, F.concat(F.lit("github.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)))).otherwise(key)


def browse_key(url: Column) -> Column:
    """Without query and trailing slashes, lower-cased."""
    return F.lower(F.regexp_replace(F.substring_index(blank(url), "?", 1), r"/+$", ""))
