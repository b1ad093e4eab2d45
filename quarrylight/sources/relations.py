"""Base relations over the driver tables, as DataFrames and as the equal DuckDB subqueries.

Driver pages have plain addresses only, so `urls` and `hits` cross them, row by row, with lists of hosts, paths and
texts of every shape that the functions tell apart; `messages` does so with questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.regex import sql_list

HOSTS = (
    "www.example.com", "Example.ORG", "blog.example.net:8080", "instagram.com", "www.tiktok.com", "i.pinimg.com", "pinterest.com", "ru.pinterest.ru",
    "www.youtube.com", "youtu.be", "m.youtube.com", "vimeo.com", "unsplash.com", "www.freepik.com", "stock.adobe.com", "facebook.com", "old.reddit.com",
    "x.com", "t.me", "www.linkedin.com", "bit.ly", "t.co", "www.census.gov", "data.gov.uk", "stat.gov.kz", "mit.edu", "www.ox.ac.uk", "worldbank.org",
    "ec.europa.eu", "investors.example.com", "ir.example.org", "github.com", "gist.github.com", "notinstagram.com", "localhost", "api.localhost",
    "10.1.2.3", "127.0.0.1:9000", "169.254.169.254", "172.20.0.5", "192.168.1.10", "8.8.8.8", "metadata.google.internal", "[::1]", "[2001:db8::1]", "xgov",
)
PATHS = (
    "", "/", "/news/today", "/article/42?id=7#top", "/accounts/login?next=/home", "/login", "/i/flow/login", "/tag/markets/", "/category/x/page/3", "/amp/story",
    "/investor-relations/results", "/press-releases/2024-q1", "/press-release/2024/q1/", "/statistics/gdp?year=2024", "/annual-report/2023", "/market-size-report-2030",
    "/research-report/oil", "/owner/name/issues/5", "/Owner/Name", "/converter/doge", "/checkout/cart", "/reset-password", "/World/politics/1", "/a/b/c/", "/signin?x=1",
    "/about-us/news/", "/datasets/air", "/search/?q=a", "/wallet#x", "/x?q=https://other.example/a",
)
SCHEMES = ("https://", "http://", "ftp://", "//", "", "HTTPS://", " https://")
SNIPPETS = (
    "The price is $1,234.50 today and 12% up.", "No figures here at all.", "Subscribe now to read; cookies and privacy policy.", "Rates: 4.75% on 2024-05-06, 3,5% before.",
    "Temperature 22.5 in Paris, 23 in Lyon.", "Click here to win at the casino", "Revenue of 75.2 billion USD, up from 70.1 billion.", "Posted Mar 3, 2024 by the desk in Berlin",
    "climate monthly average for the region", "live updates hourly forecast", "опубликовано 12 мая 2023 в Москве, курс 92,5 руб", "See https://example.com/" + "long-path-" * 14 + "end for 7 more",
    "stars: 31k stars on github, 38,2k stars elsewhere", "Total 1900 units and 2024 more; 10 000 EUR", "access denied", "",
)
MESSAGES = (
    "thanks!", "ok", "Привет", "hello there", "2 + 2 * 3 =", "what is the exchange rate of the dollar today", "курс доллара сейчас", "bitcoin price now",
    "tesla stock price today", "current interest rate of the fed", "latest news about oil in Germany", "inflation in France current level", "новый закон о налогах 2026",
    "latest version of linux", "кто выиграл матч вчера", "weather in Paris", "погода в Москве сейчас", "find video about cats on youtube", "найди фото природы", "watch trailer and wallpaper",
    "compare rents in Berlin and Munich for families", "Analyze the market of electric cars in Norway, based on fresh data, and give a forecast for the next five years",
    "please find apartments for rent", "explain recursion", "What happened in Brooklyn at the market of Flatiron?", "price of brent", "сколько стоит билет",
    "research the open source framework landscape: langgraph vs crewai github stars, sdk maturity, community, cost and risk", "eur/usd", "show me tiktok videos",
    "Собери актуальные данные по рынку аренды в Алматы: цены, районы, прогноз", "how many stars has microsoft/autogen on github",
    "repo:owner/tool-thing and https://github.com/pallets/flask/tree/main", "спасибо большое", "da", "сравни ипотеку и вклады по ставкам в банках для семьи",
    "Who is the president?", "latest release update of the phone today", "GDP growth", "",
)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _pick_sql(values, index: str) -> str:
    return f"list_extract({sql_list(values)}, cast({index} as bigint) % {len(values)} + 1)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, kind): each page's address, and made ones of every host, path and scheme; kind is a media wish."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    kind = _pick(("", "video", "image", "mixed"), F.col("page_id"))
    n = F.floor(F.col("page_id") / 7)
    made = F.concat(_pick(SCHEMES, F.when(n % 3 == 0, F.col("page_id")).otherwise(F.lit(0))), _pick(HOSTS, F.col("page_id") * 5 + n), _pick(PATHS, F.col("page_id")))
    own = pages.select((F.col("page_id") * 2).alias("id"), "url", kind.alias("kind"))
    return own.union(pages.select((F.col("page_id") * 2 + 1).alias("id"), made.alias("url"), kind.alias("kind")))


_KIND_SQL = _pick_sql(("", "video", "image", "mixed"), "page_id")
_MADE_SQL = (
    _pick_sql(SCHEMES, "case when (page_id // 7) % 3 = 0 then page_id else 0 end")
    + " || "
    + _pick_sql(HOSTS, "(page_id * 5 + page_id // 7)")
    + " || "
    + _pick_sql(PATHS, "page_id")
)
URLS = f"(select page_id * 2 as id, url, {_KIND_SQL} as kind from pages union all select page_id * 2 + 1, {_MADE_SQL}, {_KIND_SQL} from pages)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, message): the questions, one for each turn, and the turns' own texts."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("n"), "text")
    return turns.select((F.col("n") * 2).alias("id"), F.col("text").alias("message")).union(
        turns.select((F.col("n") * 2 + 1).alias("id"), _pick(MESSAGES, F.floor(F.col("n") / 100) + F.col("n") % 100).alias("message"))
    )


MESSAGES_SQL = f"""(select (conv_id * 100 + turn) * 2 as id, text as message from conversations
 union all select (conv_id * 100 + turn) * 2 + 1, {_pick_sql(MESSAGES, "(conv_id + turn)")} from conversations)"""


#: Questions, and the pages whose hits they share out: a query has 50 hits at most, whatever the scale.
N_QUERIES, BLOCK = len(MESSAGES), 50 * len(MESSAGES)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, message): the questions, asked anew for every block of pages."""
    blocks = read(spark, sf_dir, "pages").agg(F.coalesce(F.floor(F.max("page_id") / BLOCK), F.lit(0)).alias("m"))
    ids = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("m") + 1) * N_QUERIES - 1).cast("long"))).alias("query_id"))
    return ids.select("query_id", _pick(MESSAGES, F.col("query_id")).alias("message"))


QUERIES_SQL = f"""(select query_id, {_pick_sql(MESSAGES, "query_id")} as message from (select unnest(range(0, cast((m + 1) * {N_QUERIES} as bigint))) as query_id
 from (select coalesce(max(page_id) // {BLOCK}, 0) as m from pages)))"""


def query_of(page: Column) -> Column:
    return F.floor(page / BLOCK) * N_QUERIES + page % N_QUERIES


def pos_of(page: Column) -> Column:
    return F.floor(page % BLOCK / N_QUERIES)


def within(query: Column, n: int) -> Column:
    """The query's number modulo n within its block: the first queries of a block."""
    return query - query % N_QUERIES + query % N_QUERIES % n


def within_sql(n: int, query: str = "query_id") -> str:
    return f"({query} - {query} % {N_QUERIES} + {query} % {N_QUERIES} % {n})"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits from pages: (query_id, pos, title, url, snippet, date, source, relevance, enriched_text)."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = F.concat(F.lit("https://"), _pick(HOSTS, F.col("page_id") * 5 + F.floor(F.col("page_id") / 7)), _pick(PATHS, F.col("page_id")))
    readable = text.html_to_text(F.col("html"))
    snip = F.concat(_pick(SNIPPETS, F.col("page_id") * 3 + F.floor(F.col("page_id") / 40)), F.lit(" "), F.substring(readable, 1, 160))
    u = F.when(F.col("page_id") % 3 == 0, made).otherwise(F.col("url"))
    body = F.concat(_pick(SNIPPETS, F.col("page_id")), F.lit(" "), readable)
    return p.select(
        query_of(F.col("page_id")).cast("long").alias("query_id"),
        pos_of(F.col("page_id")).cast("long").alias("pos"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        u.alias("url"),
        snip.alias("snippet"),
        F.when(F.col("page_id") % 4 == 0, F.lit("2024-05-06")).alias("date"),
        F.when(F.col("page_id") % 11 == 0, F.lit("github_api")).otherwise(F.regexp_extract("url", r"^https?://([^/?#]*)", 1)).alias("source"),
        F.round(1.0 - pos_of(F.col("page_id")) * 0.08, 2).alias("relevance"),
        F.when(F.col("page_id") % 2 == 0, body).alias("enriched_text"),
    )


READABLE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
 '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""
_POS = f"(page_id % {BLOCK} // {N_QUERIES})"
HITS = f"""(select page_id // {BLOCK} * {N_QUERIES} + page_id % {N_QUERIES} as query_id, {_POS} as pos, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title,
 case when page_id % 3 = 0 then 'https://' || {_pick_sql(HOSTS, "(page_id * 5 + page_id // 7)")} || {_pick_sql(PATHS, "page_id")} else url end as url,
 {_pick_sql(SNIPPETS, "(page_id * 3 + page_id // 40)")} || ' ' || substr(readable, 1, 160) as snippet,
 case when page_id % 4 = 0 then '2024-05-06' end as date,
 case when page_id % 11 = 0 then 'github_api' else regexp_extract(url, '^https?://([^/?#]*)', 1) end as source,
 round(1.0 - {_POS} * 0.08, 2)::double as relevance,
 case when page_id % 2 = 0 then {_pick_sql(SNIPPETS, "page_id")} || ' ' || readable end as enriched_text
 from (select *, {READABLE_SQL} as readable from pages))"""
