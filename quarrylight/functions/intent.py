"""What a question asks for, and how it is rewritten for a search engine, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import java
from .text import collapse
from .urls import blank, contains_any

# ---- Fixed values: lexicons, patterns and templates -------------------------------------------------------------
#: Small talk. The built-in lists are short; callers pass longer ones.
TRIVIAL_PHRASES = ("thank you", "thanks a lot", "how are you", "как дела", "спасибо большое", "good morning", "see you", "got it", "all good", "до свидания", "не понял", "ну ладно")
TRIVIAL_TOKENS = ("ok", "okay", "yes", "no", "thanks", "thx", "hi", "hello", "hey", "there", "bye", "cool", "great", "да", "нет", "ок", "спасибо", "привет", "пока", "ага", "угу", "ладно", "хорошо", "da")
GREETING_HINTS = (
    "привет приветик здравствуй здравствуйте добрый доброе доброй доброго салют хай хелло хеллоу hello hi hey heya hiya howdy yo sup wassup morning evening gm gn good"
).split()
GREETING_PHRASES = ("good morning", "good afternoon", "good evening", "good night", "how are you", "как дела")
NO_KEYWORDS = ("привет", "пока", "спасибо", "пожалуйста", "hello", "bye", "thanks", "please")
TRIVIAL_NO = (
    r"^(привет|хай|хеллоу|hello|hi|hey|добрый (день|вечер|утро))[!.,\s]*$",
    r"^(как дела|how are you|как ты)[?!.,\s]*$",
    r"^(спасибо|thanks|thank you|ок|окей|ok|понял|понял[аи]?|хорошо|ладно)[!.,\s]*$",
    r"^(да|нет|yes|no|ага|угу|не понял|что\??)[?!.,\s]*$",
    r"^\d[\d\s\+\-\*\/\.\,\%\(\)]+[=\?]?\s*$",
    r"(посчитай|рассчитай|вычисли|calculate|compute)\s+[\d]",
    r"(ты (говорил|сказал)|раньше (ты|ты говорил)|в начале разговора)",
)
MORE_NO = (
    r"^(что такое|объясни|расскажи про|как работает|что значит|what is|explain|how does)\s+\w",
    r"(биография|кто такой|definition of)\s+\w",
    r"(проанализируй|разбор|анализ)\s+(мо[йея]|эт[иоа]|эту|этот)",
    r"^(помоги мне|посоветуй|как ты думаешь|что думаешь|как мне)\s",
    r"^(я хочу|я думаю|я чувствую|мне кажется)\s",
)
YES_RULES = (
    ("currency_rate", (
        r"курс (доллара|евро|рубля|тенге|юаня|фунта|\w+) (сейчас|сегодня|на сегодня|на данный момент)",
        r"(сколько стоит|цена) (доллар|евро|рубл|тенге|юань)",
        r"(usd|eur|gbp|jpy|cny|kzt|rub).*(курс|цена|стоит)",
        r"exchange rate.*(today|now|current)",
        r"(dollar|euro|pound).*(rate|price|worth) (now|today)",
    )),
    ("crypto_price", (
        r"(биткоин|bitcoin|btc|ethereum|eth|крипт\w+).*(цена|стоит|курс|rate|price)",
        r"(цена|курс|стоит).*(биткоин|bitcoin|btc|eth|ethereum|crypto)",
        r"crypto (price|rate|market)",
        r"(сколько стоит|price of).*(btc|eth|bnb|solana|sol|usdt|usdc)",
    )),
    ("stock_price", (
        r"(акции|акция|shares?|stocks?).*(цена|стоит|курс|price|value|worth)",
        r"(цена акций|стоимость акций|котировки)",
        r"(apple|tesla|google|microsoft|amazon|nvidia|sber|gazprom|лукойл).*(акции|stock|share|price)",
        r"(nasdaq|s&p|sp500|dow jones|ммвб|moex).*(сейчас|сегодня|today|now|current)",
    )),
    ("interest_rate", (
        r"(ставка цб|ключевая ставка|ставка рефинансирования).*(сейчас|сегодня|текущ)",
        r"(цб|центробанк|фрс|fed|ecb).*(ставк|rate|решени)",
        r"(current|today).*(interest rate|base rate|key rate)",
        r"(ипотека|mortgage|вклад|deposit).*(процент|ставка|rate).*(сейчас|сегодня|лучш|топ)",
    )),
    ("financial_news", (
        r"(что|почему|зачем).*(упал|вырос|рухнул|обвалился|взлетел|скачок|сдулся)",
        r"(последние|свежие|актуальные) (новости|события)",
        r"(что сейчас|что происходит) (с|в|на)\s+\w",
        r"(news|latest|recent)\s+(about|on|for|in)\s+\w",
        r"(новости|события) (сегодня|сейчас|на этой неделе|за последнее время)",
    )),
    ("economic_data", (
        r"(инфляция|inflation).*(сейчас|сегодня|официальная|текущ|процент|уровень)",
        r"(ввп|gdp).*(текущ|current|today|рост|latest)",
        r"(безработица|unemployment).*(уровень|сейчас|данные)",
        r"(экономические показатели|economic indicators).*(текущ|last|latest)",
    )),
    ("company_info", (
        r"\w+\s+(новости|отчёт|прибыль|релиз|обновление|версия|вышла?|вышел|запустил)",
        r"(компания|проект|продукт|стартап|бренд).*(последн|recent|latest).*(новост|news|отчёт|report)",
        r"(версия|release|update|вышл\w+).*(сейчас|сегодня|последн|latest|current)",
    )),
    ("regulatory", (
        r"(новый|изменения в|поправки к).*(закон|регулирование|регулятор|правил)",
        r"(закон|law|regulation|rule).*(изменения|changes|новый|new|2025|2026)",
        r"(вступил в силу|вступает|новые правила|новые требования).*(2025|2026|\w+)",
    )),
    ("general", (
        r"(gpt|claude|gemini|llama|mistral|openai|anthropic|google).*(новый|latest|версия|release|вышел|update)",
        r"(iphone|android|windows|macos|linux).*(вышел|релиз|обновление|версия|latest)",
        r"(новая версия|latest version|current version|вышел) \w+",
        r"(искусственный интеллект|ai|ии).*(новости|достижения|прорыв|что нового|latest)",
    )),
    ("general", (
        r"(счёт|результат|итог).*(матч|игра|турнир|чемпионат).*(сейчас|сегодня|вчера)",
        r"(кто выиграл|кто победил|выиграл).*(матч|чемпионат|турнир)",
        r"(score|result|winner).*(match|game|tournament).*(today|yesterday|now|current)",
    )),
)
TIME_TRIGGERS = (
    r"\bсейчас\b", r"\bна данный момент\b", r"\bсегодня\b", r"\bна сегодня\b", r"\bна этой неделе\b", r"\bв этом месяце\b", r"\bв этом году\b", r"\bнедавно\b",
    r"\bпоследн\w+\b", r"\bактуальн\w+\b", r"\bтекущ\w+\b", r"\bnow\b", r"\btoday\b", r"\bcurrent(ly)?\b", r"\brecent(ly)?\b", r"\blatest\b", r"\bthis (week|month|year)\b", r"\bin 2026\b",
)
TIME_SENSITIVE = (
    "курс акци крипт биткоин ставка вклад депозит ипотека кредит рынок индекс валют инфляц ввп экономик налог процент rate stock crypto bitcoin deposit mortgage market "
    "inflation gdp economy tax версия релиз обновление вышел вышла release version update launched новости события цена стоимость news events price score result"
).split()
QUERY_TEMPLATES = {
    "currency_rate": " курс сегодня",
    "crypto_price": " цена сейчас",
    "stock_price": " котировки",
    "interest_rate": " {year}",
    "economic_data": " данные {year}",
    "company_info": " последние новости {year}",
    "regulatory": " изменения {year}",
    "product_rates": " {year}",
}
REQUEST_NOISE = (
    r"(скажи|расскажи|напиши|покажи|найди|подскажи|помоги)\s+(мне\s+)?",
    r"(хочу знать|хочу узнать|интересует|интересно)\s+",
    r"(можешь|может ли ты|мог бы ты)\s+",
    r"(пожалуйста|плз|please)\s*",
)
CATEGORIES = (
    "currency_rate", "crypto_price", "stock_price", "interest_rate", "financial_news", "economic_data", "company_info", "regulatory", "product_rates", "general_finance", "general",
)
RECENT_CATEGORIES = ("currency_rate", "crypto_price", "stock_price", "interest_rate", "financial_news")
ESSAY = (
    r"(проанализируй|проанализировать|собери\s+актуальн|на\s+основе\s+свежих|обязательно\s+опирайся|структурируй|дай\s+прогноз|"
    r"\banalyze\b|\bresearch\b|\bbased\s+on\s+(fresh|recent|live)\b|\bmust\s+cite\b|\bgive\s+a\s+forecast\b)"
)
LEAD_VERB = r"^(проанализируй|проанализировать|собери|собрать|найди|подбери|сделай|investigate|analyze|research|gather|compare|find)\s+"
INSTRUCTION_PREFIX = r"^(?:проанализируй|проанализировать|собери|собрать|найди|подбери|сделай|investigate|analyze|analyse|research|gather|compare|find|please)\s+"
DELIVERABLE = r",?\s*(и\s+на\s+основе|и\s+дай|дай\s+прогноз|обязательно|структурируй|based\s+on|give\s+a\s+forecast|must\s+cite)\b"
TOPIC_DELIVERABLE = r",?\s*(и\s+на\s+основе|и\s+сделай|структурируй|только\s+по\s+источникам|предложи|with\s+justification|based\s+on\s+sources)\b"
WEATHER = r"(погод\w*|weather|температур\w*|temperature|forecast)\b"
NOW = r"(сейчас|current|right\s+now|today|сегодня|live|актуальн)"
FX = r"(курс|exchange\s*rate|fx\b|eur\s*/?\s*usd|usd\s*/?\s*rub|доллар\w*\s+к\s+руб|ключев\w*\s+ставк)"
SPOT = r"(сколько\s+стоит|price\s+of|spot\s+price|котировк|brent|bitcoin|btc\b)"
STALE_WEATHER = (
    r"(climate|climatic|monthly\s+average|average\s+weather|historical\s+weather|среднегодов|климат\w*|средн\w*\s+(месяч|температур)|normals?|"
    r"pogodaiklimat|climate-data|climate\.|yearly\s+weather)"
)
STALE_FX = r"(historical\s+rates?|history\s+of|за\s+10\s+лет|архив\s+курс|chart\s+history)"
LIVE = r"(today|current|now|live|сейчас|почас|hourly|accuweather|wunderground|timeanddate|weather\.com|/weather/|meteoblue|msn\.com/weather)"
VIDEO = (
    r"(youtube|youtu\.be|ютуб|rutube|рутуб|vimeo|tiktok|тикток|видео|ролик|клип|трейлер|trailer|live\s*stream|стрим|watch\s+on|найди\s+видео|"
    r"подборка\s+видео|video\s+about|youtube\s+search)"
)
IMAGE = (
    r"(freepik|фрипик|pinterest|пинтерест|unsplash|shutterstock|pixabay|depositphotos|istock|adobe\s*stock|getty|стоков|stock\s*photo|stock\s*image|фото\s+на|картинк|"
    r"изображени|иллюстрац|обои|wallpaper|moodboard|референс|reference\s+photo|найди\s+фото|поиск\s+фото|stock\s+footage)"
)
RESEARCH_INTENT = (
    r"(проанализируй|проанализировать|анализ\b|собери\b|собрать\b|найди\s+лучш|лучшее\s+жиль|цена\s*[-/]?\s*качество|price\s*[-/]?\s*quality|"
    r"обзор\s+рынка|весь\s+рынок|рынок\s+\w+|market\s+analysis|deep\s*dive|research\b|gather\s+all|all\s+data|все\s+данн|"
    r"по\s+всему\s+региону|во\s+вс[её]м\s+регионе|neighborhoods|районы|сравни\s+.+\s+и\s+|compare\s+.+\s+(and|vs)|"
    r"рейтинг|ранжир|подбери|рекоменд|investigate|comprehensive)"
)
RESEARCH_SHAPE = (
    r"(проанализируй|проанализировать|анализ\b|собери\b|собрать\b|сравни\b|compare\b|research\b|investigate|comprehensive|обзор\s+рынка|deep\s*dive|gather\s+all)"
)
RESEARCH_TOPIC = r"(анализ|данные|рынок|регион|лучш|market|data|best)"
SIMPLE_FACT = (
    r"(сколько\s+(сейчас\s+)?(стоит|курс)|какая\s+сейчас\s+(цена|погода)|кто\s+сейчас\s+(ceo|директор|президент\s+\w+)|"
    r"what('s| is)\s+the\s+(price|rate|weather)|price\s+of\s+\w+\s*$)"
)
COMPARE = r"\b(сравни|compare|vs\.?|versus|против)\b"
FUNCTION_WORDS = (
    "a an the and or but if as at by for from into of on to with vs versus than this that these those what which when where how why who whom all any some not no "
    "и в во на по для из к ко о об обо от до при без над под перед через между как что это или но же ли бы не ни уже ещё еще только также тоже очень есть быть был была были будет "
    "всем всей всех всему всё все этот эта эти"
).split()
_LETTER = "A-Za-zА-Яа-яЁёÁÉÍÓÚÄÖÜÑáéíóúäöüñ"
PLACE = rf"(?:\bв\b|\bin\b|\bat\b|\bдля\b|\bпо\b|\bof\b|\bрегионе\b|\bрайоне\b|\bcity\s+of\b|\bcountry\s+of\b)\s+([{_LETTER}][{_LETTER}-]{{1,}})"
# -----------------------------------------------------------------------------------------------------------------


def _has(x: Column, pattern: str) -> Column:
    return blank(x).rlike(java(pattern))


def _any(x: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | _has(x, p)
    return out


def words_of(x: Column) -> Column:
    return F.filter(F.split(collapse(blank(x)), " "), lambda w: w != "")


def strip_chars(x: Column, chars: str) -> Column:
    """Python's strip with a set of characters."""
    return F.regexp_replace(x, rf"^[{chars}]+|[{chars}]+$", "")


def word_edge(x: Column, limit: int) -> Column:
    """x cut to the limit at the last space inside it."""
    cut = F.substring(x, 1, limit)
    return F.when(F.length(x) <= limit, x).otherwise(F.regexp_replace(cut, r"(?s) [^ ]*$", ""))


def normalize_trivial(x: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(blank(x)), r"[!?.,;:…]+", " "))


def is_trivial(x: Column, phrases=TRIVIAL_PHRASES, tokens=TRIVIAL_TOKENS) -> Column:
    n = normalize_trivial(x)
    w = F.split(n, " ")
    return (n == "") | n.isin(*phrases) | ((F.size(w) <= 5) & F.forall(w, lambda t: t.isin(*tokens)))


def is_greeting(x: Column) -> Column:
    n = normalize_trivial(x)
    return (n != "") & (F.arrays_overlap(F.split(n, " "), F.array(*[F.lit(h) for h in GREETING_HINTS])) | contains_any(n, GREETING_PHRASES))


def _short_no(x: Column) -> Column:
    return (F.size(words_of(x)) <= 2) & contains_any(F.lower(blank(x)), NO_KEYWORDS)


def is_trivial_no(x: Column) -> Column:
    return is_trivial(x) | _short_no(x) | _any(F.trim(blank(x)), TRIVIAL_NO)


def is_definitely_no(x: Column) -> Column:
    return _short_no(x) | _any(F.trim(blank(x)), TRIVIAL_NO + MORE_NO)


def yes_category(x: Column) -> Column:
    """The first rule group that fits; null without one."""
    out = F.lit(None).cast("string")
    for category, patterns in reversed(YES_RULES):
        out = F.when(_any(F.lower(blank(x)), patterns), F.lit(category)).otherwise(out)
    return out


def optimize_query(x: Column, category: Column, year: int) -> Column:
    q = F.trim(blank(x))
    for p in REQUEST_NOISE:
        q = F.regexp_replace(q, java(p), "")
    q = F.trim(strip_chars(F.trim(q), "?.!,;:"))
    w = words_of(q)
    q = F.when(F.size(w) > 10, F.array_join(F.slice(w, 1, 10), " ")).otherwise(q)
    tail = F.lit("")
    for c, t in QUERY_TEMPLATES.items():
        tail = F.when(category == c, F.lit(t.replace("{year}", str(year)))).otherwise(tail)
    return F.trim(F.concat(q, tail))


def has_time_trigger(x: Column) -> Column:
    return _any(F.lower(blank(x)), TIME_TRIGGERS)


def has_time_sensitive(x: Column) -> Column:
    return contains_any(F.lower(blank(x)), TIME_SENSITIVE)


def legacy_decision(messages: DataFrame, year: int) -> DataFrame:
    """messages (.., message) plus the rule cascade's columns: skip, category rules, time rule, else no search.

    The rules are columns of a projection of their own, so that each is evaluated once a row.
    """
    m = F.col("message")
    rules = messages.withColumn("no", is_definitely_no(m)).withColumn("yes", yes_category(m)).withColumn("timed", has_time_trigger(m) & has_time_sensitive(m))
    found = rules.withColumn("category", F.when(~F.col("no"), F.coalesce("yes", F.when(F.col("timed"), F.lit("general")))))
    found = found.withColumn("should_search", F.col("category").isNotNull())
    by_rule = F.col("should_search") & F.col("yes").isNotNull()
    return found.select(
        *messages.columns,
        "should_search",
        "category",
        F.when(F.col("should_search"), optimize_query(m, F.col("category"), year)).otherwise(F.lit("")).alias("search_query"),
        F.when(by_rule, F.lit(0.95)).when(F.col("should_search"), F.lit(0.8)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("no"), F.lit("Tier 1: heuristic skip"))
        .when(by_rule, F.concat(F.lit("Tier 2: matched "), F.col("yes")))
        .when(F.col("timed"), F.lit("Tier 2: time trigger + domain term"))
        .otherwise(F.lit("No signal found, default no-search"))
        .alias("reason"),
    )


def compact_query(q: Column, goal: Column, year: int) -> Column:
    """Short queries as they are; essays without lead verb and deliverables, ten words, 240 characters."""
    q, g = F.trim(blank(q)), F.trim(blank(goal))
    short = (q != "") & (F.length(q) <= 180) & (F.length(q) - F.length(F.replace(q, F.lit(" "), F.lit(""))) <= 24) & ~_has(q, ESSAY)
    base = F.when((q != "") & ((g == "") | (F.length(q) <= F.length(g))), q).otherwise(g)
    cleaned = F.trim(F.regexp_replace(base, java(LEAD_VERB), ""))
    cleaned = strip_chars(F.regexp_replace(cleaned, java(rf"(?s){DELIVERABLE}.*$"), ""), " ,;:")
    cleaned = F.when(F.length(cleaned) < 8, base).otherwise(cleaned)
    best = optimize_query(cleaned, F.lit("general"), year)
    compact = word_edge(collapse(F.when(best == "", cleaned).otherwise(best)), 240)
    return (
        F.when(short, F.substring(collapse(q), 1, 240)).when(base == "", F.lit("")).otherwise(F.when(compact == "", F.substring(base, 1, 240)).otherwise(compact))
    )


def needs_compaction(q: Column) -> Column:
    q = blank(q)
    return (F.length(q) > 240) | (F.length(q) - F.length(F.replace(q, F.lit(" "), F.lit(""))) > 28)


def is_current_fact(x: Column) -> Column:
    m, now = blank(x), _has(x, NOW)
    return _has(m, WEATHER) | _has(m, FX) | (_has(m, SPOT) & (now | (F.length(m) < 80))) | (now & (F.length(m) < 120))


def shape_live_query(message: Column, query: Column) -> Column:
    m = blank(message)
    q = F.trim(F.when(blank(query) != "", blank(query)).otherwise(m))
    low = F.lower(q)
    add = lambda live, tail: F.when(~_has(low, live), F.trim(F.concat(q, F.lit(tail)))).otherwise(q)
    shaped = (
        F.when(_has(m, WEATHER), add(r"(current|today|сейчас|live|right\s+now)", " current weather today temperature"))
        .when(_has(m, FX), add(r"(current|live|today|сейчас|spot)", " current live rate today official"))
        .when(_has(m, SPOT) & (F.length(m) < 100), add(r"(current|live|today|сейчас|spot|price)", " current price today"))
        .otherwise(q)
    )
    return F.substring(collapse(shaped), 1, 240)


def media_intent(x: Column) -> Column:
    video, image = _has(x, VIDEO), _has(x, IMAGE)
    return F.when(video & image, F.lit("mixed")).when(video, F.lit("video")).when(image, F.lit("image"))


def augment_for_media(q: Column, message: Column, kind: Column) -> Column:
    q = F.trim(blank(q))
    low = F.lower(F.concat(q, F.lit(" "), blank(message)))
    has = lambda *xs: contains_any(low, xs)
    site = lambda tag, text: F.when(~has(tag), F.lit(text))
    video = F.when(
        kind.isin("video", "mixed"),
        F.when(has("tiktok", "тикток"), site("site:tiktok.com", " (site:tiktok.com)"))
        .when(has("rutube", "рутуб"), site("site:rutube.ru", " (site:rutube.ru)"))
        .when(has("vimeo"), site("site:vimeo.com", " (site:vimeo.com)"))
        .when(~has("site:youtube.com", "youtu.be"), F.lit(" (site:youtube.com OR site:youtu.be)")),
    )
    image = F.when(kind.isin("image", "mixed") & ~has("freepik"), F.lit(" (site:freepik.com OR site:pinterest.com OR site:unsplash.com)"))
    return F.trim(F.concat(q, F.coalesce(video, F.lit("")), F.coalesce(image, F.lit(""))))


def language(x: Column) -> Column:
    n = F.length(F.regexp_replace(blank(x), r"[^\x{0400}-\x{04FF}]", ""))
    return F.when(n > F.length(blank(x)) * 0.2, F.lit("lang_ru")).otherwise(F.lit("lang_en"))


def date_restrict(category: Column) -> Column:
    return F.when(category.isin(*RECENT_CATEGORIES), F.lit("d7")).otherwise(F.lit("m3"))


def is_deep_research(x: Column) -> Column:
    m = F.trim(blank(x))
    clauses = F.length(m) - F.length(F.regexp_replace(m, r"[,.?]", "")) >= 2
    return (F.length(m) >= 40) & (_has(m, RESEARCH_INTENT) | ((F.length(m) >= 160) & clauses & _has(m, RESEARCH_TOPIC)))


def should_orchestrate(x: Column, depth: Column, verified: Column) -> Column:
    m, deep, compare = F.trim(blank(x)), is_deep_research(x), _has(F.trim(blank(x)), COMPARE)
    veto = _has(m, SIMPLE_FACT) & ~compare & ~deep
    wants = deep | (compare & (F.length(m) >= 40)) | ((depth == "deep") & (F.length(m) >= 120)) | (verified & (F.length(m) >= 80))
    return (m != "") & ~veto & wants


def effective_depth(x: Column, depth: Column) -> Column:
    m = F.trim(blank(x))
    return F.when((depth == "fast") & (F.length(m) < 160) & ~_has(m, RESEARCH_SHAPE), F.lit("fast")).otherwise(F.lit("deep"))


def keep_first(values: Column, key, most: int, kind: str = "array<string>") -> Column:
    """The first `most` values whose key has not come before, in order."""

    def add(kept, v):
        again = F.exists(kept, lambda k: key(k) == key(v))
        return F.when((F.size(kept) >= most) | again, kept).otherwise(F.array_append(kept, v))

    return F.aggregate(values, F.array().cast(kind), add)


def _acronym(w: Column) -> Column:
    return (F.length(w) <= 4) & w.rlike(r"\p{Lu}") & (w == F.upper(w))


def place_tokens(x: Column, most: int = 8) -> Column:
    """Words after a locative preposition, without function words and acronyms, each once."""
    found = F.transform(F.regexp_extract_all(blank(x), F.lit(java(PLACE)), F.lit(1)), lambda w: strip_chars(w, r" \-.,;:"))
    kept = F.filter(found, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*FUNCTION_WORDS) & ~_acronym(w))
    return keep_first(kept, F.lower, most)


def content_nouns(x: Column, most: int = 10) -> Column:
    """Words of four letters or more, without lead verb, function words, places and acronyms, lower-cased, each once."""
    raw = F.regexp_replace(F.trim(blank(x)), java(INSTRUCTION_PREFIX), "")
    w = F.regexp_extract_all(raw, F.lit("[A-Za-zА-Яа-яЁё]{4,}"), F.lit(0))
    kept = F.transform(F.filter(w, lambda t: ~F.lower(t).isin(*FUNCTION_WORDS) & ~_acronym(t)), F.lower)
    return F.slice(F.array_except(kept, F.transform(place_tokens(x), F.lower)), 1, most)


def topic_core(message: Column, primary: Column) -> Column:
    raw = F.trim(F.when(blank(primary) != "", blank(primary)).otherwise(blank(message)))
    raw = F.regexp_replace(raw, java(LEAD_VERB), "")
    raw = F.regexp_replace(raw, r"(?s)[:：].*$", "")
    raw = F.regexp_replace(raw, java(rf"(?s){TOPIC_DELIVERABLE}.*$"), "")
    raw = word_edge(strip_chars(collapse(raw), " ,;"), 120)
    return F.trim(F.when(raw == "", F.substring(blank(message), 1, 120)).otherwise(raw))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def depth_from_llm(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)) == "fast", F.lit("fast")).otherwise(F.lit("deep"))


def category_from_llm(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(x.isNull() | v.isin("", "null"), F.lit(None).cast("string")).when(v.isin(*CATEGORIES), v).otherwise(F.lit("general"))


