"""Literal cases for behaviour that the oracles' tables hardly show."""

import pytest
from pyspark.sql import functions as F

from quarrylight.config import PROFILES, EngineConfig
from quarrylight.functions import intent as I
from quarrylight.functions import numbers as N
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators import claims as C
from quarrylight.operators import evidence as E
from quarrylight.operators import guards as G
from quarrylight.operators import planning as P
from quarrylight.operators import rowsets as S

HIT = "query_id long, pos long, title string, url string, snippet string, date string, source string, relevance double, enriched_text string"


def one(spark, column, *values):
    """column(F.col('x')) for each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_questions(spark):
    assert one(spark, I.is_trivial, "thanks!", "", None, "How are you?", "what is the rate of the euro", "ok ok ok ok ok ok") == [True, True, True, True, False, False]
    assert one(spark, I.media_intent, "youtube clip and a wallpaper", "trailer", "stock photo", "rates") == ["mixed", "video", "image", None]
    assert one(spark, I.place_tokens, "rents in Berlin and in berlin, in EUR, of the City, для Алматы") == [["Berlin", "Алматы"]]
    essay = "Analyze " + "the rents of flats and houses " * 12 + ", based on fresh sources"
    assert one(spark, lambda x: I.compact_query(x, F.lit(""), 2026), "rates of the euro", essay)[0] == "rates of the euro"
    assert len(one(spark, lambda x: I.compact_query(x, F.lit(""), 2026), essay)[0].split()) == 10
    assert one(spark, I.language, "курс евро", "euro", None) == ["lang_ru", "lang_en", "lang_en"]


def test_urls(spark):
    bad = ["http://127.0.0.1/", "http://10.1.1.1", "http://169.254.1.1", "http://[::1]/", "http://localhost/", "http://a.localhost", "http://metadata/"]
    assert set(one(spark, U.policy_reason, *bad)) == {"blocked_host_private_or_loopback"}
    assert one(spark, U.policy_reason, "https://a.com/login", "a.com", "", "//a.com/x", "https://8.8.8.8/") == ["blocked_path:/login", "bad_scheme:none", "empty_url", "", ""]
    assert one(spark, U.url_key, "HTTPS://WWW.A.com/b/#c", "https://a.com/b") == ["https://a.com/b", "https://a.com/b"]
    weights = one(spark, lambda x: U.quality_adjustment(x, F.lit(None).cast("string")), "https://www.census.gov/x", "https://a.com/x", "https://instagram.com/x", "ftp://a")
    assert weights[0] > weights[1] > weights[2] and weights[3] == -0.5
    keys = one(spark, U.url_key, "https://www.a.com/x/", "https://a.com/x#y")
    assert one(spark, U.url_key, *keys) == keys


def test_numbers(spark):
    assert one(spark, N.parse_number, "1,234.5", "1.234,5", "3,5", "38 214", "1,234", "", "12d", ".5") == [1234.5, 1234.5, 3.5, 38214.0, 1234.0, None, None, 0.5]
    kinds = one(spark, lambda x: F.transform(N.claims(x), lambda c: F.struct(c["value"], c["kind"])), "31k stars, $75.2B, 12% and 3.75 GW")[0]
    assert [tuple(k) for k in kinds] == [(31000.0, "stars"), (75.2e9, "number"), (12.0, "percent"), (3.75, "power")]
    assert one(spark, N.page_numbers, "a 22.5, b-7 x9 1/2 2024-05") == [[22.5, 7.0, 2024.0, 5.0]]


def test_text_quality(spark):
    loop = "word " * 40
    assert one(spark, T.has_phrase_loop, loop, "| --- | --- | --- | --- | " * 8, "every word of this sentence differs from all others that came before it, and so nothing loops here at all") == [True, False, False]
    assert one(spark, T.clean_blob, "a  b", "Buy now!", "http://" + "x" * 200) == ["a b", "", "http://" + "x" * 113]
    rows = spark.createDataFrame([(1, "same " * 60), (2, ""), (3, None)], "id int, text string")
    assert {r.id: r.reasons for r in E.answer_quality(rows, "id").collect()} == {1: "phrase_loop,token_repetition", 2: "empty", 3: "empty"}


def test_readiness_and_conflict(spark):
    def hits(*pages):
        return spark.createDataFrame([(1, i, "t", f"https://h{i}.com", "", None, "s", 0.5, p) for i, p in enumerate(pages)], HIT)

    ask = spark.createDataFrame([(1, "temperature there")], "query_id long, message string")
    ready = lambda *p: E.answer_ready(hits(*p), ask, F.lit("fast")).first()
    assert ready("it is 22 degrees", "about 22 now").reason == "fast_multi_agree"
    assert ready("it is 10 degrees", "about 90 now").reason == "numeric_conflict"
    assert ready(None, None).reason == "no_enriched"
    bucketed = {r.query_id: r.conflict for r in E.conflicts(hits("v 100.0", "v 107.9", "v 5000")).collect()}
    assert bucketed == {1: False}


def test_deduplication_is_idempotent_and_ranks_are_a_subset(spark):
    rows = spark.createDataFrame([(1, i, "t", u, "s" * 30, None, "src", 0.5, None) for i, u in enumerate(["https://a.com", "HTTPS://A.com ", None, "", "https://b.com"])], HIT)
    once = S.keep_first(rows, S.merge_key(), ["pos"])
    assert sorted(r.pos for r in once.collect()) == [0, 2, 4]
    assert sorted(r.pos for r in S.keep_first(once, S.merge_key(), ["pos"]).collect()) == [0, 2, 4]
    top = S.rerank(rows, spark.createDataFrame([(1, "q")], "query_id long, message string"), 2)
    assert [r.pos for r in top.orderBy("rank").collect()] == [0, 2]  # an upper-case scheme is demoted
    assert S.keep_first(rows.limit(0), S.merge_key(), ["pos"]).count() == 0


def test_claims_against_primary_sources(spark):
    drafts = spark.createDataFrame([(1, 1, "It is $75.2 billion and $999 billion."), (2, 2, "About 40% of it.")], "draft_id long, query_id long, text string")
    evidence = spark.createDataFrame([(1, 0, "https://www.sec.gov/x", "revenue $75.2 billion"), (1, 1, "https://blog.com", "they say $999 billion"), (2, 0, "https://blog.com", "it was 40% then")], "query_id long, pos long, url string, text string")
    assert [(r.draft_id, r.verdict) for r in C.verify(drafts, evidence).orderBy("draft_id", "n").collect()] == [(1, "supported"), (1, "conflict"), (2, "supported")]
    answers = spark.createDataFrame([(1, 1, "see a.com"), (2, 1, "nothing"), (3, 9, "a.com")], "id long, query_id long, text string")
    allowed = spark.createDataFrame([(1, "https://www.a.com/x")], "query_id long, url string")
    assert {r.id: r.ok for r in C.citations_ok(answers, allowed).collect()} == {1: True, 2: False, 3: False}


def test_hedged_chain_closed_form(spark):
    calls = [(1, 0, 260.0, True), (1, 1, 50.0, True), (2, 0, 120.0, False), (2, 1, 400.0, False), (2, 2, 60.0, True), (3, 0, 500.0, False), (3, 1, 70.0, True), (4, 0, 10.0, False), (4, 1, 20.0, False)]
    rows = spark.createDataFrame(calls, "query_id long, priority long, latency double, ok boolean")
    assert {r.query_id: (r.winner, r.wall) for r in G.hedged_chain(rows, 200.0).collect()} == {1: (0, 260.0), 2: (2, 180.0), 3: (1, 500.0), 4: (None, 30.0)}
    assert {r.query_id: (r.winner, r.wall) for r in G.serial_chain(rows).collect()} == {1: (0, 260.0), 2: (2, 580.0), 3: (1, 570.0), 4: (None, 30.0)}


@pytest.mark.parametrize(("guard", "events", "want"), [
    (G.limiter(2, 10.0), [(0, "ok"), (1, "ok"), (2, "ok"), (10, "ok"), (10.5, "ok")], [True, True, False, False, True]),
    (G.breaker(2, 10.0), [(0, "error"), (1, "empty"), (2, "error"), (3, "ok"), (12, "error"), (13, "error"), (14, "ok")], [True, True, True, False, True, True, False]),
    (G.cooldown(4), [(1, "a"), (4, "A"), (5, "b"), (6, "a"), (10, "a")], [False, True, False, False, False]),
    (G.ttl_cache({"news": 5.0}, 10.0), [(0, "news"), (4, "news"), (5, "x"), (14, "x")], [False, True, False, True]),
])
def test_guard_steps(guard, events, want):
    state, step = guard
    got = []
    for t, outcome in events:
        state, decision = step(state, float(t), outcome)
        got.append(decision)
    assert got == want


def test_last_object_and_plans(spark):
    assert P.last_object('{"a": 1} noise {"search": true, "q": "}"} {') == '{"q": "}", "search": true}'
    assert P.last_object("no json") is None and P.last_object(None) is None
    assert one(spark, P.repositories, "https://github.com/pallets/flask.git and repo:a/tagging, microsoft/autogen github.com/x/issues") == [["pallets/flask", "a/tagging", "microsoft/autogen"]]


def test_configuration_is_clamped():
    assert EngineConfig(hedge_ms=99_999, max_agents=1).hedge_ms == 15_000 and EngineConfig(max_agents=1).max_agents == 2
    assert PROFILES["light"].max_results == 8 and EngineConfig().year == 2026


def test_waves_stop_after_the_first_ready_one(spark):
    pages = ["it is 22 degrees", "about 22 now", "it was 21", "90 once", "x", "y"]
    rows = spark.createDataFrame([(q, i, "t", f"https://h{i}.com", "", None, "s", 0.5, p if q == 1 else f"{10 ** i} units") for q in (1, 2) for i, p in enumerate(pages)], HIT)
    ask = spark.createDataFrame([(1, "temperature there"), (2, "units there")], "query_id long, message string")
    kept = E.early_stop(E.waves(rows, 2, 6), ask, F.lit("fast")).collect()
    assert sorted(r.pos for r in kept if r.query_id == 1) == [0, 1]
    assert sorted(r.pos for r in kept if r.query_id == 2) == [0, 1, 2, 3, 4, 5]


def test_facts_are_appended_once(spark):
    facts = P.fact_row(spark.createDataFrame([("a/tool", 5), ("b/other", 6)], "full_name string, stars long"))
    text = [(1, "see repo:a/tool and repo:b/other"), (2, "[STRUCTURED:github_api] repo=a/tool\nstars=5 repo:a/tool"), (3, "nothing")]
    out = {r.query_id: r.text for r in P.append_facts(spark.createDataFrame(text, "query_id long, text string"), facts).collect()}
    assert out[1] == text[0][1] + "\n\n[STRUCTURED:github_api] repo=a/tool\nstars=5\n\n[STRUCTURED:github_api] repo=b/other\nstars=6\n"
    assert out[2] == text[1][1] and out[3] == "nothing"


def test_payload_ladder(spark):
    rows = spark.createDataFrame([(1, "s" * 100), (2, "s" * 30_000)], "id int, synthesized string")
    hits = F.array(F.struct(F.lit("t").alias("title"), F.lit("e" * 3000).alias("enriched_text")))
    out = {r.id: r.json for r in P.shrink(rows.withColumn("results", hits), 25_000).collect()}
    assert "e" * 3000 in out[1] and "e" * 3000 not in out[2] and len(out[2]) < 25_000 and "s" * 20_000 in out[2]


def test_entry_urls_are_ranked_and_once(spark):
    urls = ["https://a.com/x?p=1", "https://www.census.gov/news/", "https://a.com/x?p=2", "https://instagram.com/p", "http://10.0.0.1/"]
    rows = spark.createDataFrame([(1, i, "t", u, "", None, "s", 0.5, None) for i, u in enumerate(urls)], HIT)
    out = S.entry_urls(rows, F.lit(None).cast("string")).orderBy("rank").collect()
    assert [r.url for r in out] == ["https://www.census.gov/news/", "https://a.com/x?p=1"]


def test_limiter_and_breaker_share_a_call(spark):
    events = spark.createDataFrame([("k", float(t), t, o) for t, o in enumerate(["error", "error", "ok", "ok", "ok"])], "key string, t double, event_id long, outcome string")
    got = {r.event_id: r.allowed for r in G.fold(events, G.guarded(3, 100.0, 2, 1.5), "allowed").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}
