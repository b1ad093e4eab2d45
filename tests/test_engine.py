"""The engine's pipelines, model answers, sessions and sources on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.config import EngineConfig
from quarrylight.operators import engine as En
from quarrylight.operators import guards as G
from quarrylight.operators import models as M
from quarrylight.operators import sessions as Se
from quarrylight.operators import synthesis as Y
from quarrylight.sources import backends as B
from quarrylight.sources import cache as Ca
from quarrylight.streaming import windows as W

CFG = EngineConfig()
HIT = "query_id long, pos long, title string, url string, snippet string, date string, source string, relevance double, enriched_text string"


def hit(q, pos, url, snippet="a snippet of some words", source="site", relevance=0.5, text=None):
    return (q, pos, f"title {pos}", url, snippet, None, source, relevance, text)


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(1, "current interest rate of the fed"), (2, "thanks!")], "query_id long, message string")


@pytest.fixture(scope="module")
def backend(spark):
    """Three hits a query; follow-up agents find one more, the second search of a cross-check another."""

    def find(asked):
        n, none = F.col("pos"), F.lit(None).cast("string")
        first = asked.where("role not in ('gap_fill', 'cross_check')").select("query_id", "agent", "role", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("pos"))
        first = first.withColumns({"title": F.concat(F.lit("title "), n), "url": F.concat(F.lit("https://site"), n, F.lit(".org/rate")), "snippet": F.lit("a snippet of some words"), "date": none, "source": F.lit("site"), "relevance": F.lit(0.5), "enriched_text": none})
        more = asked.where("role in ('gap_fill', 'cross_check')").select("query_id", "agent", "role", F.lit(9).cast("long").alias("pos"), F.lit("more").alias("title"), F.concat(F.lit("https://"), F.replace("role", F.lit("_"), F.lit("-")), F.lit(".gov/x")).alias("url"), F.lit("the rate is 4.75% today").alias("snippet"), F.lit(None).cast("string").alias("date"), F.lit("gov").alias("source"), F.lit(0.4).alias("relevance"), F.lit(None).cast("string").alias("enriched_text"))
        return first.unionByName(more)

    return find


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(f"https://site{i}.org/rate", f"The interest rate of the fed is {4 + i / 100}% now. " * 20) for i in range(2)], "url string, text string")


def test_the_engine_searches_reads_and_writes_the_block(spark, messages, backend, texts):
    out = {r.query_id: r for r in En.answer(messages, backend, texts, CFG).collect()}
    assert set(out) == {1, 2} and not out[2].found and out[2].synthesized == "" and out[2].total == 0
    one = out[1]
    assert one.found and one.total >= 4
    assert "https://site0.org/rate" in one.citations and "gov/x" in one.citations
    for part in ("LIVE WEB DATA", Y.FIGURES_HEAD, "4.75%", "Sources: ", Y.RULES):
        assert part in one.synthesized


def test_after_the_fetch_budget_allowlist_and_strictness(spark, backend, texts):
    rows = spark.createDataFrame([hit(q, i, f"https://site{i}.org/rate") for q in (1, 2, 3) for i in range(3)], HIT)
    decisions = [(1, "current interest rate of the fed", "fed rate", "interest_rate", "deep", False, True), (2, "who is it", "who is it", "general", "fast", True, False), (3, "a question", "a question", "general", "deep", True, False)]
    decisions = spark.createDataFrame(decisions, "query_id long, message string, search_query string, category string, depth string, draft boolean, require_full boolean")
    allow = spark.createDataFrame([(3, "https://site1.org/rate", 0)], "query_id long, url string, ord long")
    got = En.after_fetch(rows, decisions, texts, CFG, backend, allow).collect()
    by = {q: [r for r in got if r.query_id == q] for q in (1, 2, 3)}
    assert by[1] and all(r.enriched_text for r in by[1])  # whole articles only
    assert len(by[2]) == 3 and not any(r.enriched_text for r in by[2])  # a draft reads nothing
    assert [r.url for r in by[3] if r.enriched_text] == ["https://site1.org/rate"]  # but what it is told to


def test_cross_check_and_follow_up_add_rows_once(spark, backend, texts):
    rows = spark.createDataFrame([hit(q, i, f"https://site{i}.org/rate") for q in (1, 2) for i in range(3)], HIT)
    decisions = spark.createDataFrame([(1, "fed rate", "fed rate", "interest_rate", "deep"), (2, "fed rate", "fed rate", "general", "deep")], "query_id long, message string, search_query string, category string, depth string")
    crossed = En.cross_checked(rows, decisions, backend).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in crossed} == {1: 4, 2: 3}
    followed = En.follow_up(rows, decisions, texts, backend, CFG).collect()
    assert {q: sum(r.query_id == q and "gap-fill" in r.url for r in followed) for q in (1, 2)} == {1: 1, 2: 1}
    assert {r.pos for r in followed if r.query_id == 1 and r.enriched_text} == {0, 1}


def test_plans_by_caller_model_and_rule(spark, backend):
    asked = spark.createDataFrame([(1, "fed rate", "fed rate", "deep", False), (2, "research the market of electric cars in Norway, based on fresh data, and give a forecast", "electric cars", "deep", False), (3, "x", "x", "deep", False)], "query_id long, message string, search_query string, depth string, verified boolean")
    explicit = spark.createDataFrame([(3, ["one way", "other way"])], "query_id long, subqueries array<string>")
    seen = []
    En.orchestrate(asked, lambda r: (seen.append(r.collect()), backend(r))[1], CFG, explicit).count()
    roles = {q: [x.role for x in seen[0] if x.query_id == q] for q in (1, 2, 3)}
    assert roles[1] == ["primary"] and len(roles[2]) == 5 and sorted(roles[3]) == ["sub1", "sub2", "sub3"]
    assert {x.most for x in seen[0] if x.query_id == 2} == {max(4, CFG.max_results // 5 + 3)}


def test_modes_of_the_classifier(spark):
    rows = spark.createDataFrame([(1, "thanks!", '{"search": true, "query": "q"}'), (2, "bitcoin price now", None), (3, "bitcoin price now", '{"search": false}')], "id long, message string, answer string")
    run = lambda **k: {r.id: (r.should_search, r.reason.split(":")[0]) for r in M.classify(rows, 2026, **k).collect()}
    assert run() == {1: (False, "trivial_skip_llm_primary"), 2: (True, "Tier 2"), 3: (False, "semantic_classifier")}
    assert run(mode="llm_only") == {1: (True, "semantic_classifier"), 2: (False, "semantic LLM"), 3: (False, "semantic_classifier")}
    assert run(mode="legacy")[3] == (True, "Tier 2") and run(has_model=False)[2] == (False, "llm_primary_requires_generate_fn")
    assert run(has_model=False, fallback=True)[2] == (True, "Tier 2")
    with pytest.raises(ValueError):
        M.classify(rows, 2026, mode="other")


def test_memory_ring_and_preview(spark):
    rows = [(1, t, p, f"https://a.org/{t}/{p}" if p != 1 else "http://plain.org", "s", f"excerpt {p} with forty characters and some more of them", None) for t in range(3) for p in range(4)]
    rows.append((1, 9, 0, "https://a.org/0/0", "s", "excerpt 0 with forty characters and some more of them", None))
    rows.append((2, 0, 0, "https://b.org", "s", "short", None))
    df = spark.createDataFrame(rows, "conversation long, turn long, pos long, url string, source string, snippet string, enriched_text string")
    got = [(r.conversation, r.line.split("\n  ")[1]) for r in Se.memory(df, 5).orderBy("conversation", "n").collect()]
    # the first line was pushed out, so it is taken again
    assert got == [(1, u) for u in ("https://a.org/1/3", "https://a.org/2/0", "https://a.org/2/2", "https://a.org/2/3", "https://a.org/0/0")]
    out = Se.with_preview(spark.createDataFrame([(1, "answer"), (1, " "), (3, "other")], "conversation long, text string"), Se.memory(df, 5), 2).collect()
    assert sorted(r.text.count("https://") for r in out) == [0, 0, 2] and any(r.text.endswith("answer") and "/2/3" in r.text for r in out)


def test_tool_json_is_whole_json(spark):
    rows = [(1, "q", True, False, ["https://a"], ["https://a", "https://b", "ftp://c"], None, "d", 3, "text", False)]
    df = spark.createDataFrame(rows, "query_id long, query_used string, useful boolean, verified boolean, citations array<string>, urls array<string>, category string, search_date string, total long, synthesized string, draft boolean")
    made = json.loads(Y.tool_json(df).first().json)
    assert made["candidate_urls"] == ["https://a", "https://b"] and made["category"] is None and made["error"] is None and made["ok"] and made["phase"] == "deep"
    many = [f"https://c{i}" for i in range(20)]
    got = df.select(Y.candidate_urls(F.array(*[F.lit(x) for x in many]), F.col("urls")).alias("u")).first().u
    assert got == [*many, "https://a"]


def test_ranks_equal_a_sort(spark):
    rows = [(g, float(v)) for g, n in ((1, 1), (2, 7), (3, 5000)) for v in ((i * 7919) % 1013 for i in range(n))] + [(4, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in G.percentile(df, "g", "v", q).collect()}
        for g in (1, 2, 3):
            own = sorted(v for k, v in rows if k == g)
            assert got[g] == own[round(q * (len(own) - 1))]
        assert got[4] is None


def test_workers_and_deadline(spark):
    rows = spark.createDataFrame([(1, p, t) for p, t in enumerate((10.0, 4.0, 4.0, 1.0))], "query_id long, pos long, latency double")
    got = {r.pos: (r.finished, r.kept) for r in G.worker_schedule(rows, 2, 9.0).collect()}
    assert got == {0: (10.0, False), 1: (4.0, True), 2: (8.0, True), 3: (9.0, True)}


def test_stored_hits_take_filters_and_a_limit(spark, tmp_path):
    rows = [(i % 3, i, "t", f"https://a.org/{i}", "s", "2024-01-01", "src", i / 10, "en" if i % 2 else None) for i in range(30)]
    spark.createDataFrame(rows, "query_id long, pos long, title string, url string, snippet string, date string, source string, relevance double, language string").coalesce(1).write.parquet(f"{tmp_path}/hits")
    spark.dataSource.register(B.StoredHits)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda **o: spark.read.format("stored_hits").options(path=f"{tmp_path}/hits", **o).load()
    assert read().count() == 30
    some = read().where("query_id = 1 and language = 'en' and relevance >= 0.5")
    assert {r.pos for r in some.collect()} == {i for i in range(30) if i % 3 == 1 and i % 2 and i >= 5}
    assert [r.pos for r in read(max_results=2).where("query_id = 2").collect()] == [2, 5]


def test_cache_table(spark, tmp_path):
    first = spark.createDataFrame([("k", 100.0, 50.0, "a"), ("k", 120.0, 10.0, "b")], "key string, t double, ttl_s double, body string")
    Ca.store(first, f"{tmp_path}/cache")
    Ca.store(first.where("body = 'a'").withColumn("key", F.lit("j")), f"{tmp_path}/cache")
    asked = spark.createDataFrame([(i, "k", t) for i, t in enumerate((99.0, 100.0, 119.0, 125.0, 131.0))] + [(9, "other", 1.0)], "id long, key string, t double")
    got = {r.id: r.body for r in Ca.lookup(Ca.load(spark, f"{tmp_path}/cache"), asked).collect()}
    assert got == {0: None, 1: "a", 2: "a", 3: "b", 4: None, 9: None}


def test_windows_on_a_stream_drop_late_events(spark, tmp_path):
    day = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    for k, rows in enumerate(([(day(1), "a"), (day(5), "a")], [(day(9), "a")], [(day(1, 30), "a"), (day(12), "b")], [(day(15), "b")])):
        spark.createDataFrame(rows, "t string, kind string").select(F.col("t").cast("timestamp").alias("t"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema("t timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = W.windowed_counts(stream, ["kind"], "1 hour").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start.hour, r.kind): r.n for r in spark.table("hours").collect()}
    assert got == {(1, "a"): 1, (5, "a"): 1, (9, "a"): 1, (12, "b"): 1}
