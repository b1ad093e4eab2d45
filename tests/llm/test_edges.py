"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import (
    arc_to_warc,
    decontaminate_bm25,
    html_mincut,
    language_zstd,
    line_quality,
    line_winnowing,
    mixing_entropy,
    pii_surrogates,
    registry,
    simhash_bitsliced,
    url_boosting,
)

OVER_DOCS = {
    "op2": language_zstd.op2_language_id,
    "op3": pii_surrogates.op3_pii_surrogates,
    "op4": line_winnowing.op4_line_dedup,
    "op5": line_quality.op5_quality_rules,
    "op6": mixing_entropy.op6_source_mixing,
    "op8": simhash_bitsliced.op8_simhash_near_dedup,
}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x y z"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.example.com/en/1", "<article><p>One.</p></article>"), (1, "http://a.example.com/en/1", "<article><p>One.</p></article>"), (2, None, None), (None, "no scheme", ""), (3, "https://x.net/es/", "<p>" + "long text, all of it. " * 20000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("name", OVER_DOCS)
def test_every_row_has_one_result(name, docs, clashing, nothing):
    run = OVER_DOCS[name]
    first = run(docs)
    assert first.count() == docs.count()
    assert run(clashing).count() == docs.count()
    empty = run(nothing)
    assert empty.count() == 0 and empty.columns == first.columns


@pytest.mark.parametrize("run", [arc_to_warc.op1_arc_to_warc, url_boosting.op7_url_filter, html_mincut.op10_html_extraction])
def test_every_page_has_one_result(run, pages):
    more = pages.withColumns({n: F.lit(1) for n in ("host", "digest", "keep_id", "rule", "main_text", "archive", "bucket")})
    assert run(pages).count() == run(more).count() == pages.count()
    assert run(pages.limit(0)).count() == 0


def test_decontamination_edges(docs, clashing, nothing, items):
    found = decontaminate_bm25.find_leaks(clashing, items)
    assert found.count() == docs.count() and found.where(F.size("leaks") > 0).count() == 0
    assert decontaminate_bm25.op9_decontamination(nothing, items).count() == 0
    assert decontaminate_bm25.find_leaks(docs, items.limit(0)).where(F.size("leaks") == 0).count() == docs.count()


def test_stages_keep_columns_and_survive_empty_tables(spark, docs, nothing, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= docs.count(), name
        if name != "source_mixing":
            assert out.columns == docs.columns
        assert stage(spark, nothing, sf).count() == 0


def test_every_operator_is_registered_once():
    numbers = sorted(int(q[2:].split("_")[0]) for q in registry.queries())
    assert numbers == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
