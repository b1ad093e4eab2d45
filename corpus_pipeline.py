"""Five training-data operators over the documents, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows are documents whatever their ids: repeated and null
ids are told apart where a stage compares documents. Other columns of docs, whatever their names, come through unchanged.
An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import decontaminate_bm25, language_zstd, line_winnowing, mixing_entropy, simhash_bitsliced
from quarrylight.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; undetermined ones and narrow margins go, and so do null and empty texts and ties.

    Of labelled rows those with a null lang or text teach nothing; without any labelled row all documents are undetermined.
    """
    return language_zstd.keep_identified(docs, language_zstd.fit_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated runs of lines; documents that were all repetition go.

    The first place in order of doc_id (null first), row and line stays; a repeated row loses its lines like any other.
    """
    return line_winnowing.keep_deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id, null last; equal rows are copies of one."""
    return simhash_bitsliced.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked; null and empty texts stay, null and empty items leak nowhere."""
    return decontaminate_bm25.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document; a null source is one source."""
    return mixing_entropy.op6_source_mixing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Compression, SimHash and BM25 retrieval aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
