"""Shared plumbing: the cluster's shared scratch folder, written tables, and table loading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The word of every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only where that is unset (tests) a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/quarrylight/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it by PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sent = {Path(p).name for p in spark.sparkContext.listFiles}
    if root not in known and "quarrylight.zip" not in sent:
        packed = shutil.make_archive(f"{tempfile.mkdtemp()}/quarrylight", "zip", root, "quarrylight")
        spark.sparkContext.addPyFile(packed)  # the driver serves it to the workers from there


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
