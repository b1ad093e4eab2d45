"""A cache as a table: entries are appended, and a lookup finds the last one of its key that is still alive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def store(entries: DataFrame, path: str) -> None:
    """Append entries (key, t, ttl_s, body) to the cache table, a folder a day of storing."""
    entries.withColumn("day", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, key, t) plus stored and body of the key's last entry stored at t or before, null where it has expired.

    Entries and lookups are put in one order by key and time, so nothing is paired; of entries of one time the one with the
    greatest body counts, and an entry is there for a lookup of its own time.
    """
    none = lambda kind: F.lit(None).cast(kind)
    a = entries.select("key", F.col("t").cast("double").alias("t"), F.lit(0).alias("side"), none("long").alias("id"), F.struct(F.col("t").cast("double").alias("stored"), F.col("ttl_s").cast("double").alias("ttl_s"), F.col("body").cast("string").alias("body")).alias("e"))
    b = asked.select("key", F.col("t").cast("double").alias("t"), F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), none("struct<stored:double,ttl_s:double,body:string>").alias("e"))
    order = Window.partitionBy("key").orderBy("t", "side", F.col("e.body")).rowsBetween(Window.unboundedPreceding, 0)
    met = a.union(b).withColumn("e", F.last("e", ignorenulls=True).over(order)).where("side = 1")
    alive = F.col("t") < F.col("e.stored") + F.col("e.ttl_s")
    return met.select("id", "key", "t", F.when(alive, F.col("e.stored")).alias("stored"), F.when(alive, F.col("e.body")).alias("body"))
