"""Tables between the stages of a long pipeline, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """Write df once and read it back: what follows plans over a table, and a lost executor costs nothing.

    The folder is that of spark.checkpoint.dir; only where it is unset (tests) a temporary one is set.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/quarrylight/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
