"""The streaming guards decide as the batch ones do, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import guards as G
from quarrylight.streaming.guards import stream_fold


@pytest.mark.parametrize(("guard", "name"), [(G.limiter(3, 5.0), "admitted"), (G.breaker(2, 4.0), "allowed")])
def test_stream_equals_batch(spark, tmp_path, guard, name):
    events = spark.range(120).select((F.col("id") % 5).alias("key"), (F.col("id") / 4).cast("double").alias("t"), F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "error").when(F.col("id") % 7 == 0, "ok").otherwise("empty").alias("outcome"))
    for part in range(3):
        events.where(F.floor(F.col("event_id") / 40) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_fold(stream, guard, name).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.event_id: r[name] for r in spark.table(f"out_{name}").collect()}
    assert got == {r.event_id: r[name] for r in G.fold(events, guard, name).collect()} and len(got) == 120
