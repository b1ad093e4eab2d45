"""Search backends: a chain of configured providers, and stored hits as a data source that takes filters and a limit."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow.dataset as arrow
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual

#: The providers in the order in which they are asked.
PRIORITY = ("serper", "brave", "bing", "tavily")


def configured(key: Column) -> Column:
    """A provider is configured if its key isn't blank."""
    return F.trim(F.coalesce(key, F.lit(""))) != ""


def chain(backends: DataFrame) -> DataFrame:
    """backends (tenant, name, key) -> (tenant, place, name): each tenant's configured providers in the order of PRIORITY."""
    place = F.array_position(F.array(*[F.lit(n) for n in PRIORITY]), F.col("name"))
    known = backends.where(configured(F.col("key"))).withColumn("p", place).where("p > 0").groupBy("tenant").agg(F.array_sort(F.collect_set(F.struct("p", "name"))).alias("c"))
    return known.select("tenant", F.posexplode("c").alias("place", "x")).select("tenant", F.col("place").cast("long").alias("place"), "x.name")


def split_keys(raw: Column) -> Column:
    """Keys parted by white space, commas or semicolons, without quotes, each once."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[\s,;]+"), lambda k: F.regexp_replace(F.regexp_replace(F.trim(k), '^"+|"+$', ""), "^'+|'+$", ""))
    return F.array_distinct(F.filter(parts, lambda k: k != ""))


def switched_on(value: Column, default: bool = True) -> Column:
    """A feature switch: on unless it says 0, false, no or off; blank is the default."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v == "", F.lit(default)).otherwise(~v.isin("0", "false", "no", "off"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """Reads one file a task; filters on plain columns are applied while reading, others are left to Spark."""

    TAKEN = {EqualTo: "__eq__", GreaterThanOrEqual: "__ge__", LessThanOrEqual: "__le__"}

    def __init__(self, schema, options: dict):
        self.schema, self.path, self.most = schema, options["path"], int(options.get("max_results", 0))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (the name is Spark's)
        for f in filters:
            if type(f) in self.TAKEN and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], self.TAKEN[type(f)], f.value))
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], "isin", list(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], "is_valid", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(f"{root}/{n}") for root, _, names in sorted(os.walk(self.path)) for n in sorted(names) if n.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator:
        wanted = None
        for column, way, value in self.filters:
            field = arrow.field(column)
            one = field.is_valid() if way == "is_valid" else field.isin(value) if way == "isin" else getattr(field, way)(value)
            wanted = one if wanted is None else wanted & one
        scan = arrow.dataset(partition.path, format="parquet").scanner(columns=[f.name for f in self.schema.fields], filter=wanted)
        left = self.most or None
        for batch in scan.to_batches():
            if left is not None:
                batch = batch.slice(0, left)
                left -= batch.num_rows
            if batch.num_rows:
                yield batch
            if left == 0:
                return


class StoredHits(DataSource):
    """Stored provider answers as a source: .format("stored_hits").option("path", ..).option("max_results", n).

    path is a Parquet file or folder that drivers and workers both see. max_results bounds each file's hits after the
    filters, as a provider's limit does.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_hits"

    def schema(self) -> str:
        return "query_id long, pos long, title string, url string, snippet string, date string, source string, relevance double, language string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, dict(self.options))
