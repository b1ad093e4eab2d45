"""Stateful guards over events: rate limiter, circuit breaker, budget, cooldown, TTL cache, and provider chains.

A step function takes a key's state and its next event, and gives the new state and the decision. The batch operators
fold it over each key's events in event-time order; the streaming ones (`streaming.guards`) keep the state between
micro-batches. Decisions depend on earlier decisions, so no window frame expresses them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[tuple, float, str], tuple[tuple, bool]]


def limiter(max_calls: int, window_s: float) -> tuple[tuple, Step]:
    """Admit while fewer than max_calls admitted calls lie in the closed window that ends now."""

    def step(hits: tuple, t: float, _: str) -> tuple[tuple, bool]:
        hits = tuple(h for h in hits if h >= t - window_s)
        return ((*hits, t), True) if len(hits) < max(1, max_calls) else (hits, False)

    return (), step


def breaker(threshold: int, recovery_s: float) -> tuple[tuple, Step]:
    """Open for recovery_s after `threshold` failures without a success between; empty outcomes count as neither."""

    def step(state: tuple, t: float, outcome: str) -> tuple[tuple, bool]:
        failures, open_until = state
        if t < open_until:
            return state, False
        if outcome == "ok":
            failures = 0
        elif outcome == "error":
            failures += 1
            if failures >= max(1, threshold):
                failures, open_until = 0, t + recovery_s
        return (failures, open_until), True

    return (0, float("-inf")), step


def guarded(max_calls: int, window_s: float, threshold: int, recovery_s: float) -> tuple[tuple, Step]:
    """Limiter, then breaker; a call that the breaker refuses has used up quota."""
    (hits0, limit), (state0, trip) = limiter(max_calls, window_s), breaker(threshold, recovery_s)

    def step(state: tuple, t: float, outcome: str) -> tuple[tuple, bool]:
        hits, ok = limit(state[0], t, outcome)
        rest, allowed = trip(state[1], t, outcome) if ok else (state[1], False)
        return (hits, rest), allowed

    return (hits0, state0), step


def ttl_cache(ttl_s: dict[str, float], base_s: float) -> tuple[tuple, Step]:
    """True for a hit: an entry stored less than its kind's lifetime ago. A miss stores; a hit doesn't extend."""

    def step(state: tuple, t: float, kind: str) -> tuple[tuple, bool]:
        return (state, True) if t < state[0] else ((t + min(base_s, ttl_s.get(kind, base_s)),), False)

    return (float("-inf"),), step


def cooldown(turns: int) -> tuple[tuple, Step]:
    """True if the query equals the last remembered one fewer than `turns` turns ago; else it is remembered."""

    def step(state: tuple, turn: float, query: str) -> tuple[tuple, bool]:
        query = query.lower().strip()[:240]
        if query and query == state[0] and turn - state[1] < turns:
            return state, True
        return ((query, turn) if query else state), False

    return ("", -1e9), step


def fold(events: DataFrame, guard: tuple[tuple, Step], name: str) -> DataFrame:
    """events (key, t double, event_id, outcome) -> (key, event_id, name): the guard over each key's events in order.

    A key's events stream through its task in order, batch by batch, with only the guard's state carried along, so a
    key's history is never held in memory.
    """
    start, step = guard

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), start
        for batch in batches:
            out = []
            for key, t, outcome in zip(batch["key"], batch["t"], batch["outcome"], strict=True):
                if key != current and not (pd.isna(key) and current is None):
                    current, state = (None if pd.isna(key) else key), start
                state, decision = step(state, t, outcome)
                out.append(decision)
            yield pd.DataFrame({"key": batch["key"], "event_id": batch["event_id"], name: out})

    kind = events.schema["key"].dataType.simpleString()
    ordered = events.select("key", "t", "event_id", "outcome").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return ordered.mapInPandas(run, f"key {kind}, event_id long, {name} boolean")


def within_budget(events: DataFrame, cap: int) -> DataFrame:
    """Searches of each key are admitted until `cap` useful ones have been; cap 0 or less is no limit."""
    before = F.sum(F.col("useful").cast("int")).over(Window.partitionBy("key").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    admitted = F.coalesce(before, F.lit(0)) < cap if cap > 0 else F.lit(True)
    return events.select("key", "event_id", admitted.alias("admitted"))


def serial_chain(calls: DataFrame) -> DataFrame:
    """calls (query_id, priority, latency, ok) -> winner and time of asking one provider after the other."""
    first = F.min(F.when(F.col("ok"), F.col("priority"))).over(Window.partitionBy("query_id"))
    asked = calls.withColumn("winner", first).where(F.col("winner").isNull() | (F.col("priority") <= F.col("winner")))
    return asked.groupBy("query_id").agg(F.max("winner").alias("winner"), F.round(F.sum("latency"), 6).alias("wall"))


def hedged_chain(calls: DataFrame, hedge: float) -> DataFrame:
    """Winner and time when the backups start together once the preferred provider fails or `hedge` has passed.

    A preferred provider that answers wins however late; else the best of those done when the first of them and the
    preferred one are.
    """
    done = F.least(F.col("l0"), F.lit(hedge)) + F.col("latency")
    by = Window.partitionBy("query_id")
    rows = calls.withColumn("l0", F.max(F.when(F.col("priority") == 0, F.col("latency"))).over(by)).withColumn("ok0", F.max(F.when(F.col("priority") == 0, F.col("ok").cast("int"))).over(by))
    rows = rows.withColumn("done", F.when(F.col("priority") > 0, done))
    first = F.coalesce(F.min(F.when(F.col("ok"), F.col("done"))).over(by), F.max("done").over(by))
    rows = rows.withColumn("wall", F.when(F.col("ok0") == 1, F.col("l0")).otherwise(F.greatest("l0", first)))
    winner = F.when(F.col("ok0") == 1, F.lit(0)).otherwise(F.when(F.col("ok") & (F.col("done") <= F.col("wall")), F.col("priority")))
    return rows.withColumn("w", winner).groupBy("query_id").agg(F.min("w").cast("long").alias("winner"), F.round(F.max("wall"), 6).alias("wall"))


def value_at_rank(values: DataFrame, group: str, value: str, rank: Callable[[Column], Column], cuts: int = 64) -> DataFrame:
    """(group, n, p): the value at the 0-based place rank(n) among a group's n values in order, nulls left out.

    Quantile sketches cut each group's values; exact counts below the cuts then tell between which two the place lies, and
    only the distinct values between those are put in order, with how often they occur.
    """
    known = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")).groupBy("g", "v").agg(F.count("*").alias("times"))
    marks = F.percentile_approx("v", [i / cuts for i in range(cuts + 1)], 10_000)
    edges = known.groupBy("g").agg(marks.alias("edges"), F.sum("times").alias("n"))
    # a value's cell is the number of edges below it; cells are few, and counted exactly
    celled = known.join(edges, "g").withColumn("cell", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    cells = celled.groupBy("g", "n", "cell").agg(F.sum("times").alias("held"))
    before = F.sum("held").over(Window.partitionBy("g").orderBy("cell")) - F.col("held")
    place = cells.withColumn("before", before).withColumn("at", rank(F.col("n")))
    home = place.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("held"))).select("g", "cell", "before", "at")
    inside = celled.join(home, ["g", "cell"])
    upto = F.sum("times").over(Window.partitionBy("g").orderBy("v")) + F.col("before")
    found = inside.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("times") <= F.col("at")))
    return found.select(F.col("g").alias(group), "n", F.col("v").alias("p"))


def worker_schedule(pages: DataFrame, workers: int, deadline: float) -> DataFrame:
    """pages (query_id, pos, latency) -> also finished and kept: pages start in order as one of `workers` gets free, and those
    done by the deadline are kept; later ones are abandoned.

    A query's pages are few (the engine reads 18 at most), so its schedule is folded within one row.
    """
    each = pages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "latency"))).alias("p"))
    free = F.array_repeat(F.lit(0.0), max(1, workers))
    done = F.array().cast("array<struct<pos:bigint,finished:double>>")

    def add(s, x):
        # the free times are kept in order, so the first is the next worker's
        end = F.get(s["free"], F.lit(0)) + x["latency"]
        left = F.array_sort(F.array_append(F.slice(s["free"], 2, max(1, workers)), end))
        return F.struct(left.alias("free"), F.array_append(s["done"], F.struct(x["pos"].cast("long").alias("pos"), end.alias("finished"))).alias("done"))

    folded = each.select("query_id", F.explode(F.aggregate("p", F.struct(free.alias("free"), done.alias("done")), add, lambda s: s["done"])).alias("d"))
    return folded.select("query_id", "d.pos", F.round("d.finished", 6).alias("finished"), (F.col("d.finished") <= deadline).alias("kept"))


def percentile(values: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Nearest-rank percentile: the value at q * (n - 1), rounded half to even; null where a group has no value."""
    at = value_at_rank(values, group, value, lambda n: F.bround(F.lit(q) * (n - 1)).cast("long")).select(F.col(group).alias("g"), "p")
    groups = values.select(F.col(group).alias("g")).distinct()
    return groups.alias("a").join(at.alias("b"), F.expr("a.g <=> b.g"), "left").select(F.col("a.g").alias(group), "b.p")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6
