"""Mixing sources to target weights by entropy balancing.

Documents take rates between 0 and `cap` that stay as near to 1 as the token targets allow: least relative entropy
sum(r log r - r + 1) under sum(size * r) = target for each source. By duality r = min(cap, exp(lambda * size)) with one
multiplier a source, the root of the dual's gradient G(lambda) - target, where G = sum(size * min(cap, exp(lambda * size))).
Each Newton iteration is one distributed pass that sums G and the Hessian sum(size^2 * exp(lambda * size)) over the
documents by source, then a step for every source; steps that leave the bracket around the root halve it. It ends when
every source's tokens are within `tolerance` of its target.

Rates are rounded into whole copies by carrying the token error from document to document, largest first, in bounded
chunks of a source: a hot source is many chunks, and each chunk misses its share by about half a small document.
"""

from __future__ import annotations

from math import floor, log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_partitions, written

#: Every so many steps the bracket is halved whatever Newton's step is, so that the iterations end.
_HALVING = 16


def ranked(df: DataFrame, col: str) -> DataFrame:
    """df plus rank (0-based) by col, nulls last, sorted in ranges: no task sees all rows."""
    order = F.col(col).asc_nulls_last()
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    sizes, before, total = dict(dealt.groupBy("part").count().collect()), {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return dealt.drop("part").withColumn("rank", F.lit(0))
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("rank", within + start[F.col("part")]).drop("part")


def token_targets(totals: DataFrame, weight, cap: float = 3.0) -> DataFrame:
    """totals (source, source_size) plus target: shares of all tokens by weight(rank of the source), at most cap times
    the source's size; what is cut goes to the others by weight until none is above."""
    state = written(ranked(totals, "source").withColumn("weight", weight(F.col("rank")).cast("double")), "weights")
    ceiling = F.col("source_size") * cap
    total = float(state.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= ceiling if capped >= 0 else F.lit(False)
        row = state.agg(F.count_if(full), F.sum(F.when(full, ceiling)), F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - float(row[1] or 0)) / float(row[2])
    return state.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), ceiling).alias("target"))


def rate(lam, size, cap: float):
    """The tilted rate of a document: exp(lambda * size), at most cap."""
    return F.least(F.exp(lam * size), F.lit(float(cap)))


def balance(sizes: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-6, max_steps: int = 200) -> DataFrame:
    """sizes (source, size, n: documents of that size), targets (source, source_size, target) -> targets plus lam.

    Sources without words get lam 0; a source whose target is cap times its size gets the multiplier at which all its
    documents are at the cap. Raises if some source is further than `tolerance` of its target off after max_steps, which
    the halving of brackets rules out for sizes below 2**50.
    """
    hist = sizes.where("size > 0")
    least = hist.groupBy("source").agg(F.min("size").alias("least"))
    start = targets.alias("t").join(least.alias("l"), F.expr("t.source <=> l.source"), "left").select("t.*", "l.least")
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    # every document of the source is at the cap above the one end, and at or below the target's share at the other
    top, low = F.lit(log(cap)) / F.col("least"), F.log(F.col("target") / F.col("source_size")) / F.col("least")
    start = start.withColumn("open", F.col("least").isNotNull() & (F.col("target") > 0) & ~full)
    start = start.withColumn("lo", F.when(F.col("target") < F.col("source_size"), low).otherwise(F.lit(0.0))).withColumn("hi", F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(top))
    start = start.withColumn("lam", F.when(full & F.col("least").isNotNull(), top).otherwise(F.lit(0.0)))
    state = written(start.select("source", "source_size", "target", "open", "lo", "hi", "lam"), "balance")
    for k in range(max_steps):
        met = hist.alias("d").join(state.where("open").alias("s"), F.expr("d.source <=> s.source")).select("s.source", "s.lam", "d.size", "d.n")
        tilted = F.exp(F.col("lam") * F.col("size"))
        gradient = F.sum(F.col("n") * F.col("size") * rate(F.col("lam"), F.col("size"), cap)).alias("tokens")
        hessian = F.sum(F.when(tilted < cap, F.col("n") * F.col("size") * F.col("size") * tilted)).alias("curve")
        sums = met.groupBy("source").agg(gradient, hessian)
        now = state.alias("s").join(sums.alias("g"), F.expr("s.source <=> g.source"), "left").select("s.*", "g.tokens", "g.curve")
        near = F.abs(F.col("tokens") - F.col("target")) <= F.col("target") * tolerance
        over = F.col("tokens") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("tokens") - F.col("target")) / F.col("curve")
        inside = F.coalesce((step > lo) & (step < hi), F.lit(False)) & F.lit(k % _HALVING != _HALVING - 1)
        moved = F.when(inside, step).otherwise((lo + hi) / 2)
        still = F.col("open") & ~near
        cols = [F.when(still, new).otherwise(F.col(name)).alias(name) for name, new in (("lo", lo), ("hi", hi), ("lam", moved))]
        state = written(now.select("source", "source_size", "target", still.alias("open"), *cols), "balance")
        if state.where("open").isEmpty():
            return state.select("source", "source_size", "target", "lam")
    raise ValueError(f"a source is off its target after {max_steps} Newton steps")


def copies(rows: list[tuple[int, float, int]], cap: int) -> list[int]:
    """Whole copies for (size, rate, m equal documents) ordered by size, largest first, whose tokens follow the rates' step by step.

    What one document's rounding takes too much or too little, the next ones, which are smaller, give back.
    """
    out, due = [], 0.0
    for size, share, m in rows:
        due += share * size * m
        taken = min(cap * m, max(0, floor(due / size + 0.5))) if size > 0 else 0
        due -= taken * size
        out.append(taken)
    return out


def mix(docs: DataFrame, weight=None, cap: int = 3, chunk_rows: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, text, source) -> a row per row: id_col, source, size, source_size, target, rate, copies, taken.

    Size: words of the whole text, 0 for null. Null sources are one source, ranked last. Documents without words are
    taken zero words; a source without any has target 0. Rows of equal id, source and size are rounded together and share
    their copies out, at most one apart, so neither a null id nor a repeated one gathers in one task. Ties in size go by
    id, so reruns agree. An empty table gives an empty result; other columns are ignored.
    """
    weight = weight or (lambda rank: rank % 3 + 1)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    each = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    each = written(each.groupBy("source", "id", "size").agg(F.count("*").alias("m")), "sizes")
    hist = written(each.groupBy("source", "size").agg(F.sum("m").alias("n"), F.count("*").alias("rows")), "size_counts")
    counted = written(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("rows").alias("rows")), "totals")
    aims = balance(hist.select("source", "size", "n"), token_targets(counted.select("source", "source_size"), weight, cap), cap)
    aims = aims.alias("a").join(counted.alias("c"), F.expr("a.source <=> c.source")).select("a.*", F.ceil(F.col("c.rows") / chunk_rows).alias("chunks"))
    aims = written(aims, "rates")
    own = F.when(F.col("size") > 0, rate(F.col("lam"), F.col("size"), cap)).otherwise(F.lit(0.0))
    rated = each.alias("d").join(aims.alias("a"), F.expr("d.source <=> a.source")).select("d.*", "a.source_size", "a.target", "a.lam", "a.chunks")
    chunked = rated.withColumn("rate", own).withColumn("chunk", F.pmod(F.xxhash64("id", "size"), F.col("chunks"))).drop("chunks", "lam")

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id"], ascending=[False, True])
        group["all_copies"] = copies(list(zip(group["size"].tolist(), group["rate"].tolist(), group["m"].tolist(), strict=True)), cap)
        return group.drop(columns="chunk")

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = chunked.groupBy("source", "chunk").applyInPandas(
        deal, f"source string, id {kind}, size long, m long, source_size long, target double, rate double, all_copies long"
    )
    i, m, total = F.col("i"), F.col("m"), F.col("all_copies")
    spread = dealt.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), m))).withColumn("copies", F.floor(total / m) + (i <= total % m).cast("long"))
    return spread.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated_to_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with copy (1, 2, ...); those taken zero times are left out.

    Rows are told apart by a number written with them, so repeated and null ids are rows of their own. A column copy of
    docs is replaced; an empty table gives an empty result.
    """
    rows = written(docs.drop("copy").withColumn("__rid", F.monotonically_increasing_id()), "numbered", compression="zstd")
    plan = mix(rows.select("__rid", "text", "source"), id_col="__rid").where("copies > 0").select("__rid", F.col("copies").alias("__copies"))
    out = rows.join(plan, "__rid").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.drop("__copies", "__rid")


def op6_source_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row of docs (doc_id, text, source).

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns: as `mix` says.
    """
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
