"""Quality rules with cross-document line frequency.

One pass over the texts gives the base counts and, for each document, the hashes of its normalised lines (lower-cased,
digits to 0, white space collapsed) with their words. Lines are then counted per host in distinct documents, exact
copies of a text counting once, so that a text with many copies is not taken for boilerplate. A line found in more
documents of its host than max(`min_docs`, `max_share` of the host's documents) is removed, and a document is rejected
if removal leaves under `min_words` words or takes more than `max_removed` of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"
_ZERO_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_WINDOW = 8
_FACTORS = np.random.default_rng(8).integers(1 << 62, size=_WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>"


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each word number."""
    x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that lie in a window of that many words found twice or more in the text, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = _mixed(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += ids[k : k + n] * _FACTORS[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple:
    """The base counts of a whole text, and its distinct normalised lines with their words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, _SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_line: Counter[int] = Counter()
    for line in lines:
        parts = line.lower().translate(_ZERO_DIGITS).split()
        per_line[xxhash.xxh64_intdigest(b" ".join(parts))] += len(parts)
    hashes = np.fromiter(per_line, np.uint64, len(per_line)).view(np.int64)
    dup = len(lines) - len(set(lines))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), hashes, list(per_line.values())


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus the columns of `measure`; null text counts as empty."""

    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=names)

    return docs.withColumn("m", run.asNondeterministic()(F.col(text_col).cast("string")))


def quality(
    docs: DataFrame, min_docs: int = 25, max_share: float = 0.01, min_words: int = 20, max_repeat_percent: int = 30, max_removed: float = 0.7
) -> DataFrame:
    """docs (doc_id, text, source) -> one row a row of docs with base counts, removed_words, base_failed and kept.

    A line's documents are the distinct doc_ids of the host that hold it, exact copies of a text included; a row without
    doc_id is a document of its own. A line goes when it is in more than min_docs of them and in more than max_share of
    the host's. Null sources are one host. Null and empty texts have no words and fail the base rules. Repeated rows are
    judged each, and count once for a line. Other columns are ignored; an empty table gives an empty result.
    """
    picked = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("host"), F.col("text"))
    each = written(base_counts(picked).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "host", "m.*"), "line_counts")
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("rid")).alias("row")).alias("document")
    # distinct first, partly within each task, then counted: a line of a third of all rows is many small groups
    sizes = each.select("host", document).distinct().groupBy("host").count()
    limit = sizes.select("host", F.greatest(F.lit(min_docs), F.col("count") * max_share).alias("limit"))
    found = each.select("host", F.explode("line_hash").alias("h"), document).distinct().groupBy("host", "h").count().where(F.col("count") > min_docs)
    common = found.alias("f").join(limit.alias("l"), F.expr("f.host <=> l.host")).where("f.count > l.limit").select("f.host", "f.h")
    lines = each.select("rid", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("x")).select("rid", "host", "x.line_hash", "x.line_words")
    hit = lines.alias("a").join(common.alias("c"), F.expr("a.line_hash = c.h and a.host <=> c.host"))
    removed = hit.groupBy("rid").agg(F.sum("line_words").alias("removed_words"))
    out = each.drop("line_hash", "line_words").join(removed, "rid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < min_words) | (F.col("removed_words") > max_removed * F.col("n_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("rid", "host")


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    """A row per row of docs with the counts, base_failed and kept; nulls, ties, empty tables and the like as `quality` says."""
    return quality(docs)
