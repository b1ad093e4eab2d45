"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every document.

Passages are word windows twice as long as the longest item, each half over the last, so every stretch of an item's
length lies in one. A passage's distinct words are the query. Scores are BM25 over the items, divided by the score an
item gives its own words, and every item at `threshold` or more is retrieved. Most passages are ruled out first by the
bound that WAND rests on: an item's common words together score under the threshold, so a passage must hold enough of
its other words. What is left goes through block-max WAND: cursors over the postings, a pivot from term maxima, and
blocks skipped by their own maxima. A retrieved item counts as leaked if the passage holds at least `overlap` of its
five-word shingles, and, where items have an answer of their own, of the words of its question and of its answer each.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K1, B = 1.2, 0.75
#: Bytes that part words: ASCII other than letters, digits and the underscore.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: Other characters that do: Latin-1 signs, general and ideographic punctuation.
_WIDE = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]+")
_LEAK = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
_LEAKS = "array<struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text, in UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = _WIDE.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_PARTS).split()


def shingles(tokens: list[bytes], size: int = 5) -> set[tuple[bytes, ...]]:
    """Runs of `size` words; a shorter text is one shingle."""
    if not tokens:
        return set()
    return set(zip(*(tokens[i:] for i in range(size)), strict=False)) if len(tokens) >= size else {tuple(tokens)}


@dataclass(frozen=True)
class Item:
    item_id: int
    tokens: list[bytes]
    shingles: set[tuple[bytes, ...]]
    question: set[bytes]
    answer: set[bytes]
    own_answer: bool


def item_of(item_id: int, text: str | None, answer: str | None = None) -> Item | None:
    """An item; without an answer of its own, the last quarter of its text (a word at least) is shown as it, but decides nothing."""
    tokens = words(text)
    if answer is None:
        cut = len(tokens) - max(1, len(tokens) // 4)
        question, final = tokens[:cut], tokens[cut:]
    else:
        question, final = tokens, words(answer)
        tokens = question + final
    return Item(item_id, tokens, shingles(tokens), set(question), set(final), answer is not None) if tokens else None


@dataclass
class Posting:
    """Item numbers in order, their weights, and the last item and the greatest weight of each block."""

    items: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    peak: list[float] = field(default_factory=list)
    top: float = 0.0

    def close(self, block: int) -> None:
        for k in range(0, len(self.items), block):
            self.last.append(self.items[min(k + block, len(self.items)) - 1])
            self.peak.append(max(self.weights[k : k + block]))
        self.top = max(self.peak)


class Index:
    """BM25 postings of the items, weights divided by each item's score for itself."""

    def __init__(self, items: list[Item], frequency: dict[bytes, int], n_items: int, mean_length: float, threshold: float = 0.6, slack: float = 0.45, block: int = 64):
        self.items, self.threshold, self.need = items, threshold, threshold - slack
        self.stride = max((len(x.tokens) for x in items), default=1)
        self.postings: dict[bytes, Posting] = {}
        #: word -> (item number, weight) where the word is not among the item's common ones
        self.telling: dict[bytes, list[tuple[int, float]]] = {}
        for n, item in enumerate(items):
            norm = K1 * (1 - B + B * len(item.tokens) / mean_length)
            raw = {t: math.log1p((n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(item.tokens).items()}
            own = sum(raw.values())
            common = 0.0
            for t in sorted(raw, key=lambda t: (-frequency[t], len(t), t)):
                w = raw[t] / own
                p = self.postings.setdefault(t, Posting())
                p.items.append(n)
                p.weights.append(w)
                common += w
                if common > slack:
                    self.telling.setdefault(t, []).append((n, w))
        for p in self.postings.values():
            p.close(block)
        self.telling_words = frozenset(self.telling)

    def passages(self, tokens: list[bytes]) -> list[int]:
        """Numbers of the passages that the bound leaves."""
        if self.telling_words.isdisjoint(tokens):
            return []
        score: dict[tuple[int, int], float] = {}
        seen = set()
        for at, t in ((i, t) for i, t in enumerate(tokens) if t in self.telling_words):
            home = at // self.stride
            for k in (home - 1, home) if home else (0,):
                if (k, t) not in seen:
                    seen.add((k, t))
                    for n, w in self.telling[t]:
                        score[k, n] = score.get((k, n), 0.0) + w
        return sorted({k for (k, _), s in score.items() if s >= self.need - 1e-9})

    def search(self, query: set[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: (item number, score) of every item at the threshold or above."""
        least = self.threshold - 1e-9
        cursors = [[p.items[0], 0, p] for p in (self.postings[t] for t in sorted(query) if t in self.postings)]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].top
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            ends, bound = [], 0.0
            for c in cursors[: pivot + 1]:
                b = bisect_left(c[2].last, doc)
                if b < len(c[2].last):
                    bound += c[2].peak[b]
                    ends.append(c[2].last[b])
            if bound < least:  # no item up to the nearest block end, nor before the next list, can reach it
                nxt = min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]])
                cursors = self._advance(cursors, pivot, max(nxt, doc + 1))
            elif cursors[0][0] == doc:
                s = sum(c[2].weights[c[1]] for c in cursors[: pivot + 1])
                if s >= least:
                    found.append((doc, s))
                cursors = self._advance(cursors, pivot, doc + 1)
            else:
                cursors = self._advance(cursors, pivot, doc)
        return found

    @staticmethod
    def _advance(cursors: list, pivot: int, to: int) -> list:
        for c in cursors[: pivot + 1]:
            if c[0] < to:
                c[1] = bisect_left(c[2].items, to, c[1])
                c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else -1
        return [c for c in cursors if c[0] >= 0]

    def leaks(self, text: str | None, overlap: float = 0.8) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, shares of shingles, question words and answer words) of each item leaked into the text."""
        tokens = words(text)
        best: dict[int, tuple] = {}
        for k in self.passages(tokens):
            part = tokens[k * self.stride : (k + 2) * self.stride]
            have = set(part)
            own = None
            for n, score in self.search(have):
                own = own or shingles(part)
                item = self.items[n]
                whole = len(item.shingles & own) / len(item.shingles) if len(item.tokens) >= 5 else float(_holds(part, item.tokens))
                q, a = (len(x & have) / len(x) if x else 1.0 for x in (item.question, item.answer))
                if (min(whole, q, a) if item.own_answer else whole) >= overlap - 1e-9 and (item.item_id not in best or best[item.item_id][1:3] < (score, whole)):
                    best[item.item_id] = (item.item_id, score, whole, q, a)
        return [best[i] for i in sorted(best)]


def _holds(tokens: list[bytes], run: list[bytes]) -> bool:
    return any(tokens[i : i + len(run)] == run for i in range(len(tokens) - len(run) + 1))


@dataclass(frozen=True)
class Benchmark:
    """The test items in the shared folder, dealt to shards by hash, with the statistics of all of them."""

    items: DataFrame  # shard, item_id, text, answer
    terms: DataFrame  # shard, term, frequency over all items
    n_items: int
    mean_length: float
    n_shards: int

    def shard(self, k: int) -> tuple[list[Item], dict[bytes, int], int, float]:
        """What an index of one shard takes: at most about shard_items items, the frequencies of their words, and the counts of all."""
        rows = self.items.where(F.col("shard") == k).select("item_id", "text", "answer").collect()
        found = sorted((item_of(*r) for r in rows), key=lambda x: (x.item_id, x.tokens))
        frequency = {bytes(r["term"]): r["frequency"] for r in self.terms.where(F.col("shard") == k).select("term", "frequency").collect()}
        return found, frequency, self.n_items, self.mean_length


def benchmark_of(items: DataFrame, shard_items: int = 10_000, shard_bytes: int = 32 << 20) -> Benchmark:
    """Parse and count the items in tasks, write them, and deal them to shards that one task can hold.

    Items with a null id or without words are left out. Frequencies and lengths are of all items, whatever their shard.
    """
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [item_of(*r.values()) for r in b.to_pylist()]
            tokens = pa.array([sorted(set(x.tokens)) if x else [] for x in own], pa.list_(pa.binary()))
            lengths = pa.array([len(x.tokens) if x else 0 for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lengths, tokens], names=["item_id", "text", "answer", "n", "terms"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    parsed = written(rows.mapInArrow(parse, "item_id long, text string, answer string, n long, terms array<binary>").where("n > 0"), "items")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))
    n, length, total = parsed.agg(F.count("*"), F.sum("n"), F.sum(size)).first()
    shards = max(1, -(-n // shard_items), -(-int(total or 0) // shard_bytes))
    parsed = parsed.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    each = parsed.select("shard", F.explode("terms").alias("term")).groupBy("term", "shard").count()
    counted = each.groupBy("term").agg(F.sum("count").alias("frequency"), F.collect_list("shard").alias("shards"))
    terms = written(counted.select("term", "frequency", F.explode("shards").alias("shard")), "terms")
    return Benchmark(parsed.drop("n", "terms"), terms, n, float(length or 1) / max(n, 1), shards if n else 0)


#: The indexes that a Python worker holds, by name; the oldest goes.
_INDEXES: dict[str, Index] = {}


def _index(name: str, held: Broadcast) -> Index:
    if name not in _INDEXES:
        while len(_INDEXES) > 1:
            del _INDEXES[next(iter(_INDEXES))]
        _INDEXES[name] = Index(*held.value)
    return _INDEXES[name]


def _search(held: Broadcast, overlap: float):
    name = uuid.uuid4().hex

    @F.pandas_udf(_LEAKS)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            index = _index(name, held)
            yield pd.Series([[dict(zip(_LEAK, x, strict=True)) for x in index.leaks(t, overlap)] for t in texts], dtype=object)

    return search.asNondeterministic()


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, shard_items: int = 10_000) -> DataFrame:
    """docs plus leaks, an array of (item_id, score, overlap, question_overlap, answer_overlap), empty if there are none.

    Null and empty texts and items without words leak nothing; items with a null id are left out; repeated items of an
    id count once, by the best match; repeated rows give repeated rows; without items every array is empty. A column
    leaks of docs is replaced. A task holds one shard's index at a time: a benchmark of several shards takes a pass over
    the texts for each, and the leaks of all are put together by row.
    """
    known = benchmark_of(items, shard_items)
    sc = docs.sparkSession.sparkContext
    text = F.col(text_col).cast("string")
    held = lambda k: sc.broadcast((*known.shard(k), threshold))  # noqa: E731 (at most a shard)
    if known.n_shards == 0:
        return docs.withColumn("leaks", F.array().cast(_LEAKS))
    if known.n_shards == 1:
        return docs.withColumn("leaks", _search(held(0), overlap)(text))
    rows = written(docs.drop("leaks").withColumn("__rid", F.monotonically_increasing_id()), "numbered", compression="zstd")
    parts = []
    for k in range(known.n_shards):
        part = held(k)
        found = rows.select("__rid", _search(part, overlap)(text).alias("leaks")).where(F.size("leaks") > 0)
        parts.append(written(found, "leaks"))
        part.destroy()
    every = parts[0]
    for other in parts[1:]:
        every = every.union(other)
    best = every.select("__rid", F.explode("leaks").alias("x")).groupBy("__rid", F.col("x.item_id").alias("i")).agg(F.max_by("x", F.struct("x.score", "x.overlap")).alias("x"))
    merged = best.groupBy("__rid").agg(F.array_sort(F.collect_list("x")).alias("leaks"))
    return rows.join(merged, "__rid", "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(_LEAKS))).drop("__rid")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents into which no item leaked; columns as they were."""
    return find_leaks(docs, items).where(F.size("leaks") == 0).select(*docs.columns)


def op9_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and test item that leaked into it; nulls, ties, empty tables and the like as `find_leaks` says."""
    found = find_leaks(docs.select("doc_id", "text"), items).where(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
