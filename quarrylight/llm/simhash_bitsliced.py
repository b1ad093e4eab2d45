"""SimHash near-duplicate detection with a bit-sliced Hamming comparison.

Fingerprints that differ in at most `radius` of 64 bits agree in at least `blocks - radius` of `blocks` bit blocks, so
each choice of that many blocks is a table, and a fingerprint's bits under the table's mask its bucket. Inside a
bucket the fingerprints are stored vertically: word p of 64 lanes holds bit p of 64 fingerprints. A query's bit is
XORed against a whole word, carry-save counters (ones, twos, fours, ...) add the outcome to 64 distances at once, and
blocks of lanes are abandoned as soon as every lane has passed the radius.

Buckets above `bucket_rows` fingerprints are dealt anew by the same rule over the bits that the mask leaves free, level
by level; few enough bits are left in the end that no bucket of distinct fingerprints can be large. So no bucket is
capped and no link is lost, while no task gets an unbounded bucket. Links inside a bucket are emitted as a spanning
forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .components import connected_components

#: Fingerprint of a text without words.
EMPTY = 0
_CHUNK = 1 << 16
_PAIRS = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the whole text: bit b is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return EMPTY
    if len(words) < shingle:
        grams: Iterator[tuple[bytes, ...]] = iter([tuple(words)])
        n = 1
    else:
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
        n = len(words) - shingle + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = np.unpackbits(h[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): a row per row of docs; fp holds the 64 bits as a signed long. Null or wordless text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


def masks(free: list[int], blocks: int, radius: int) -> list[int]:
    """One mask for each choice of blocks - radius of the blocks into which the free bit positions are cut."""
    parts = [list(map(int, x)) for x in np.array_split(np.array(free), blocks)]
    return [sum(1 << p for i in pick for p in parts[i]) for pick in combinations(range(blocks), blocks - radius)]


def levels(blocks: int, radius: int, bucket_rows: int) -> list[list[list[int]]]:
    """Masks of each level: out[level][path] are the masks into which a bucket of that path is dealt."""
    out, paths = [], [0]
    while True:
        out.append([])
        nxt = []
        for fixed in paths:
            free = [p for p in range(64) if not fixed >> p & 1]
            own = [fixed | m for m in masks(free, blocks, radius)]
            out[-1].append(own)
            nxt += own
        paths = nxt
        left = max(64 - m.bit_count() for m in paths)
        if 1 << left <= bucket_rows or left < blocks:
            return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fp: np.ndarray, group: np.ndarray, mask: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bit-sliced comparison of the fingerprints of each group (rows sorted by group).

    fp has a row or value of 64-bit words for each fingerprint; bits under mask are known to be equal in a group.
    Yields the index pairs within the radius, in parts; some in both orders, and every row with itself.
    """
    n = len(fp)
    fp = fp.reshape(n, -1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    within = np.arange(n) - np.repeat(starts, sizes)
    words_of = (sizes + 63) // 64
    first_word = np.r_[0, np.cumsum(words_of)]
    word = np.repeat(first_word[:-1], sizes) + within // 64
    lane = (within % 64).astype(np.uint64)
    word_start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    free = [p for p in range(64 * fp.shape[1]) if not mask >> p & 1]
    bit_of = lambda p: (fp[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
    planes = {p: np.bitwise_or.reduceat(bit_of(p) << lane, word_start) for p in free}
    often = max(6, radius // 2)
    width = np.diff(np.r_[word_start, n])
    full = np.where(width == 64, ~np.uint64(0), (np.uint64(1) << (width % 64).astype(np.uint64)) - np.uint64(1))
    # a query meets its own word and the later ones of its group
    last_word = np.repeat(first_word[1:], sizes)
    n_pairs = last_word - word
    ends = np.cumsum(n_pairs)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        cnt = n_pairs[lo:hi]
        q = np.repeat(np.arange(lo, hi), cnt)
        w = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(word[lo:hi], cnt)
        lo = hi
        counters = [np.zeros(len(q), np.uint64) for _ in range((radius + 1).bit_length())]
        over = np.zeros(len(q), np.uint64)
        for k, p in enumerate(free):
            carry = planes[p][w] ^ (np.uint64(0) - bit_of(p)[q])
            for c in range(len(counters)):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if k % often == often - 1 or k == len(free) - 1:
                alive = full[w] & ~(over | _above(counters, radius))
                keep = alive != 0
                if not keep.all():
                    q, w, over, alive = q[keep], w[keep], over[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                if not len(q):
                    break
        if not len(q):
            continue
        if not free:
            alive = full[w]
        hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(hit)
        yield q[at], word_start[w[at]] + bit


def close_links(fp: np.ndarray, group: np.ndarray, mask: int, radius: int) -> np.ndarray:
    """For each row the index of the least row that pairs within the radius link it to, directly or over others of its group."""
    label = np.arange(len(fp))
    for a, b in close_pairs(fp, group, mask, radius):
        _union(label, a, b)
    return _flat(label)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count exceeds the radius."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for c in range(len(counters) - 1, -1, -1):
        if radius >> c & 1:
            same &= counters[c]
        else:
            more |= same & counters[c]
            same &= ~counters[c]
    return more


def _flat(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label[:] = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook roots of linked rows below the lesser root until all links join equal roots."""
    while True:
        _flat(label)
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def _links_of(rows: DataFrame, own: dict[int, int], radius: int) -> DataFrame:
    """(path, key, fp) rows -> (u, v) links; a bucket's rows meet in one task and stream through it in order."""

    def emit(path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        path, group, fp = path[several], group[several], fp[several]
        for t in np.unique(path):
            at = path == t
            f = fp[at]
            root = close_links(f.view(np.uint64), group[at], own[int(t)], radius)
            linked = root != np.arange(len(f))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(f[linked]), pa.array(f[root[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in batches:
            cols = [np.r_[h, b.column(i).to_numpy(zero_copy_only=False)] for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            path, key, _ = cols
            cut = int(np.flatnonzero((path != path[-1]) | (key != key[-1]))[-1]) + 1 if (path[0], key[0]) != (path[-1], key[-1]) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from emit(*(c[:cut] for c in cols))
        if len(held[0]):
            yield from emit(*held)

    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(n, "path", "key").sortWithinPartitions("path", "key")
    return dealt.mapInArrow(run, "u long, v long")


def _deal(rows: DataFrame, level: list[list[int]]) -> DataFrame:
    """Each row of (path, fp) once for every mask of its path: (path', key, fp)."""
    width = len(level[0])
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in level])
    own = table.getItem(F.col("path").cast("int")) if len(level) > 1 else table.getItem(0)
    out = rows.select("path", "fp", F.posexplode(own).alias("k", "mask"))
    return out.select((F.col("path") * width + F.col("k")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(fps: DataFrame, radius: int = 2, blocks: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp long) -> (u, v) links that join the same fingerprints as all pairs within the radius."""
    steps = levels(blocks, radius, bucket_rows)
    rows, found = fps.select(F.lit(0).cast("long").alias("path"), "fp"), None
    for i, level in enumerate(steps):
        dealt = _deal(rows, level)
        own = dict(enumerate(m for ms in level for m in ms))
        hot = None
        if i < len(steps) - 1:
            hot = written(dealt.groupBy("path", "key").count().where(F.col("count") > bucket_rows).select("path", "key"), "hot")
            if hot.isEmpty():
                hot = None
        cold = dealt if hot is None else dealt.join(hot, ["path", "key"], "left_anti")
        part = _links_of(cold, own, radius)
        found = part if found is None else found.union(part)
        if hot is None:
            break
        rows = written(dealt.join(hot, ["path", "key"], "left_semi").select("path", "fp"), "hot_rows")
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 4, bucket_rows: int = 4096
) -> DataFrame:
    """(id, fp, component): every row of docs with its fingerprint and the least id that links reach from it.

    Null text counts as empty; wordless texts share fingerprint 0. Rows with a null id keep their fingerprint and get
    the component of the others that share it (null if none does). Repeated rows and ties share a fingerprint and so a
    component; an empty table gives an empty result; other columns of docs are ignored.
    """
    each = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = written(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(least.select("fp"), radius, blocks, bucket_rows))
    named = roots.join(least, roots["node"] == least["fp"]).select("fp", "root", "least")
    lowest = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.join(lowest, "root").select("fp", "component")
    class_of = least.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return each.join(class_of, "fp").select("id", "fp", "component")


# ---------------------------------------------------------------------------------------------------------------
# Similarity of 0.8 over five-word shingles. Such texts differ in about 76 of 512 bits, too many for tables of equal
# bits; buckets come from minima of the shingle hashes instead. The bit-sliced comparison proposes pairs in each bucket,
# and the exact Jaccard similarity of their shingle sets decides.

WIDE_WORDS = 8
#: Of 512 bits, the expected distance at a Jaccard similarity of 0.8 is 78 with a deviation of 8; in texts of a few shingles
#: up to 96 with 9, as an even number of shingles can tie. Both limits lie four deviations off.
WIDE_RADIUS, LONG_RADIUS, LONG_SHINGLES = 132, 112, 40
#: Proposals of the first round, which are mostly similar.
NEAR_RADIUS = 80
SIMILARITY = 0.8
_BANDS, _BAND_ROWS = 12, 3
_DRAW = np.random.default_rng(256).integers(1 << 63, size=_BANDS * _BAND_ROWS + WIDE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FP = [f"f{i}" for i in range(WIDE_WORDS)]


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def wide_fingerprint(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WIDE_WORDS words of SimHash over the distinct shingles, a bucket key from each band of shingle minima)."""
    if not len(h):
        return np.zeros(WIDE_WORDS, np.uint64), np.arange(_BANDS, dtype=np.uint64)
    fp = np.empty(WIDE_WORDS, np.uint64)
    for i in range(WIDE_WORDS):
        counts = np.zeros(64, np.int64)
        mixed = _spread(h * _DRAW[i])
        for k in range(0, len(h), _CHUNK):
            counts += np.unpackbits(mixed[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        fp[i] = np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]
    least = np.array([_spread(h * d).min() for d in _DRAW[WIDE_WORDS:]]).reshape(_BANDS, _BAND_ROWS)
    keys = np.arange(_BANDS, dtype=np.uint64)
    for r in range(_BAND_ROWS):
        keys = _spread(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return fp, keys


def _wide(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, keys, f0..) for each row of docs (id, text); n is the number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = (shingle_hashes(t.as_py(), shingle) for t in b.column(1))
            each = [(len(h), *wide_fingerprint(h)) for h in hashes]
            fp = np.array([x[1] for x in each], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            keys = pa.array([x[2].view(np.int64) for x in each], pa.list_(pa.int64()))
            cols = [b.column(0), pa.array([x[0] for x in each], pa.int64()), keys, *[pa.array(fp[:, i]) for i in range(WIDE_WORDS)]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "keys", *_FP])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in _FP))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) for each row of docs (id, text): the sorted shingle hashes, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], names=["id", "hashes"])

    return docs.select("id", "text").mapInArrow(run, "id long, hashes binary")


def jaccard_reached(a: set | frozenset, b: set | frozenset, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is `similarity` or more; two empty sets are equal."""
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def similar(a: str | None, b: str | None, shingle: int = 5, similarity: float = SIMILARITY) -> bool:
    return jaccard_reached(set(shingle_hashes(a, shingle).tolist()), set(shingle_hashes(b, shingle).tolist()), similarity)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) pairs whose shingle sets (id, hashes) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: set(np.frombuffer(x.as_py(), np.uint64).tolist())
        for b in batches:
            keep = [jaccard_reached(of(x), of(y)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("hashes").alias("y"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _by_group(rows: DataFrame, by: list[str], schema: str, work) -> DataFrame:
    """work(columns, group) over whole groups of equal `by`, which stream through a task in order; columns as Arrow arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def emit(part: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: part.column(c).combine_chunks() for c in part.column_names}
            keys = [cols[c].to_numpy(zero_copy_only=False) for c in by]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            yield from work(cols, np.cumsum(new) - 1)

        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            end = [held.column(c)[-1].as_py() for c in by]
            other = np.flatnonzero(np.any([held.column(c).to_numpy() != e for c, e in zip(by, end, strict=True)], axis=0))
            if len(other):
                cut = int(other[-1]) + 1
                yield from emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from emit(held)

    return rows.repartition(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "id").mapInArrow(run, schema)


def _matrix(cols: dict) -> np.ndarray:
    return np.stack([cols[c].to_numpy(zero_copy_only=False) for c in _FP], 1).view(np.uint64)


def _proposed_pairs(fp: np.ndarray, n: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance), a before b: pairs in a group that may be similar by bits and by numbers of shingles."""
    for a, b in close_pairs(fp, group, 0, radius):
        once = a < b
        a, b = a[once], b[once]
        distance = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64)
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fits = (low >= SIMILARITY * high - 1e-9) & ((distance <= LONG_RADIUS) | (low < LONG_SHINGLES))
        yield a[fits], b[fits], distance[fits]


def _stars(rows: DataFrame) -> DataFrame:
    """Rows (key, chunk, id, n, f0..) -> (key, u, v): in each group the rows of most close neighbours with these, each row
    with one of them, and a pair (u, u) for each row that may be similar to another one. As many rows come as go in, twice."""

    def work(cols: dict, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, keys, n, fp = (cols["id"].to_numpy(), cols["key"].to_numpy(), cols["n"].to_numpy(), _matrix(cols))
        several = np.bincount(group)[group] > 1
        ids, keys, n, fp, group = ids[several], keys[several], n[several], fp[several], group[several]
        if not len(ids):
            return
        met, degree, near = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), []
        for a, b, distance in _proposed_pairs(fp, n, group, WIDE_RADIUS):
            met[a] = met[b] = True
            close = distance <= NEAR_RADIUS
            a, b = a[close], b[close]
            np.add.at(degree, a, 1)
            np.add.at(degree, b, 1)
            near.append((a.astype(np.int32), b.astype(np.int32)))
        # each row goes to the neighbour of most neighbours, itself included
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, -degree))] = np.arange(len(ids))
        top = rank.copy()
        for a, b in near:
            np.minimum.at(top, a, rank[b])
            np.minimum.at(top, b, rank[a])
        centre = np.argsort(rank)[top]
        linked = centre != np.arange(len(ids))
        u, v, k = np.r_[ids[met], ids[linked]], np.r_[ids[met], ids[centre[linked]]], np.r_[keys[met], keys[linked]]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(u), pa.array(v)], names=["key", "u", "v"])

    return _by_group(rows.select("key", "chunk", "id", "n", *_FP), ["key", "chunk"], "key long, u long, v long", work)


def _exact_links(rows: DataFrame) -> DataFrame:
    """Rows (key, low, high, mine, id, component, n, keys, f0.., hashes) -> (u, v) links between components, each verified.

    Where low and high differ only rows of different `mine` meet. A pair is judged in the first bucket that it shares,
    the closest pairs first, and not if links found before have joined the two.
    """

    def work(cols: dict, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        take = lambda c: cols[c].to_numpy(zero_copy_only=False)
        ids, component, mine, key = take("id"), take("component"), take("mine"), take("key")
        across = take("low") != take("high")
        own_keys = np.array(cols["keys"].to_pylist(), np.int64)
        sets: dict[int, frozenset] = {}

        def of(i: int) -> frozenset:
            if i not in sets:
                sets[i] = frozenset(np.frombuffer(cols["hashes"][i].as_py(), np.uint64).tolist())
            return sets[i]

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b, distance in _proposed_pairs(_matrix(cols), take("n"), group, WIDE_RADIUS):
            fits = (component[a] != component[b]) & (~across[a] | (mine[a] != mine[b]))
            a, b, distance = a[fits], b[fits], distance[fits]
            same = own_keys[a] == own_keys[b]
            first = own_keys[a, same.argmax(axis=1)] == key[a]
            found.append((a[first], b[first], distance[first]))
        if not found:
            return
        a, b, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(distance, kind="stable")
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        u, v = [], []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            x, y = root(int(component[i])), root(int(component[j]))
            if x != y and jaccard_reached(of(i), of(j)):
                up[max(x, y)] = min(x, y)
                u.append(int(ids[i]))
                v.append(int(ids[j]))
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    names = ["key", "low", "high", "mine", "id", "component", "n", "keys", *_FP, "hashes"]
    return _by_group(rows.select(*names), ["key", "low", "high"], "u long, v long", work)


def _cells(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """rows (key, component, id, ..) -> also low, high, mine: a bucket is one cell, or cut where it exceeds bucket_rows.

    The rows of a large bucket's largest component needn't meet each other, so they are cut into chunks that meet only
    the chunks of the other rows; those meet one another too. Every pair of different components meets in one cell.
    """
    counts = written(rows.groupBy("key", "component").count(), "cell_counts")
    sizes = counts.groupBy("key").agg(F.sum("count").alias("rows"), F.max(F.struct("count", F.col("component").alias("c"))).alias("main"))
    half = max(1, bucket_rows // 2)
    large = sizes.where(F.col("rows") > bucket_rows).select("key", F.col("main.c").alias("__main"), F.ceil(F.col("main.count") / half).alias("__m"), F.ceil((F.col("rows") - F.col("main.count")) / half).alias("__o"))
    joined = rows.join(large, "key", "left")
    is_main = F.col("component") == F.col("__main")
    # chunks of the other rows are 0, 1, ..; those of the largest component -1, -2, ..
    mine = F.when(is_main, -1 - F.pmod(F.xxhash64("id"), F.col("__m"))).otherwise(F.pmod(F.xxhash64("id"), F.col("__o")))
    others, mains = F.sequence(F.lit(0).cast("long"), F.col("__o") - 1), F.sequence(-F.col("__m"), F.lit(-1).cast("long"))
    met = F.when(is_main & (F.col("__o") > 0), others).when(~is_main, F.concat(mains, others)).otherwise(F.array().cast("array<long>"))
    meets = F.explode(F.when(F.col("__main").isNull(), F.array(F.lit(0).cast("long"))).otherwise(met))
    out = joined.withColumn("mine", F.coalesce(mine, F.lit(0).cast("long"))).withColumn("__other", meets)
    return out.withColumn("low", F.least("mine", "__other")).withColumn("high", F.greatest("mine", "__other")).drop("__main", "__m", "__o", "__other")


def similar_components(docs: DataFrame, shingle: int = 5, bucket_rows: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, text) -> (id, component): near copies (Jaccard similarity of 0.8 or more) share the least id.

    Two rounds: the first links every text to the one of its close ones that has most of them itself, bucket by bucket,
    which joins most of a group with few pairs. The second takes the buckets in which texts that may be similar still lie
    in different components, and judges every such pair within the bucket, shingle sets at hand: only links leave it, at
    most one less than there are rows. Each link of both is verified by the shingle sets.

    Buckets above bucket_rows are cut (see `_cells`), so no link of a hot bucket is lost and no task gets all of it. Null
    text counts as empty, wordless texts are one group, null ids are left out. Repeated rows give repeated rows; an empty
    table gives an empty result.
    """
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    each = written(_wide(named, shingle), "wide")
    least = each.groupBy(*_FP).agg(F.min(F.struct("id", "n", "keys")).alias("x")).select(*_FP, "x.*")
    least = written(least, "distinct")
    rows = least.select(F.explode("keys").alias("key"), "id", "n", *_FP)
    hot = written(rows.groupBy("key").count().where(F.col("count") > bucket_rows), "hot")
    dealt = rows.join(hot, "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / bucket_rows)), F.lit(0).cast("long")))
    stars = written(_stars(dealt), "stars")
    met = stars.where("u = v").select("key", F.col("u").alias("id"))
    # the first round sees a chunk of a hot bucket at a time, so all its rows stay open
    met = written(met.union(rows.join(hot, "key", "left_semi").select("key", "id")).distinct(), "met")
    sets = written(_sets(named.join(met.select("id").distinct(), "id", "left_semi"), shingle).dropDuplicates(["id"]), "sets", compression="zstd")
    links = written(_verified(stars.where("u != v").select("u", "v").distinct(), sets), "links")
    roots = written(connected_components(links), "roots")
    placed = met.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("component"))
    placed = written(placed, "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("key")
    still = _cells(placed.join(split, "key", "left_semi"), bucket_rows)
    still = still.join(least.select("id", "n", "keys", *_FP), "id").join(sets, "id")
    links = links.union(written(_exact_links(still), "links"))
    roots = connected_components(links)
    known = least.select(*_FP, F.col("id").alias("node")).join(roots, "node", "left").select(*_FP, F.coalesce("root", "node").alias("component"))
    return each.join(known, _FP).select("id", "component")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the row with the least doc_id (nulls last), columns as they were.

    Rows are told apart by a number written with them: different texts that share a doc_id, or have none, are different
    documents, and equal rows are copies of one. Null and empty texts are one group. An empty table gives an empty result.
    """
    rows = written(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered", compression="zstd")
    groups = similar_components(rows.select("__rid", "text"), id_col="__rid").withColumnRenamed("id", "__rid")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__rid")).alias("x")
    kept = rows.select("__rid", "doc_id").join(groups, "__rid").groupBy("component").agg(order).select(F.col("x.__rid").alias("__rid"))
    return rows.join(kept, "__rid", "left_semi").select(*docs.columns)


def op8_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs; nulls, ties, empty tables and the like as `near_duplicates` says."""
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
