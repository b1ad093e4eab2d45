"""URL filtering: explicit host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are trained here on labelled URLs, a bounded sample of them; feature cuts are quantiles of the sample, each
tree grows best split first on histograms of gradients, and leaves take Newton steps of the logistic loss. Suffix
statistics, the share of blocked URLs for each hashed host suffix, are counted over all labelled URLs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filter rules, (verdict, host and path prefix).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
SUFFIX_BUCKETS = 4096
_PART = re.compile(r"[a-z0-9]+")
_FEATURES = 20


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    trees: int = 40
    leaves: int = 8
    bins: int = 32
    rate: float = 0.2
    ridge: float = 1.0
    least_rows: int = 5


def split_url(url):
    """(host, path) columns: after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rule(host, path, rules=RULES):
    """(rule, verdict) columns of the longest rule that fits, null if none does; of equal ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{below}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def suffix_bucket(host):
    """The host's last two labels, hashed: a bounded number of statistics however many hosts there are."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SUFFIX_BUCKETS)).cast("int")


def suffix_shares(labelled: DataFrame, smooth: float = 20.0) -> np.ndarray:
    """labelled (bucket, blocked 0/1) -> the smoothed share of blocked URLs by bucket, counted over all rows."""
    rows = labelled.groupBy("bucket").agg(F.sum("blocked").alias("b"), F.count("*").alias("n")).collect()  # SUFFIX_BUCKETS at most
    n, b = np.zeros(SUFFIX_BUCKETS), np.zeros(SUFFIX_BUCKETS)
    for r in rows:
        n[r["bucket"]], b[r["bucket"]] = r["n"], r["b"]
    prior = b.sum() / n.sum() if n.sum() else 0.5
    return (b + smooth * prior) / (n + smooth)


def entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(url: str | None, host: str, path: str, share: float) -> tuple[float, ...]:
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    labels = host.split(".")
    name = labels[-3] if len(labels) > 2 else labels[0]
    digits = sum(c.isdigit() for c in url)
    return (
        len(url),
        len(host),
        len(path),
        len(query),
        len(labels),
        sum(1 for x in path.split("/") if x),
        digits / len(url) if url else 0.0,
        sum(c.isdigit() for c in host),
        host.count("-"),
        entropy(host),
        entropy(path),
        query.count("=") + query.count("&") if query else 0,
        len(query.split("&")) if query else 0,
        float("#" in url),
        float(url[:8].lower() == "https://"),
        float(path.endswith("/")),
        float("." in path.rpartition("/")[2]),
        max((len(x) for x in _PART.findall(path)), default=0),
        len(set(name)) / len(name) if name else 0.0,
        share,
    )


@dataclass
class Model:
    """Boosted trees as arrays: a node's feature (-1: leaf), cut, children and value."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    shares: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of block."""
        out = np.full(len(x), self.start)
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, left[at] + right, at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, settings: Settings = Settings(), shares: np.ndarray | None = None) -> Model:
    """Fit the trees to labels 0/1. Without rows, or with one label only, the model is a constant."""
    shares = np.full(SUFFIX_BUCKETS, 0.5) if shares is None else shares
    mean = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(mean / (1 - mean))), [], shares)
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, settings.bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    width = settings.bins + 1
    slot = binned + np.arange(x.shape[1]) * width
    score = np.full(len(y), model.start)

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        size = x.shape[1] * width
        at = slot[rows].ravel()
        wide = lambda v: np.bincount(at, np.repeat(v[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
        gl, hl = wide(g), wide(h)
        nl = np.bincount(at, minlength=size).reshape(-1, width).cumsum(1)
        gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
        gain = gl**2 / (hl + settings.ridge) + (gt - gl) ** 2 / (ht - hl + settings.ridge) - gt**2 / (ht + settings.ridge)
        gain[(nl < settings.least_rows) | (nt - nl < settings.least_rows)] = 0
        k = int(gain.argmax())
        return float(gain.flat[k]), k // width, k % width

    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut, left, value = [-1], [0.0], [0], [0.0]
        rows_of = {0: np.arange(len(y))}
        options = {0: best(rows_of[0], g, h)}
        while len(rows_of) < settings.leaves:
            node = max(options, key=lambda k: options[k][0])
            gain, f, b = options.pop(node)
            if gain <= 1e-6:
                break
            rows = rows_of.pop(node)
            goes_left = binned[rows, f] <= b
            feature[node], cut[node], left[node] = f, float(cuts[f][b]), len(feature)
            for part in (rows[goes_left], rows[~goes_left]):
                rows_of[len(feature)] = part
                options[len(feature)] = best(part, g, h)
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                value.append(0.0)
            if not options:
                break
        for node, rows in rows_of.items():
            value[node] = -settings.rate * g[rows].sum() / (h[rows].sum() + settings.ridge)
            score[rows] += value[node]
        model.trees.append((np.array(feature), np.array(cut), np.array(left), np.array(value)))
    return model


def _matrix(urls, hosts, paths, buckets, shares: np.ndarray) -> np.ndarray:
    return np.array([lexical(u, h, p, shares[b]) for u, h, p, b in zip(urls, hosts, paths, buckets, strict=True)], float).reshape(len(urls), _FEATURES)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """labelled (url, blocked 0/1) -> the model. Rows with a null in either are left out.

    Trees see about settings.sample_rows distinct labelled URLs, those of the least hashes, weighing each once; suffix
    statistics see all rows. Rows over a bound on the hash stay in their tasks, so what reaches the driver is the sample,
    whatever the input.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("bucket", suffix_bucket(F.col("host"))).withColumn("h", F.xxhash64("url", "blocked"))
    shares = suffix_shares(rows)
    different = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 1.1 * settings.sample_rows / max(1, different))
    least = rows.where(F.col("h") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)))
    sample = least.groupBy("h", "url", "blocked").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("bucket").alias("bucket"))
    sample = sample.toPandas().sort_values(["h", "url", "blocked"]).head(settings.sample_rows)
    x = _matrix(sample["url"], sample["host"], sample["path"], sample["bucket"], shares)
    return boost(x, sample["blocked"].to_numpy(float), settings, shares)


def judge(pages: DataFrame, model: Model, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages plus host, path, rule, p_block and verdict; such columns of pages are replaced.

    The longest rule decides; where none fits, block if the model's probability is over a half. Null URLs and URLs
    without :// have empty host and path and go to the model. Repeated rows give repeated rows, an empty table an empty
    result.
    """
    own = pages.drop("host", "path", "rule", "p_block", "verdict")
    host, path = split_url(F.col(url_col))
    held = pages.sparkSession.sparkContext.broadcast(model)  # bounded by Settings and SUFFIX_BUCKETS

    @F.pandas_udf("double")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for urls, hosts, paths, buckets in batches:
            x = _matrix(urls, hosts, paths, buckets, held.value.shares)
            yield pd.Series(1 / (1 + np.exp(-held.value.score(x))) if len(x) else [], dtype=float)

    rows = own.withColumn("host", host).withColumn("path", path)
    rule, kind = match_rule(F.col("host"), F.col("path"), rules)
    p = blocked.asNondeterministic()(F.col(url_col), "host", "path", suffix_bucket(F.col("host")))
    rows = rows.withColumn("p_block", p).withColumn("rule", rule).withColumn("__by_rule", kind)
    verdict = F.coalesce("__by_rule", F.when(F.col("p_block") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.withColumn("verdict", verdict).drop("__by_rule")


def rule_labels(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """The URLs that a rule decides, as labelled URLs."""
    host, path = split_url(F.col(url_col))
    _, kind = match_rule(host, path, rules)
    return pages.select(F.col(url_col).alias("url"), (kind == "block").cast("int").alias("blocked")).where("blocked is not null")


def op7_url_filter(pages: DataFrame) -> DataFrame:
    """Every page's URL judged by the rules and, beyond them, by trees trained on the URLs that the rules label."""
    picked = pages.select("page_id", "url")
    return judge(picked, fit(rule_labels(picked))).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
