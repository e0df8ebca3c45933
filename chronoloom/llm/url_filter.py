"""URL verdicts: explicit rules, and gradient-boosted trees for what no rule fits.

The trees are trained here, from URLs that rules label, on lexical features: lengths,
depth, digit ratio, entropy, parameter counts, and statistics of the host's suffix and
of the path's first segment (how often labelled URLs with them are blocked).

A null URL, or one without ``://``, has an empty host and path; no rule fits it and the
trees judge its features. Repeated rows are judged alike, and URLs of any length whole.
Without labelled URLs everything that no rule fits is allowed. Output columns replace
input columns of the same name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .pieces import bound_batches

#: Suffixes and segments are counted in so many buckets: what the driver gathers and
#: broadcasts has at most this many rows of each kind.
BUCKETS = 4096
#: Different labelled URLs that the trees are fitted on, those with the smallest hashes, each
#: with its number of rows as its weight; the statistics use all.
SAMPLE = 4_000


class Rule(NamedTuple):
    """``allow`` or ``block`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def _upto(text: Column, marks: str) -> Column:
    """The part before the first of some characters. Plain searches: no text can make them recurse."""
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(_upto(_after_scheme(url), "/?#"), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _after_scheme(url)
    return _upto(rest.substr(F.length(_upto(rest, "/?#")) + 1, F.length(rest)), "?#")


def fitting_rule(rules: list[Rule], host: Column, path: Column, pick) -> Column:
    """``pick(rule)`` of the longest rule that fits; null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(pick(rule))) if out is None else out.when(fits, F.lit(pick(rule)))
    return F.lit(None).cast("string") if out is None else out


def suffix_bucket(host: str) -> int:
    return zlib.crc32(host.rpartition(".")[2].encode()) % BUCKETS


def segment_bucket(path: str) -> int:
    return zlib.crc32(path.lstrip("/").partition("/")[0].encode()) % BUCKETS


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical_features(url: str | None, host: str, path: str, suffixes: dict, segments: dict, prior: float) -> list[float]:
    """The row of numbers that the trees read; finite for every url."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)

    def rate(stats: dict, bucket: int) -> tuple[float, float]:
        blocked, seen = stats.get(bucket, (0, 0))
        return (blocked + 10 * prior) / (seen + 10), math.log1p(seen)

    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count("."), digits / max(1, len(url)),
        sum(c.isdigit() for c in path) / max(1, len(path)), entropy(url), entropy(host), query.count("=") + 0.0,
        float(bool(query)) + query.count("&"), float("#" in url), host.count("-") + 0.0, float(url[:8].lower() == "https://"),
        max((len(p) for p in path.split("/")), default=0), *rate(suffixes, suffix_bucket(host)), *rate(segments, segment_bucket(path)),
    ]


class BoostedTrees:
    """Gradient boosting of shallow trees for the logistic loss, over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0):
        self.rounds, self.depth, self.bins, self.rate, self.ridge = rounds, depth, bins, rate, ridge
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, rows: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> BoostedTrees:
        """Fit on one row for each example; ``times`` weighs them (by 1 each if absent)."""
        times = np.ones(len(labels)) if times is None else times * (len(times) / max(1.0, times.sum()))
        positive = ((times * labels).sum() + 0.5) / (len(labels) + 1)
        self.base = math.log(positive / (1 - positive))
        if not len(labels):
            self.base = -1.0
            return self
        marks = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, marks)) for c in rows.T]
        binned = self._bin(rows)
        score = np.full(len(labels), self.base)
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, times * (labels - chance), times * chance * (1 - chance))
            self.trees.append(tree)
            score += self.rate * tree[2][leaf]
        return self

    def _bin(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, rows.T)], axis=1)

    def _grow(self, binned: np.ndarray, slope: np.ndarray, weight: np.ndarray):
        """One tree as (feature, threshold, value) by node of a complete binary tree."""
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(binned), int)
        for node in range(size):
            here = np.flatnonzero(at == node)
            if not len(here):
                continue
            g, h = slope[here], weight[here]
            value[node] = g.sum() / (h.sum() + self.ridge)
            if node >= size // 2:
                continue
            best, whole = 1e-6, g.sum() ** 2 / (h.sum() + self.ridge)
            for f in range(binned.shape[1]):
                n = len(self.edges[f]) + 1
                left_g, left_h = np.cumsum(np.bincount(binned[here, f], g, n))[:-1], np.cumsum(np.bincount(binned[here, f], h, n))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + self.ridge) - whole
                if len(gain) and gain.max() > best:
                    best, feature[node], threshold[node] = gain.max(), f, int(gain.argmax())
            if feature[node] >= 0:
                at[here] = 2 * node + 1 + (binned[here, feature[node]] > threshold[node])
        return (feature, threshold, value), at

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The chance that each row is positive."""
        score = np.full(len(rows), self.base)
        if self.trees and len(rows):
            binned, every = self._bin(rows), np.arange(len(rows))
            for feature, threshold, value in self.trees:
                at = np.zeros(len(rows), int)
                for _ in range(self.depth):
                    f = feature[at]
                    at = np.where(f >= 0, 2 * at + 1 + (binned[every, np.maximum(f, 0)] > threshold[at]), at)
                score += self.rate * value[at]
        return 1 / (1 + np.exp(-score))


class UrlModel(NamedTuple):
    trees: BoostedTrees
    suffixes: dict[int, tuple[int, int]]
    segments: dict[int, tuple[int, int]]
    prior: float

    def features(self, urls, hosts, paths) -> np.ndarray:
        rows = [lexical_features(u, h, p, self.suffixes, self.segments, self.prior) for u, h, p in zip(urls, hosts, paths)]
        return np.array(rows, float).reshape(len(rows), 20)


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fit on (url, host, path, blocked); statistics over all rows, trees over ``sample`` URLs at most."""

    @arrow_udf("int")
    def suffix(hosts: pa.Array) -> pa.Array:
        return pa.array([suffix_bucket(h) for h in hosts.to_pylist()], pa.int32())

    @arrow_udf("int")
    def segment(paths: pa.Array) -> pa.Array:
        return pa.array([segment_bucket(p) for p in paths.to_pylist()], pa.int32())

    counted = labelled.groupBy(F.substring_index("host", ".", -1).alias("host"), F.substring_index(F.ltrim("path", F.lit("/")), "/", 1).alias("path")).agg(F.sum(F.col("blocked").cast("long")).alias("b"), F.count("*").alias("n"))
    counted = counted.select(suffix("host").alias("suffix"), segment("path").alias("segment"), "b", "n")
    sides = counted.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("suffix").alias("bucket")), F.struct(F.lit(1).alias("side"), F.col("segment").alias("bucket")))).alias("k"), "b", "n")
    stats: list[dict[int, tuple[int, int]]] = [{}, {}]
    for row in sides.groupBy("k.side", "k.bucket").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows at most
        stats[row.side][row.bucket] = row.b, row.n
    seen = sum(n for _, n in stats[0].values())
    prior = sum(b for b, _ in stats[0].values()) / seen if seen else 0.0
    # equal URLs are one example, combined before the shuffle; the order does not depend on the partitioning
    urls = labelled.groupBy("url", "host", "path").agg(F.max(F.col("blocked").cast("int")).alias("y"), F.count("*").alias("n"))
    rows = urls.orderBy(F.xxhash64("url", F.lit(17)), "url").limit(sample).toArrow()
    empty = UrlModel(BoostedTrees(), stats[0], stats[1], prior)
    features = empty.features(rows["url"].to_pylist(), rows["host"].to_pylist(), rows["path"].to_pylist())
    return empty._replace(trees=BoostedTrees().fit(features, np.array(rows["y"].to_pylist(), float), np.array(rows["n"].to_pylist(), float)))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score (0 to 1, the trees' chance of a block)."""
    bound_batches(pages.sparkSession)
    known = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    known = known.withColumn("rule", fitting_rule(rules, F.col("host"), F.col("path"), lambda r: r.name))
    ruled = fitting_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict)
    labelled = known.where("rule is not null").select(F.col(url).alias("url"), "host", "path", (ruled == "block").alias("blocked"))
    shipped = pages.sparkSession.sparkContext.broadcast(train(labelled, sample))  # at most 2 * BUCKETS counts and 40 small trees

    @arrow_udf("double")
    def score(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> pa.Array:
        model = shipped.value
        return pa.array(model.trees.predict(model.features(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist())), pa.float64())

    judged = known.withColumn("block_score", score(F.col(url), F.col("host"), F.col("path")))
    return judged.withColumn("verdict", F.coalesce(ruled, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")))
