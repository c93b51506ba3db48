"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

Evidence. A logistic regression on the hashed words of the whole text (``CELLS`` cells, a text as a unit vector over those it has) beside
seven shares of its surface, fitted in numpy on at most ``SAMPLE`` labelled rows, those of the smallest id hashes; of a text only its cells come to the driver.
All rows are scored where they lie.

Posteriors. A row says its label where it has one, else its own probability. Grouped sums of this give each host a posterior mean that is
shrunk to the global mean, and each path one that is shrunk to its host's; how strongly follows from the spread between
groups beyond what sampling explains (method of moments). What a row says itself is taken out of its groups, so a label never enters
its own row's score through them. The result is the document's log-odds plus the path's less the global ones.

Defined results: null and empty texts are scored by an empty vector. A null host or path is a group of its own. Sparse
groups fall back on the level above, a group of one on it wholly. Without labels the evidence is 0.5 throughout and everything is kept. Labels
that are repeated count as their mean; null labels and ids as none. Repeated rows are scored alike, empty tables give empty tables, and other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.quality_rules import SYMBOLS
from palimpsest.llm.shared import in_parts, map_rows, written
from palimpsest.llm.words import BLANK, batch_words, mix, shingles

SAMPLE = 8000
CELLS = 8192
SURFACE = ("size", "length", "symbols", "lines", "repeats", "capitals", "bangs")
#: Passes and steps of the regression at least, rows in a step, step size and weight decay.
PASSES, STEPS, STEP, RATE, DECAY = 12, 700, 64, 0.1, 1e-4
#: Host and path groups are sent to all tasks up to this many, else rows and groups are salted and shuffled.
SENT_GROUPS, SALTS = 200_000, 16


def vectors(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(surface shares, distinct cells) of each whole text."""
    hashes, ends = batch_words(texts)
    cells = (mix(hashes) % np.uint64(CELLS)).astype(np.int32)
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        of = np.bincount(data, minlength=256)
        n, chars = b - a, int(of.sum() - of[128:192].sum() - of[BLANK].sum())
        lines = [x for x in (t or "").split("\n") if x.strip()]
        share = lambda x, y: min(1.0, x / max(1, y))
        windows = max(0, n - 2)
        surface = (
            np.log1p(n) / 10, min(1.0, chars / max(1, n) / 20), share(of[[ord(c) for c in SYMBOLS]].sum(), n), share(len(lines) - len(set(lines)), len(lines)),
            share(windows - len(shingles(hashes[a:b], 3)), windows) if windows else 0.0, share(of[65:91].sum(), chars), share(of[33], n),
        )
        yield np.array(surface), np.unique(cells[a:b])


class Evidence:
    """The regression: weights of the surface shares, of the cells, and the intercept."""

    def __init__(self, surface: np.ndarray, cells: np.ndarray, intercept: float):
        self.surface, self.cells, self.intercept = surface, cells, intercept

    def __call__(self, surface: np.ndarray, cells: np.ndarray) -> float:
        found = self.cells[cells].sum() / np.sqrt(max(1, len(cells)))
        return float(np.clip(surface @ self.surface + found + self.intercept, -12, 12))


def fit(surface: np.ndarray, cells: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Evidence:
    """A ridge logistic regression by adaptive steps over the rows in a fixed random order."""
    sizes = np.array([len(c) for c in cells])
    ends, flat = sizes.cumsum(), np.concatenate(cells) if len(cells) else np.zeros(0, np.int32)
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    k = surface.shape[1]
    w, grown = np.zeros(k + CELLS + 1), np.full(k + CELLS + 1, 1e-8)
    w[-1] = np.log((y.mean() + 0.01) / (1.01 - y.mean()))
    rng = np.random.default_rng(seed)
    for _ in range(max(PASSES, STEPS * STEP // max(1, len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), STEP):
            rows = order[at : at + STEP]
            own = np.repeat(np.arange(len(rows)), sizes[rows])
            where = flat[np.repeat(ends[rows] - sizes[rows], sizes[rows]) + np.arange(len(own)) - np.repeat(sizes[rows].cumsum() - sizes[rows], sizes[rows])]
            z = surface[rows] @ w[:k] + np.bincount(own, w[k + where], len(rows)) * scale[rows] + w[-1]
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            g = np.concatenate((off @ surface[rows], np.bincount(where, (off * scale[rows])[own], CELLS), [off.sum()])) + DECAY * w
            grown += g * g
            w -= RATE * g / np.sqrt(grown)
    return Evidence(w[:k], w[k:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> Evidence | None:
    """The regression on at most ``sample`` labelled rows (``labels``: k, y; one row an id); None without any."""
    given = labels.orderBy(F.xxhash64("k"), "k").limit(sample)
    once = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(given), "k")
    once = once.groupBy("k").agg(F.max(F.struct("text", "y")).alias("x")).select("k", "x.text", "x.y")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_parts(frames):
            found = list(vectors(frame["text"].tolist()))
            yield pd.DataFrame({"k": frame["k"], "y": frame["y"], "surface": [s for s, _ in found], "cells": [c for _, c in found]})

    rows = once.select("k", "y", "text").mapInPandas(each, "k long, y double, surface array<double>, cells array<int>").toPandas().sort_values("k")  # bounded
    if not len(rows):
        return None
    return fit(np.array(rows["surface"].tolist()), [np.asarray(c, np.int32) for c in rows["cells"]], rows["y"].to_numpy(float))


def _spread(groups: DataFrame, mean: str) -> float:
    """Prior weight, in rows, of the level above: from the variance of group means beyond that of sampling."""
    one = F.col("s") / F.col("n")
    row = groups.where("n > 1").agg(
        F.count("*"), F.sum("n"), F.sum(F.col("n") * F.pow(one - F.col(mean), 2)), F.sum((F.col("q") - F.col("s") * one) / (F.col("n") - 1))
    ).first()
    groups_n, n, between, within = row
    if not groups_n:
        return 10.0
    noise = within / groups_n
    real = max(between / n - noise * groups_n / n, 1e-6)
    return float(min(1000.0, max(1.0, noise / real)))


def combine(said: DataFrame, key: str = "k") -> DataFrame:
    """Rows (key, evidence, host_mean, path_mean, score, kept) of rows (k, host, path, p, y): probabilities, and labels or null."""
    said = said.withColumns({"host": F.coalesce("host", F.lit("\0")), "path": F.coalesce("path", F.lit("\0")), "o": F.coalesce("y", "p")})
    paths = written(said.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("o").alias("s"), F.sum(F.col("o") * F.col("o")).alias("q")))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = (total[0] if total[0] is not None else 0.5) / (total[1] or 1)
    hosts = written(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq")).withColumn("top", F.lit(mean)))
    host_weight = _spread(hosts, "top")
    paths = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host").withColumn("up", F.col("hs") / F.col("hn"))
    path_weight = _spread(paths, "up")
    groups = written(paths.select("host", "path", "n", "s", "hn", "hs"))
    if groups.count() <= SENT_GROUPS:
        out = said.join(F.broadcast(groups), ["host", "path"])
    else:  # a host may hold a third of all rows
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = said.withColumn("salt", F.pmod(F.xxhash64("k", "p"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    host_mean = (host_weight * F.lit(mean) + F.col("hs") - F.col("o")) / (host_weight + F.col("hn") - 1)
    path_mean = (path_weight * F.col("host_mean") + F.col("s") - F.col("o")) / (path_weight + F.col("n") - 1)
    bounded = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    logit = lambda x: F.log(bounded(x) / (1 - bounded(x)))
    out = out.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    score = 1 / (1 + F.exp(-(logit(F.col("p")) + logit(F.col("path_mean")) - logit(F.lit(mean)))))
    return out.select(F.col("k").alias(key), F.col("p").alias("evidence"), "host_mean", "path_mean", score.alias("score"), (score >= 0.5).alias("kept"))


def posterior(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Rows (key, evidence, host_mean, path_mean, score, kept)."""
    given = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k"))
    given = written(given.agg(F.avg("quality").alias("y")))
    net = train(docs, given, key, text, sample)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_parts(frames):
            odds = np.array([net(s, c) for s, c in vectors(frame["text"].tolist())] if net else np.zeros(len(frame)))
            yield frame[["k", "host", "path"]].assign(p=1 / (1 + np.exp(-odds)))

    rows = docs.select(F.col(key).cast("long").alias("k"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    scored = map_rows(rows, each, "k long, host string, path string, p double", "k")
    return combine(written(scored.join(given, "k", "left")), key)
