"""MinHash near-dedup with a circulant signature, banding and exact verification.

Signature. Shingle hashes fall into a universe of ``UNIVERSE`` cells, which the first permutation reorders; the second permutation,
shifted circularly by k, gives coordinate k as the least value over a text's cells. A shingle's coordinates are thus one
contiguous window of the second permutation. ``bands_for`` gives as many bands of ``ROWS`` coordinates as keep the chance that a pair at the
threshold meets in none below ``MISSED``: 32 bands at 0.85 (4e-5), 56 at 0.80 (3e-5).

Links. Texts with the same set form one class, of which the smallest id stands for all. In each bucket of a band every class is compared with
the bucket's smallest id (so a group of any size costs one comparison a member), on full sets. Buckets in which more than one
component is left then have their texts compared across components, where prefix and position filters allow enough
common shingles (``across``). No pair that meets in a bucket and could join two components is left out, and pairs inside one
component are never listed.

Defined results: texts without words, nulls among them, have no shingles and link with nothing; fewer words than a shingle
has are one shingle. Rows of one id count as one document, so a link of either is a link of both. A null id has a null component, and is kept. Empty tables
give empty tables; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import components, fresh, in_parts, map_rows, written
from palimpsest.llm.words import batch_words, mix, shingles

UNIVERSE, ROWS, SEED = 1 << 20, 8, 20_011
#: Greatest chance that a pair at the threshold meets in no band.
MISSED = 5e-5
#: Ids of texts to be verified are sent to all tasks up to this many (8 bytes each), else shuffled.
SENT_IDS = 1_000_000
#: Ratio of neighbouring size classes in the comparison across components.
CLASS = 1.03
FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


class Circulant:
    """All coordinates of a set from two permutations of the universe."""

    def __init__(self, universe: int = UNIVERSE, size: int = 32 * ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(universe)
        second = rng.permutation(universe).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((second, second[: size - 1])), size)
        self.mask = np.uint64(universe - 1)

    def __call__(self, hashes: np.ndarray, at_once: int = 512) -> np.ndarray:
        cells = self.first[(hashes & self.mask).astype(np.int64)]
        out = np.full(self.windows.shape[1], 0xFFFFFFFF, np.uint32)
        for k in range(0, len(cells), at_once):
            np.minimum(out, self.windows[cells[k : k + at_once]].min(axis=0), out=out)
        return out


def bands_for(percent: int, rows: int = ROWS, missed: float = MISSED) -> int:
    """The number of bands, a multiple of 8, at which a pair at ``percent`` is missed by all with a chance below ``missed``."""
    return 8 * math.ceil(math.log(missed) / math.log1p(-((percent / 100) ** rows)) / 8)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.reshape(bands, -1).T:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + column)
    return out


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    words, ends = batch_words(texts)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield shingles(words[a:b], width)


def features(docs: DataFrame, width: int, bands: int, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, n_shingles, two hashes of the whole set, one key for each band)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = Circulant(size=bands * rows)
        for frame in in_parts(frames):
            out = []
            for doc, s in zip(frame["doc_id"], _sets(frame["text"].tolist(), width), strict=True):
                whole = (int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(SEED)).sum(dtype=np.uint64)))
                keys = band_keys(sign(s), bands).view(np.int64) if len(s) else None
                out.append((doc, len(s), *np.array(whole, np.uint64).view(np.int64).tolist(), keys))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "h1", "h2", "bands"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_rows(read, each, FEATURES)


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set) of the texts whose ids are asked for."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_parts(frames):
            sets = [s.view(np.int64) for s in _sets(frame["text"].tolist(), width)]
            yield pd.DataFrame({"id": frame["doc_id"], "hashes": sets})

    few = ids.count() <= SENT_IDS
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    read = read.join(F.broadcast(ids) if few else ids, read["doc_id"] == ids["id"], "left_semi")
    return written(read.mapInPandas(each, "id long, hashes array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of intersection and union of their full sets."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("sa")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("all"))


def across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts in different components that may reach ``percent``, by prefix and position; none that do is left out.

    ``rest`` has (id, n, component c). Hashes are ordered by whether they occur in one component only, then by frequency. Texts of n and m
    hashes that are similar enough share at least p * (n + m) / (100 + p), so they share one among the first hashes of
    either, and the hashes from its place on suffice for that number. Hashes of one component come first and are
    never exchanged: a text with enough of its own drops out at once, which keeps the members of a large group apart.
    """
    hashes = rest.join(sets, "id").select("id", "n", "c", F.explode("hashes").alias("g"))
    spread = hashes.groupBy("g").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    spread = spread.where("lo <> hi").select("g", "f")
    own = hashes.join(spread, "g").groupBy("id", "n", "c").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("gs"))
    own = own.select("id", "n", "c", F.col("gs.g").alias("gs"), (F.col("n") - F.size("gs")).alias("k"))
    own = written(own)

    def size_class(x):
        return F.floor(F.log(x) / float(np.log(CLASS))).cast("int")

    def role(mine: str, other: str, low, high) -> DataFrame:
        of = own.withColumn(mine, size_class(F.col("n").cast("double"))).withColumn(other, F.explode(F.sequence(low, high)))
        least = F.greatest(F.lit(1.0), F.floor(F.pow(F.lit(CLASS), F.col(other).cast("double"))))
        need = F.ceil(percent * (F.col("n") + least) / (100 + percent) - 1e-6)
        first = F.greatest(F.lit(0), F.col("n") - need - F.col("k") + 1).cast("int")
        of = of.select("id", "n", "c", "k", "cs", "cl", F.posexplode(F.slice("gs", F.lit(1), first)).alias("j", "g"))
        return of.select("id", "n", "c", "cs", "cl", "g", (F.col("n") - F.col("k") - F.col("j")).alias("left"))

    here = size_class(F.col("n").cast("double"))
    x = role("cs", "cl", here, size_class(F.col("n") * 100.0 / percent) + 1).alias("x")
    y = role("cl", "cs", F.greatest(F.lit(0), size_class(F.greatest(F.lit(1.0), F.col("n") * percent / 100.0)) - 1), here).alias("y")
    could = (F.col("x.g") == F.col("y.g")) & (F.col("x.cs") == F.col("y.cs")) & (F.col("x.cl") == F.col("y.cl"))
    could &= F.col("x.c") != F.col("y.c")
    could &= (F.col("x.cs") < F.col("x.cl")) | (F.col("x.id") < F.col("y.id"))
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, could & enough)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * intersection >= percent * union of their sets of ``width``-word shingles.
    """
    seen = written(features(docs, width, bands_for(percent, rows), rows))
    classes = seen.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles")
    classes = written(classes.agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    keyed = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    leads = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("met")).where("met > 1")
    leads = written(leads.select("key", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))
    met = written(keyed.join(leads, "key").select("key", "id", "n", "lead", "lead_n"))
    fits = lambda x, y: (100 * F.least(x, y)) >= (percent * F.greatest(x, y))
    first = met.where((F.col("id") != F.col("lead")) & fits(F.col("n"), F.col("lead_n")))
    first = written(first.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    sets = _full_sets(docs, met.select("id").distinct(), width)
    tried = written(_verified(first, sets))
    linked = F.col("common") * 100 >= F.col("all") * percent
    links = tried.where(linked).select("a", "b")
    parts = components(links)

    # what a bucket holds beside the component of its smallest id
    placed = met.join(parts.select("id", F.col("component").alias("c")), "id", "left")
    placed = placed.join(parts.select(F.col("id").alias("lead"), F.col("component").alias("lc")), "lead", "left")
    placed = placed.withColumns({"c": F.coalesce("c", "id"), "lc": F.coalesce("lc", "lead")})
    open_keys = placed.where("c <> lc").select("key").distinct()
    rest = written(placed.join(open_keys, "key", "left_semi").select("id", "n", "c").distinct())
    second = across(rest, sets, percent)
    second = written(second.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = written(_verified(second, sets).where(linked).select("a", "b"))
        if not more.isEmpty():
            parts = components(links.union(more))

    of_class = classes.join(parts, "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = seen.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2", "n_shingles"], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", mine)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, columns as they came.

    Rows without an id are kept. Where an id repeats, its different texts are documents of their own, known by a hash of id and text; of
    rows with the same id and text one stays.
    """
    own, twin, gone = (fresh(docs.columns, c) for c in ("own", "twin", "gone"))
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(twin)))
    named = docs.withColumn(own, F.col("doc_id").cast("long"))
    if not again.isEmpty():
        few = again.count() <= SENT_IDS
        rows = named.join(F.broadcast(again) if few else again, F.col("doc_id") == F.col(twin), "left")
        # below zero, so that none of them takes the place of an id that is known once
        coded = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
        many = rows.where(F.col(twin).isNotNull()).withColumn(own, coded).dropDuplicates([own])
        named = written(rows.where(F.col(twin).isNull()).union(many).drop(twin))
    found = near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), width, percent)
    left = written(found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)))
    few = left.count() <= SENT_IDS
    return named.join(F.broadcast(left) if few else left, F.col(own) == F.col(gone), "left_anti").select(docs.columns)
