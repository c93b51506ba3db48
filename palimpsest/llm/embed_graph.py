"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors form one class each; its smallest id stands for it.
2. Spherical k-means on a bounded sample gives centres, and beyond ``CENTRES`` of them a second level: centres of what the first leave
   over, so that shards are pairs of centres and their number grows with the data while either list stays bounded. Every class goes to its
   ``overlap`` nearest shards. A shard over ``MOST`` classes is dealt into hashed blocks, and every two blocks make a task, so one hot shard is never one task.
3. Each task builds a flat graph: the nearest candidates of a class, robust-pruned (a neighbour drops out if one already
   chosen is closer to it, by the factor ``ALPHA``). A class with more than ``DEGREE`` others in range gets ``SPREAD`` random ones of them
   besides, which joins tight groups whose members fill one another's lists.
4. Adjacency lists of all tasks are united per class, and classes in range that a list names beyond a shard are sent there as guests. Each task
   searches this graph for its own classes: greedily from the medoid up to the query, then, from there and from the query itself, over everything
   within range of it and ``SLACK`` beyond. Cosines are made of classes that the search has met, no others, and in double precision, which verifies links.
5. A pair counts in the first shard that both share, or else in the first where one is a guest, so links
   are counted, not listed; each task hands on one edge per class to the smallest id it can reach.
6. The audit compares a documented sample of queries with all rows by brute force, in blocks: classes of all shards, of the largest one,
   and linked ones. If recall is below ``TARGET``, the graph is built and searched again with more overlap; after ``TRIES`` all blocks are compared
   in pairs without it, so that no link is left out.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do those of another
length. A null id links with nothing, has a null component and is kept. Repeated rows are copies of one class. Empty tables give
empty tables; columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import components, written

COSINE = 0.95
SHARD, MOST, OVERLAP, CENTRES = 1500, 3000, 3, 4096
DEGREE, CANDIDATES, SPREAD, ALPHA, SLACK = 24, 64, 8, 1.2, 0.05
#: Queries that are searched side by side, and vectors that centres are fitted on.
SIDE, FITTED = 256, 65_536
QUERIES, TARGET, TRIES = 256, 0.98, 3


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1)[:, None]


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 3, sphere: bool = True) -> np.ndarray:
    """k-means, on the sphere or in the plane."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ at.T - (0 if sphere else (at * at).sum(axis=1) / 2)).argmax(axis=1) for i in range(0, len(sample), 8192)])
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1) if sphere else np.bincount(near, minlength=len(at))
        at = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], at)
    return at


class Centres:
    """Where vectors go: the nearest of one list of centres, or of the sums of two lists."""

    def __init__(self, sample: np.ndarray, k: int):
        one = k if k <= CENTRES else math.ceil(math.sqrt(k))
        self.first, self.second = centres(sample, one), None
        if k > CENTRES:
            left = sample - self.first[(sample @ self.first.T).argmax(axis=1)]
            self.second = centres(left, math.ceil(k / one), sphere=False)

    def __len__(self) -> int:
        return len(self.first) * (1 if self.second is None else len(self.second))

    @staticmethod
    def _top(near: np.ndarray, fan: int) -> np.ndarray:
        return np.argpartition(-near, fan - 1, axis=1)[:, :fan] if fan < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))

    def __call__(self, x: np.ndarray, fan: int) -> np.ndarray:
        """The ``fan`` nearest shards of each vector, in order of their numbers."""
        near = x @ self.first.T
        one = self._top(near, min(fan, len(self.first)))
        if self.second is None:
            return np.sort(one, axis=1).astype(np.int64)
        shards, far = [], []
        for i in one.T:
            left = x - self.first[i]
            value = left @ self.second.T - (self.second * self.second).sum(axis=1) / 2
            two = self._top(value, min(fan, len(self.second)))
            shards.append(i[:, None] * len(self.second) + two)
            far.append((left * left).sum(axis=1)[:, None] / 2 - np.take_along_axis(value, two, axis=1))
        shards, far = np.concatenate(shards, axis=1), np.concatenate(far, axis=1)
        return np.sort(np.take_along_axis(shards, self._top(-far, fan), axis=1), axis=1).astype(np.int64)


def robust_prune(near: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the pruned graph over a similarity matrix."""
    m, rng = len(near), np.random.default_rng(len(near))
    c = min(CANDIDATES, m - 1)
    if c < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = near.copy()
    np.fill_diagonal(own, -2)
    some = np.argpartition(-own, c - 1, axis=1)[:, :c]
    order = np.argsort(-np.take_along_axis(own, some, axis=1), axis=1, kind="stable")
    some = np.take_along_axis(some, order, axis=1)
    far = 1 - np.take_along_axis(near, some, axis=1)
    alive, rows, source, target = np.ones((m, c), bool), np.arange(m), [], []
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        on = alive[rows, first]
        if not on.any():
            break
        chosen = some[rows, first]
        source.append(rows[on])
        target.append(chosen[on])
        alive &= ALPHA * (1 - near[chosen[:, None], some]) > far
        alive[rows, first] = False
    inside = near >= cosine - SLACK
    np.fill_diagonal(inside, False)
    full = np.flatnonzero(inside.sum(axis=1) > DEGREE)
    for at in range(0, len(full), SIDE):
        part = full[at : at + SIDE]
        drawn = np.argpartition(np.where(inside[part], rng.random((len(part), m), np.float32), -1), -SPREAD, axis=1)[:, -SPREAD:]
        source.append(np.repeat(part, SPREAD))
        target.append(drawn.ravel())
    return np.concatenate(source), np.concatenate(target)


class Graph:
    """Vectors with the lists of their neighbours, both ways."""

    def __init__(self, x: np.ndarray, source: np.ndarray, target: np.ndarray):
        self.x, self.m = x, len(x)
        key = np.unique(np.concatenate((source * self.m + target, target * self.m + source)))
        self.to = key % max(1, self.m)
        self.ends = np.searchsorted(key, np.arange(1, self.m + 1) * self.m)
        self.begins = np.concatenate(([0], self.ends[:-1]))

    def near(self, node: int) -> np.ndarray:
        return self.to[self.begins[node] : self.ends[node]]

    def walk(self, queries: np.ndarray) -> np.ndarray:
        """Where greedy search from the medoid ends for each query: no neighbour is nearer to it."""
        middle = int((self.x @ self.x.mean(axis=0)).argmax())
        at, value = np.full(len(queries), middle), self.x[queries] @ self.x[middle]
        going = np.arange(len(queries))
        while len(going):
            sizes = (self.ends - self.begins)[at[going]]
            going, sizes = going[sizes > 0], sizes[sizes > 0]
            if not len(going):
                break
            begins = sizes.cumsum() - sizes
            own = np.repeat(np.arange(len(going)), sizes)
            met = self.to[np.arange(len(own)) - begins[own] + self.begins[at[going]][own]]
            found = np.concatenate([np.einsum("ij,ij->i", self.x[queries[going[own[i : i + 65536]]]], self.x[met[i : i + 65536]]) for i in range(0, len(own), 65536)])
            best = np.maximum.reduceat(found, begins)
            first = np.flatnonzero(found == best[own])
            first = first[np.unique(own[first], return_index=True)[1]]
            better = best > value[going]
            at[going[better]], value[going[better]] = met[first][better], best[better]
            going = going[better]
        return at

    def search(self, queries: np.ndarray, cosine: float) -> np.ndarray:
        """found[q, x]: the search for the q-th query met x within range. Cosines are made of what the searches side by side have met."""
        out = np.zeros((len(queries), self.m), bool)
        goal = self.walk(queries)
        order = np.argsort(goal, kind="stable")  # queries that end alike meet alike
        for k in range(0, len(order), SIDE):
            rows = order[k : k + SIDE]
            x, side = self.x[queries[rows]], np.arange(len(rows))
            fresh = np.zeros((len(rows), self.m), bool)
            fresh[side, queries[rows]] = True
            fresh[side, goal[rows]] |= np.einsum("ij,ij->i", x, self.x[goal[rows]]) >= cosine - SLACK
            seen, found = fresh.copy(), np.zeros_like(fresh)
            found[side, goal[rows]] = np.einsum("ij,ij->i", x, self.x[goal[rows]]) >= cosine
            while True:
                met = np.zeros_like(fresh)
                for node in np.flatnonzero(fresh.any(axis=0)):
                    met[np.flatnonzero(fresh[:, node])[:, None], self.near(node)] = True
                met &= ~seen
                new = np.flatnonzero(met.any(axis=0))
                if not len(new):
                    break
                seen |= met
                value = np.where(met[:, new], x @ self.x[new].T, -2)
                fresh = np.zeros_like(seen)
                fresh[:, new] = value >= cosine - SLACK
                found[:, new] |= value >= cosine
            out[rows] = found
        out[np.arange(len(queries)), queries] = False
        return out


class Tasks:
    """Classes with their shards, in ``routed`` (id, v, copies, shards), and how many blocks each shard of more than ``MOST`` is dealt into."""

    def __init__(self, routed: DataFrame):
        self.routed = routed
        sizes = routed.select(F.explode("shards").alias("s")).groupBy("s").count().where(F.col("count") > MOST)
        self.blocks = written(sizes.select("s", F.ceil(2 * F.col("count") / MOST).cast("int").alias("blocks")))

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` with shards, once for each task that works on them: columns s, task, block and blocks are added. Nothing is moved for it."""
        rows = rows.withColumn("s", F.explode("shards")).join(self.blocks, "s", "left").fillna(1, ["blocks"])
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("a"), F.greatest("block", x).alias("b"))))
        return rows.withColumn("o", other).withColumn("task", F.concat_ws(":", "s", "o.a", "o.b")).drop("o")


def _tasks(classes: DataFrame, overlap: int, whole: bool = False) -> Tasks:
    """Every class in its ``overlap`` nearest shards; with ``whole`` all in one shard."""
    n = classes.count()
    k = 1 if whole else max(1, math.ceil(n * overlap / SHARD))
    share = min(1.0, min(32 * k, FITTED) / max(1, n))

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"v": [x.tobytes() for x in _unit(frame["v"])] if len(frame) else []})

    drawn = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("v")
    some = [np.frombuffer(r[0]) for r in drawn.mapInPandas(short, "v binary").collect()]  # about FITTED vectors at most
    if not some:
        some = [_unit([r[0]])[0] for r in classes.select("v").limit(1).collect()]
    at = Centres(np.array(some), k) if some else []
    fan = min(overlap, max(1, len(at)))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(shards=list(at(_unit(frame["v"]), fan)))

    return Tasks(written(classes.mapInPandas(route, "id long, v array<double>, copies long, shards array<long>")))


def _search(tasks: Tasks, cosine: float, exact: bool = False) -> DataFrame:
    """Rows (id, n, root): links that each task owns, and the smallest id each class reaches there. ``exact`` does without the graph."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(frame["v"]), frame["id"].to_numpy()
        near = (x @ x.T).astype(np.float32)
        a, b = robust_prune(near, cosine)
        return pd.DataFrame({"id": ids[a], "to": ids[b], "inside": near[a, b] >= cosine - SLACK})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x, ids, m = _unit(frame["v"]), frame["id"].to_numpy(), len(frame)
        own = np.flatnonzero(~frame["guest"].to_numpy(bool))
        if exact:
            found = x @ x.T >= cosine
            np.fill_diagonal(found, False)
        else:
            lists = [np.zeros(0, np.int64) if to is None else np.asarray(to, np.int64) for to in frame["near"]]
            source, to = np.repeat(np.arange(m), [len(g) for g in lists]), np.concatenate(lists)
            at = np.minimum(np.searchsorted(ids, to), m - 1)
            here = ids[at] == to
            found = np.zeros((m, m), bool)
            found[own] = Graph(x, source[here], at[here]).search(own, cosine)
            found |= found.T
        root = np.arange(m)
        linked = np.flatnonzero(found.any(axis=1))
        while len(linked):
            new = np.minimum(root[linked], np.where(found[linked], root, m).min(axis=1))
            if (new == root[linked]).all():
                break
            root[linked] = new
        shard, a, b = (int(p) for p in frame["task"].iloc[0].split(":"))
        i, j = np.nonzero(found)
        members = np.isin(i, own)
        i, j = i[members], j[members]
        shards, block = np.array(frame["shards"].tolist()), frame["block"].to_numpy()
        first = np.full(len(i), -1)
        for c in range(shards.shape[1] - 1, -1, -1):
            first = np.where((shards[j] == shards[i, c][:, None]).any(axis=1), shards[i, c], first)
        mine = (first == shard) & (np.minimum(block[i], block[j]) == a) & (np.maximum(block[i], block[j]) == b)
        # pairs that share no shard belong to the first shard of either's own that the other is a guest of
        for r in np.flatnonzero(first < 0):
            stays = set(frame["stays"].iloc[j[r]])
            mine[r] = shard == next((s for s in shards[i[r]] if s in stays), -1)
        n = np.bincount(i[mine], weights=frame["copies"].to_numpy()[j[mine]], minlength=m)
        keep = (n > 0) | (root < np.arange(m))
        return pd.DataFrame({"id": ids[keep], "n": n[keep].astype(np.int64), "root": ids[root[keep]]})

    none = F.array().cast("array<long>")
    if exact:
        met = tasks.deal(tasks.routed.withColumn("near", none)).withColumns({"guest": F.lit(False), "stays": none})
    else:
        edges = written(tasks.deal(tasks.routed.select("id", "v", "shards")).groupBy("task").applyInPandas(build, "id long, to long, inside boolean"))
        both = edges.select("id", "to", "inside").union(edges.select("to", "id", "inside"))
        listed = written(tasks.routed.join(both.groupBy("id").agg(F.collect_set("to").alias("near")), "id", "left"))
        # classes in range of a shard's member that aren't in that shard; split shards take none
        shards = tasks.routed.select("id", "shards")
        beyond = tasks.deal(both.where("inside").select("id", "to").distinct().join(shards, "id")).where("blocks = 1").select("s", "task", F.col("to").alias("id"))
        beyond = written(beyond.distinct().join(shards, "id").where(~F.array_contains("shards", F.col("s"))).select("s", "task", "id"))
        stays = beyond.groupBy("id").agg(F.collect_set("s").alias("stays"))
        guests = listed.join(beyond.drop("s").join(stays, "id"), "id").withColumns({"block": F.lit(0), "guest": F.lit(True)})
        met = tasks.deal(listed).withColumns({"guest": F.lit(False), "stays": none})
        met = met.select(*TAKEN).union(guests.select(*TAKEN))
    return written(met.select(*TAKEN).groupBy("task").applyInPandas(search, "id long, n long, root long"))


#: What a search sees of a class.
TAKEN = ("task", "id", "v", "copies", "shards", "near", "block", "guest", "stays")


def audit(classes: DataFrame, tasks: Tasks, found: DataFrame, cosine: float, queries: int = QUERIES) -> float:
    """Share of the links of ``queries`` classes, counted over all classes by brute force, that ``found`` (id, n) has.

    Half of them come from all classes, a quarter from the largest shard and a quarter from those found linked.
    """
    drawn = lambda df, n: {r[0]: r[1] for r in df.orderBy(F.xxhash64(F.col("id") + 1), "id").limit(n).select("id", "v").collect()}
    some = drawn(classes, queries // 2)
    if not some:
        return 1.0
    shard = tasks.routed.select(F.explode("shards").alias("s")).groupBy("s").count().orderBy(F.desc("count"), "s").first()[0]
    some |= drawn(tasks.routed.where(F.array_contains("shards", shard)), queries // 4)
    some |= drawn(classes.join(found.where("n > 0").select("id"), "id", "left_semi"), queries // 4)
    ids, asked = np.array(list(some)), _unit(some.values())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(ids), np.int64)
        for frame in frames:
            if len(frame):
                near = (_unit(frame["v"]) @ asked.T >= cosine) & (frame["id"].to_numpy()[:, None] != ids)
                total += frame["copies"].to_numpy() @ near
        yield pd.DataFrame({"id": ids, "truth": total})

    truth = classes.mapInPandas(count, "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
    both = truth.join(found.select("id", "n"), "id", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("n", F.lit(0))))).first()
    return both[1] / both[0] if both[0] else 1.0


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of ``vectors``."""
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("k").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    classes = written(rows.where(F.coalesce(fit, F.lit(False))).groupBy("v").agg(F.min("k").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"))
    links, edges = [], []
    for (size,) in sorted(classes.select(F.size("v")).distinct().collect()):
        same = classes.where(F.size("v") == size)
        for attempt in range(TRIES):
            tasks = _tasks(same, OVERLAP + 2 * attempt)
            met = _search(tasks, cosine)
            counted = met.groupBy("id").agg(F.sum("n").alias("n"))
            if audit(same, tasks, counted, cosine) >= TARGET:
                break
        else:
            met = _search(_tasks(same, 1, whole=True), cosine, exact=True)
            counted = met.groupBy("id").agg(F.sum("n").alias("n"))
        links.append(counted)
        edges.append(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("v", "id", "copies")
    if not links:
        return rows.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    counted, found = links[0], edges[0]
    for more, edge in zip(links[1:], edges[1:], strict=True):
        counted, found = counted.union(more), found.union(edge)
    known = known.join(counted, "id", "left").join(components(found), "id", "left")
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    usable = rows.withColumn("v", F.when(F.coalesce(fit, F.lit(False)), F.col("v")))
    out = usable.join(known, "v", "left")
    own = F.coalesce("c", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("k"), F.lit(True)).alias("kept"))
