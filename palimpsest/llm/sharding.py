"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit.

A row's address is 120 bits: 60 of its key's hash, then 60 that tell copies of one key apart. Rows of one key and size are interchangeable,
so they are counted, never listed: the copies of such a group lie at even steps round a circle of 2^60 places from the
hash of (key, size) on, and how many of them fall into any bucket is arithmetic. A bucket of depth d holds the rows that agree in the
first d bits; the directory is every bucket that fits while its parent doesn't. Bytes are summed per cell of a deeper level first and rolled up
from the cells, so nothing is moved once per level. Cells that are still too large, those of hot keys, go on to as many more bits
as their bytes call for.

Defined results: null texts have 0 bytes, null keys share the address of the empty key. A key or a repeated row that holds a third of all
rows splits like anything else. One row over the limit gets a shard of its own. An empty table gives an empty table. Only the key
and text columns are read, whatever others exist.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import fresh, written

KEY_BITS, ALL_BITS = 60, 120
#: Rows that one row of counts is expanded to at once.
RUN = 4096


def _bits(value: Column) -> Column:
    """60 bits of a string's hash."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _leaves(rows: DataFrame, copies: bool, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows in their shallowest bucket from level ``top`` to ``deep`` that fits (column best), and the others.

    ``rows`` hold n copies each of n_bytes in the cell (hi, lo): the first ``deep`` bits of the address, 60 of them in hi if ``copies``.
    """
    cell = ["hi", "lo", "top", "deep"]
    cells = rows.groupBy(*cell).agg(F.sum(F.col("n") * F.col("n_bytes")).alias("bytes"), F.sum("n").alias("docs"))
    cells = written(cells)
    up = cells.withColumn("depth", F.explode(F.sequence("top", "deep")))
    cut = F.expr("shiftright(lo, deep - depth)") if copies else F.expr("shiftright(hi, deep - depth)")
    up = up.withColumns({"phi": F.col("hi") if copies else cut, "plo": cut if copies else F.lit(0).cast("long")})
    nodes = up.groupBy("depth", "phi", "plo").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    nodes = written(nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)))
    # no cell has its bucket above the shallowest that fits, where a few nodes would gather all cells
    lowest = nodes.agg(F.min("depth")).first()[0]
    found = up.where(F.col("depth") >= (lowest or 0)).join(nodes, ["depth", "phi", "plo"])
    best = F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("best")
    leaves = cells.select(*cell, "bytes", "docs").join(found.groupBy(*cell).agg(best), cell, "left")
    placed = written(rows.join(leaves, cell))
    return placed.where("best is not null"), placed.where("best is null")


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of cells that are too large, dealt over cells of some more bits: as many as their bytes call for, and two."""
    more = F.least(F.lit(ALL_BITS) - F.col("deep"), F.ceil(F.log2(F.greatest(F.lit(2.0), F.col("bytes") / limit))) + 2).cast("int")
    rows = rows.repartition("k", "n_bytes").withColumns({"e": more, "step": F.expr(f"greatest(1L, shiftleft(1L, {KEY_BITS}) div c)"), "room": F.expr(f"{ALL_BITS} - deep")})

    def before(x: str) -> str:
        """How many copies of the group lie before place ``x`` of the circle, unrolled from its start on."""
        return f"least(c, (greatest(0L, {x} - start) + step - 1) div step)"

    a, b, turn = "shiftleft(lo, room)", "shiftleft(lo + 1, room)", f"shiftleft(1L, {KEY_BITS})"
    run = lambda x, y: f"if({before(y)} > {before(x)}, sequence({before(x)}, {before(y)} - 1), array())"
    each = f"transform(concat({run(a, b)}, {run(f'{a} + {turn}', f'{b} + {turn}')}), i -> shiftright((start + i * step) & ({turn} - 1), room - e))"
    every = "sequence(shiftleft(lo, e), shiftleft(lo + 1, e) - 1)"
    cells = rows.withColumn("lo", F.explode(F.expr(f"if(n <= shiftleft(1L, e), array_distinct({each}), {every})")))
    cells = cells.withColumns({"top": F.col("deep") + 1, "deep": F.col("deep") + F.col("e")}).withColumn("room", F.expr(f"{ALL_BITS} - deep"))
    count = f"{before(b)} - {before(a)} + {before(f'{b} + {turn}')} - {before(f'{a} + {turn}')}"
    return cells.withColumn("n", F.expr(count)).where("n > 0").select(*GROUP, "hi", "lo", "top", "deep", "n")


GROUP = ["k", "n_bytes", "c", "key_bits", "start"]


def buckets(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k, n_bytes, n, shard, depth, shard_bytes, shard_docs): how many rows of a key and size go to which shard."""
    sized = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    named = F.coalesce(F.col("k").cast("string"), F.lit(""))
    groups = sized.groupBy("k", "n_bytes").agg(F.count("*").alias("c"))
    rows = written(groups.withColumns({"key_bits": _bits(named), "start": _bits(F.concat_ws(":", named, "n_bytes"))}))
    total = rows.agg(F.sum(F.col("n_bytes") * F.col("c"))).first()[0] or 0
    first = min(KEY_BITS - 20, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    top, done = 0, []
    for deep in (first, KEY_BITS):
        cell = {"n": F.col("c"), "hi": F.shiftright("key_bits", KEY_BITS - deep), "lo": F.lit(0).cast("long"), "top": F.lit(top), "deep": F.lit(deep)}
        fit, rest = _leaves(rows.withColumns(cell), False, limit)
        done.append(fit)
        rows, top, more = rest.select(*GROUP), deep + 1, not rest.isEmpty()
        if not more:
            break
    rows = rest.withColumns({"hi": F.col("key_bits"), "lo": F.lit(0).cast("long")})
    while more:
        fit, rest = _leaves(_split(rows.where(F.col("deep") < ALL_BITS), limit), True, limit)
        done += [fit, rows.where(F.col("deep") >= ALL_BITS)]
        rows, more = rest, not rest.isEmpty()
    depth = F.coalesce("best.depth", F.lit(ALL_BITS))
    low = F.when(F.col("deep") > KEY_BITS, F.expr(f"lpad(bin(lo), greatest(deep - {KEY_BITS}, 1), '0')")).otherwise("")
    path = F.concat(F.lpad(F.bin("key_bits"), KEY_BITS, "0"), low)
    made = [
        part.select("k", "n_bytes", "n", path.substr(F.lit(1), depth).alias("shard"), depth.cast("int").alias("depth"),
                    F.coalesce("best.shard_bytes", "bytes").alias("shard_bytes"), F.coalesce("best.shard_docs", "docs").alias("shard_docs"))
        for part in done
    ]
    return functools.reduce(DataFrame.union, made)


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, shard, depth, shard_bytes, shard_docs), one for each row of ``docs``."""
    counted = buckets(docs, limit, key, text)
    # long runs are parted first and dealt over tasks, so that no row is expanded to more than RUN at once
    long = counted.where(F.col("n") > RUN).withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})"))).repartition("shard", "part")
    long = long.withColumn("n", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("part") * RUN)).select(counted.columns)
    out = counted.where(F.col("n") <= RUN).union(long).withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    return out.select(F.col("k").alias(key), "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def directory(assigned: DataFrame) -> DataFrame:
    """The directory's buckets: (shard, depth, shard_bytes, shard_docs)."""
    return assigned.select("shard", "depth", "shard_bytes", "shard_docs").distinct()


def attach(docs: DataFrame, assigned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the column ``shard`` that ``assigned`` gives them (replacing one of that name).

    Rows of one key and size are interchangeable: they are numbered per input partition, with offsets from the
    partitions' counts, and meet the numbers of their shards by blocks of ``RUN``, so that a hot key is never in one task.
    """
    kept = [c for c in docs.columns if c.lower() != "shard"]
    b, p, r, t = (fresh(docs.columns, c) for c in ("bytes", "part", "rank", "block"))
    rows = docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(b), F.spark_partition_id().alias(p))
    rows = rows.withColumn(r, F.expr(f"row_number() over (partition by `{key}`, {b}, {p} order by {b}) - 1"))
    counts = rows.groupBy(F.col(key).alias("_k"), F.col(b).alias("_b"), F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (partition by _k, _b order by _p rows between unbounded preceding and 1 preceding), 0)")
    counts = counts.select("_k", "_b", "_p", before.alias("_o"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col(b) == F.col("_b")) & (F.col(p) == F.col("_p"))
    rows = rows.join(counts, same).select(*kept, b, (F.col(r) + F.col("_o")).alias(r)).withColumn(t, F.expr(f"{r} div {RUN}"))
    past = F.expr("sum(n) over (partition by k, n_bytes order by shard)")
    spots = assigned.groupBy(F.col(key).alias("k"), "n_bytes", "shard").agg(F.count("*").alias("n"))
    spots = spots.select(F.col("k").alias("_k"), F.col("n_bytes").alias("_b"), "shard", past.alias("_hi"), (past - F.col("n")).alias("_lo"))
    spots = spots.withColumn("_t", F.explode(F.expr(f"sequence(_lo div {RUN}, (_hi - 1) div {RUN})")))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col(b) == F.col("_b")) & (F.col(t) == F.col("_t"))
    return rows.join(spots, same & (F.col(r) >= F.col("_lo")) & (F.col(r) < F.col("_hi"))).select(*kept, "shard")
