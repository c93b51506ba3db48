"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

The instance is a histogram: how many pieces there are of each length, at most ``CAPACITY`` rows whatever the corpus. On it
``reduce_instance`` fixes sets that dominate every alternative, ``best_fit`` packs the rest, and both say their work as patterns: so
many sequences, each with so many pieces of these lengths. Pieces are then ranked within their length (by buckets,
so that a frequent length is never in one task) and joined to the patterns by rank.

Dominance. Take the longest piece j and the longest piece k that still fits with it. {j} is fixed if nothing fits. {j, k} is fixed
if it fills the sequence, or if not even the two shortest pieces fit beside j together: then any other set with j holds
one more piece at most, and that is no longer than k. An optimal packing with the fixed set exists in each case.

Defined results: null and empty texts are one piece that holds the end id alone. Longer documents than the capacity are cut into
full pieces and a last one. Repeated rows and ids are packed row by row. No rows give no rows; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import in_parts, map_rows, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a worker remembers; beyond it the memory is emptied and refilled.
REMEMBERED = 1_000_000
ODD = re.compile("[\x1c-\x1f]")
#: A word and the punctuation behind it, which the tokenizer takes apart.
ENDED = re.compile("([a-zà-öø-ÿ]+)([.,:;!?]+)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _lower(text: str) -> str:
    """The text in lower case, as the tokenizer makes it, where that is the same letter by letter: in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=1)
def _encoder(path: str):
    """texts -> arrays of ids as the tokenizer gives them.

    The tokenizer treats white space as a gap and nothing crosses it, so a text's ids are those of its words in a row; ids of
    words are remembered. Texts with separators that only Python takes for blanks go to the tokenizer whole.
    """
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}

    def encode(texts: list[str]) -> list[np.ndarray]:
        split = [[] if ODD.search(t) else _lower(t).split() for t in texts]
        new = {w for w in set(chain.from_iterable(split)) if w not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(chain.from_iterable(split))
        ended = {w: m.groups() for w in new if (m := ENDED.fullmatch(w))}
        plain = [w for w in {*(w for w in new if w not in ended), *chain.from_iterable(ended.values())} if w not in known]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            found = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            coded = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            ends = np.fromiter(map(len, found), np.int64, len(found)).cumsum() * 4
            known.update((w, coded[a:b]) for w, a, b in zip(part, [0, *ends.tolist()], ends.tolist()))
        known.update((w, known[a] + known[b]) for w, (a, b) in ended.items())
        look = known.__getitem__
        return [
            np.frombuffer(b"".join(map(look, ws)), "<u4")
            if ws or not t
            else np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            for t, ws in zip(texts, split, strict=True)
        ]

    return encode


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), with the column ``ids`` if asked for."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for frame in in_parts(frames):
            rows = []
            for doc, ids in zip(frame["doc_id"], encode(frame["text"].fillna("").tolist()), strict=True):
                ids = np.append(ids, np.array([END_ID], "<u4"))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())) + ((part,) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(read, cut, PIECES + ", ids array<long>" * with_ids)


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Patterns (sequences, {length: pieces in each}) that dominance fixes, and the counts that remain."""
    left, fixed = dict(counts), []
    sizes = np.zeros(capacity + 1, bool)
    sizes[list(left)] = True

    def take(n: int, *lengths: int) -> None:
        fixed.append((n, {x: lengths.count(x) for x in lengths}))
        for x in lengths:
            left[x] -= n
            sizes[x] = left[x] > 0

    for j in sorted(counts, reverse=True):
        while left[j]:
            room = capacity - j
            fitting = np.flatnonzero(sizes[: room + 1])
            if j <= room and left[j] == 1:
                fitting = fitting[fitting != j]
            if not len(fitting):
                take(left[j] if j > room else 1, j)
                continue
            k = int(fitting[-1])
            shortest = int(fitting[0])
            two = 2 * shortest if left[shortest] - (shortest == j) >= 2 else shortest + (int(fitting[1]) if len(fitting) > 1 else capacity)
            if j + k != capacity and two <= room:
                break
            n = left[j] // 2 if j == k else min(left[j], left[k])
            take(n, j, k)
    return fixed, {x: n for x, n in left.items() if n}


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram: alike sequences are filled together, so the work follows the lengths, not the pieces."""
    open_by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(n: int, room: int, held: dict[int, int]) -> None:
        if n:
            open_by_room.setdefault(room, []).append((n, held))
            rooms[room] = True

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            tight = np.flatnonzero(rooms[x:])
            if len(tight):
                room = x + int(tight[0])
                many, held = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms[room] = False
            else:
                room, many, held = capacity, n, {}
            q = room // x
            whole = min(many, n // q)
            put(whole, room - q * x, held | {x: q})
            n -= whole * q
            if whole < many:
                part = min(n, q)
                if part:
                    put(1, room - part * x, held | {x: part})
                    n -= part
                if held:
                    put(many - whole - (part > 0), room, held)
    return [p for group in open_by_room.values() for p in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, pieces in each, offset): where the pieces of a length go by rank."""
    fixed, rest = reduce_instance(counts, capacity)
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for n, held in [*fixed, *best_fit(rest, capacity)]:
        at = 0
        for x, q in sorted(held.items(), reverse=True):
            rows.append((x, used[x], used[x] + n * q, sequence, q, at))
            used[x] += n * q
            at += q * x
        sequence += n
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32, and ids if there) with sequence_id and offset."""
    spark = cut.sparkSession
    held = written(cut)
    counts = {int(r[0]): int(r[1]) for r in held.groupBy("length").count().collect()}  # capacity rows at most
    schema = "length long, lo long, hi long, first long, q long, at long"
    slots = spark.createDataFrame(plan(counts, capacity), schema)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = held.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    own = F.expr("row_number() over (partition by length, b order by doc_id, piece, ids_crc32) - 1")
    before = F.expr("coalesce(sum(n) over (partition by length order by b rows between unbounded preceding and 1 preceding), 0)")
    starts = rows.groupBy("length", "b").agg(F.count("*").alias("n")).select("length", "b", before.alias("before"))
    ranked = rows.withColumn("r", own).join(starts, ["length", "b"]).withColumn("r", F.col("r") + F.col("before"))
    # at most a few patterns for each length: the plan's size follows the capacity, not the corpus
    at = (F.col("s.length") == F.col("p.length")) & (F.col("p.r") >= F.col("s.lo")) & (F.col("p.r") < F.col("s.hi"))
    return (
        ranked.alias("p")
        .join(F.broadcast(slots).alias("s"), at)
        .select(
            "doc_id", "piece", "start", "p.length", "ids_crc32", *(["ids"] if "ids" in cut.columns else []),
            (F.col("first") + F.floor((F.col("r") - F.col("lo")) / F.col("q"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(F.col("r") - F.col("lo"), F.col("q")) * F.col("p.length")).cast("long").alias("offset"),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, (sequence_id, ids), of pieces that were cut and packed with their ids.

    Every piece stands at its own offset, those of repeated ids and rows too, so a sequence has no gap and ``capacity`` ids at most.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
