"""SentencePiece encoding and decoding with a max-plus parallel scan over chunks of giant documents.

A text is a chain of edges, each a piece of the vocabulary over some characters (a character outside it is an edge of its byte
pieces). A path is worth 0 if every two neighbours are consistent (merging their characters by score gives back the two) and minus infinity
otherwise; the one path worth 0 is what byte-pair merging of the whole text yields. No piece holds a space mark behind another
character or a newline, so units (spaces and what follows them up to the next space or newline) don't depend on each other; units are
solved by the same recurrence and remembered.

Giant documents are cut every ``CHUNK`` characters, wherever that falls. The states of a cut are the edges that end on or cross
it; a chunk yields its max-plus transfer matrix from the states of its left cut to those of its right cut. Matrices of a
document are combined associatively from either side, which names the one state at each cut that lies on the best path, and every chunk is then
traced back on its own.

Defined results: null and empty texts have no pieces and decode to the empty text. A document of blanks, or one endless word, is encoded
whole. Identical rows are encoded once and returned as often as they came; a null id is kept. Empty tables give empty
tables; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import in_parts, map_rows, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CHUNK = 1 << 15
#: Units that a worker remembers; beyond it they become the older half, from which those still in use are taken over.
REMEMBERED = 150_000
#: Characters that a worker works on at once, one row at least.
BATCH = 1 << 20
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
BREAK = (-1, -1, -2)
PART = -3
NONE = -np.inf
Edge = tuple[int, int, int]


class Vocabulary:
    """Pieces, their merge order, and the consistency of neighbours."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.text = {i: t for t, i in self.id.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.of = np.empty(size, object)
        self.of[:] = b""
        for t, i in self.id.items():
            self.of[i] = t.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.of[i] = bytes([b])
        self.longest = max(map(len, self.id))
        #: Every ending of a piece, with the piece that it is or ``PART``.
        self.endings = {t[k:]: PART for t in self.id for k in range(1, len(t))} | self.id
        self._fit: dict[int, bool] = {}
        self._units: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._old_units: dict[str, bytes] = {}
        self._old_parts: dict[str, bytes] = {}
        self.beside = {t[k : k + 2] for t in self.id for k in range(len(t) - 1)}

    def consistent(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces, lowest rank and leftmost first, ends in these two."""
        if a < 0 or b < 0:
            return True
        known = self._fit.get(a * self.size + b)
        if known is None:
            left, right = self.text[a], self.text[b]
            parts, rank, never = [*left, *right], self.rank.get, 1e18
            values = [rank(x + y, never) for x, y in zip(parts, parts[1:])]
            while values:
                best = min(values)
                if best == never:
                    break
                at = values.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del values[at]
                if at:
                    values[at - 1] = rank(parts[at - 1] + parts[at], never)
                if at < len(values):
                    values[at] = rank(parts[at] + parts[at + 1], never)
            known = parts == [left, right]
            if len(self._fit) > 4 * REMEMBERED:
                self._fit.clear()
            self._fit[a * self.size + b] = known
        return known

    def edges_to(self, text: str, end: int, least: int) -> Iterator[tuple[int, int]]:
        """(start, piece) of the edges that end at ``end`` and start at ``least`` or later, longest first; -1 for bytes."""
        for start in range(max(least, end - self.longest), end):
            i = self.id.get(text[start:end])
            if i is not None:
                yield start, i
            elif start == end - 1:
                yield start, -1

    def paths(self, text: str, begin: int, last: int, stop: int) -> tuple[list[int], list[int | None]]:
        """Consistent paths from the edge ``last`` that ends at ``begin``: by end less ``begin``, start and piece of the last edge."""
        n, find, fits, size = stop - begin, self.endings.get, self._fit.get, self.size
        starts, pieces = [begin] * (n + 1), [None] * (n + 1)
        pieces[0] = last
        for end in range(1, n + 1):
            # shorter pieces first: one of them is taken only if merging proves it, and no piece ends in what isn't an ending
            start, stop = end - 1, begin + end
            i = find(text[stop - 1])
            if i is None or i == PART:
                i = -1
            while i is not None:
                b = pieces[start]
                if i != PART and b is not None:
                    fit = True if b < 0 or i < 0 else fits(b * size + i)
                    if fit is None:
                        fit = self.consistent(b, i)
                    if fit:
                        starts[end], pieces[end] = begin + start, i
                        break
                start -= 1
                if start < 0:
                    break
                i = find(text[begin + start : stop])
        return starts, pieces

    def forward(self, text: str, begin: int, last: int, stop: int) -> dict[int, tuple[int, int]]:
        """``paths`` as end -> (start, piece), for the ends that a path reaches."""
        starts, pieces = self.paths(text, begin, last, stop)
        return {begin + k: (s, i) for k, (s, i) in enumerate(zip(starts, pieces)) if i is not None}

    def spell(self, text: str, i: int, start: int, end: int) -> list[int]:
        return [i] if i >= 0 else [self.bytes[b] for b in text[start:end].encode()]

    def trace(self, text: str, back: dict[int, tuple[int, int]], begin: int, end: int) -> list[int]:
        out = []
        while end > begin:
            start, i = back[end]
            out.append(self.spell(text, i, start, end))
            end = start
        return [x for part in reversed(out) for x in part]

    def solve(self, text: str) -> bytes:
        """Pieces of a text that stands for itself."""
        starts, pieces = self.paths(text, 0, -2, len(text))
        end, out = len(text), []
        while end:
            start, i = starts[end], pieces[end]
            if i >= 0:
                out.append(i)
            else:
                out += self.spell(text, i, start, end)[::-1]
            end = start
        return array("i", out[::-1]).tobytes()

    def unit(self, text: str) -> bytes:
        """Pieces of one unit, in parts between characters that stand beside each other in no piece."""
        beside, parts, at, out = self.beside, self._parts, 0, []
        ends = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in beside]
        for end in (*ends, len(text)):
            part, at = text[at:end], end
            ids = parts.get(part)
            if ids is None:
                ids = parts[part] = self._old_parts.get(part) or self.solve(part)
            out.append(ids)
        return b"".join(out)

    def whole(self, text: str) -> np.ndarray:
        """Pieces of units in a row (``text`` with marks for spaces)."""
        units, known = UNIT.findall(text), self._units
        new = [u for u in set(units) if u not in known]
        if len(known) + len(new) > REMEMBERED:
            self._old_units, self._units = known, {}
            known, new = self._units, set(units)
        if len(self._parts) > REMEMBERED:
            self._old_parts, self._parts = self._parts, {}
        for u in new:
            known[u] = self._old_units.get(u) or self.unit(u)
        return np.frombuffer(b"".join(map(known.__getitem__, units)), "<i4")

    def decode(self, ids) -> bytes:
        return b"".join(self.of[np.asarray(ids, np.int64)].tolist())


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary with what it remembers, once for each worker."""
    return Vocabulary(path)


def marked(text: str) -> str:
    """The text as the model reads it: a mark in front and for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def is_break(text: str, at: int) -> bool:
    """Whether a unit ends at ``at``, so that no edge crosses."""
    return at <= 0 or at >= len(text) or text[at - 1] == "\n" or text[at] == "\n" or (text[at] == MARK and text[at - 1] != MARK)


def states(v: Vocabulary, text: str, at: int) -> list[Edge]:
    """Edges that end on the cut ``at`` or cross it, in order; a break has a single state."""
    if is_break(text, at):
        return [BREAK]
    out = []
    for end in range(at, min(len(text), at + v.longest - 1) + 1):
        out += [(start, end, i) for start, i in v.edges_to(text, end, 0) if start < at]
        if end > at and is_break(text, end):
            break
    return sorted(out)


def _next_break(text: str, at: int, stop: int) -> int | None:
    while at <= stop:
        if is_break(text, at):
            return at
        at += 1
    return None


def transfer(v: Vocabulary, text: str, a: int, b: int) -> np.ndarray:
    """The max-plus matrix of the chunk a..b of ``text``, which holds enough characters on either side."""
    left, right = states(v, text, a), states(v, text, b)
    out = np.full((len(left), len(right)), NONE)
    cut = _next_break(text, a, b)
    last = None
    if cut is not None:
        last = next(x for x in range(b, cut - 1, -1) if is_break(text, x))
        tail = v.forward(text, last, -2, min(len(text), b + v.longest))
        ends = [right == [BREAK] or tail.get(e) == (s, i) for s, e, i in right]
    for row, (start, end, i) in enumerate(left):
        begin, piece = (a, -2) if start < 0 else (end, i)
        if cut is not None:
            # units between the first and the last break are worth 0, so the matrix is head by tail
            if begin <= cut and cut in v.forward(text, begin, piece, cut):
                out[row] = np.where(ends, 0.0, NONE)
        else:
            back = v.forward(text, begin, piece, min(len(text), b + v.longest))
            out[row] = [0.0 if back.get(e) == (s, j) or (s, e, j) == (start, end, i) else NONE for s, e, j in right]
    return out


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None]).max(axis=1)


def scan(items: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by combining neighbours and scanning half as many."""
    if len(items) < 2:
        return items
    pairs = scan([product(items[k], items[k + 1]) for k in range(0, len(items) - 1, 2)])
    out = [items[0]]
    for k in range(1, len(items)):
        out.append(pairs[k // 2] if k % 2 else product(pairs[k // 2 - 1], items[k]))
    return out


def chosen(matrices: list[np.ndarray]) -> list[int]:
    """The state of every cut, the first and the last included, on the path worth 0."""
    ahead = scan(matrices)
    behind = [x.T for x in scan([m.T for m in reversed(matrices)])][::-1]
    middle = [int((ahead[k].max(axis=0) + behind[k + 1].max(axis=1)).argmax()) for k in range(len(matrices) - 1)]
    return [0, *middle, 0]


def backtrace(v: Vocabulary, text: str, a: int, b: int, left: int, right: int) -> list[int]:
    """Pieces of the chunk a..b: those after its left state up to and with its right state."""
    start, end, i = states(v, text, a)[left]
    begin, piece = (a, -2) if start < 0 else (end, i)
    goal = states(v, text, b)[right]
    stop = b if goal == BREAK else goal[1]
    if goal == (start, end, i) and goal != BREAK:
        return []
    cut = _next_break(text, begin, min(stop, b))
    if cut is None:
        return v.trace(text, v.forward(text, begin, piece, stop), begin, stop)
    last = next(x for x in range(b, cut - 1, -1) if is_break(text, x))
    head = v.trace(text, v.forward(text, begin, piece, cut), begin, cut)
    tail = v.trace(text, v.forward(text, last, -2, stop), last, stop)
    return head + v.whole(text[cut:last]).tolist() + tail


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, model: str = MODEL) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, part, parts, copies, ids) of the documents in one chunk, and of those in several by chunk; h is the text's hash."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.length("text")

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in in_parts(frames, most=BATCH):
            ids = [v.whole(marked(t)) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "h": frame["h"], "part": 0, "parts": 1, "copies": 1, "ids": ids})

    schema = "doc_id long, h long, part int, parts int, copies long, ids array<int>"
    small = rows.where(size <= chunk).withColumn("h", F.xxhash64("text"))
    small = map_rows(small, short, schema)
    giant = rows.where(size > chunk).groupBy("doc_id", F.xxhash64("text").alias("h"), "text").agg(F.count("*").alias("copies"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_parts(frames, most=BATCH):
            for doc, h, t, n in frame[["doc_id", "h", "text", "copies"]].itertuples(index=False):
                t = marked(t)
                parts = -(-len(t) // chunk)
                for k in range(parts):
                    a, b = k * chunk, min(len(t), (k + 1) * chunk)
                    lo = max(0, a - HALO)
                    yield pd.DataFrame([(doc, h, n, k, parts, a - lo, b - lo, b == len(t), t[lo : b + HALO])], columns=CUT)

    pieces = map_rows(giant.select("doc_id", "h", "text", "copies"), cut, "doc_id long, h long, copies long, part int, parts int, a int, b int, last boolean, text string")
    pieces = written(pieces.repartition("doc_id", "h", "part"))

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in in_parts(frames, most=BATCH):
            found = [transfer(v, r.text, r.a, r.b) for r in frame.itertuples()]
            yield frame[["doc_id", "h", "part"]].assign(rows=[len(m) for m in found], live=[np.flatnonzero(m.ravel() == 0).astype(np.int32) for m in found], cols=[m.shape[1] for m in found])

    found = map_rows(pieces, matrices, "doc_id long, h long, part int, rows int, live array<int>, cols int")

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        every = []
        for r in frame.itertuples():
            m = np.full(r.rows * r.cols, NONE)
            m[np.asarray(r.live, np.int64)] = 0
            every.append(m.reshape(r.rows, r.cols))
        at = chosen(every)
        return frame[["doc_id", "h", "part"]].assign(left=at[:-1], right=at[1:])

    # a document is one row, so its chunks are bounded by the longest string: some numbers for each 32 K characters
    named = found.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("doc_id", "h")
    at = named.applyInPandas(combine, "doc_id string, h long, part int, left int, right int")
    at = written(at.withColumn("doc_id", F.col("doc_id").cast("long")))
    same = F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.h") == F.col("s.h")) & (F.col("p.part") == F.col("s.part"))
    ready = pieces.alias("p").join(at.alias("s"), same).select("p.*", "s.left", "s.right")

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in in_parts(frames, most=BATCH):
            ids = [np.array(backtrace(v, r.text, r.a, r.b, r.left, r.right), np.int32) for r in frame.itertuples()]
            yield frame[["doc_id", "h", "part", "parts", "copies"]].assign(ids=ids)

    return small, map_rows(ready, back, schema)


#: Characters that a chunk sees beyond its cuts: two pieces and a break.
HALO = 64
CUT = ["doc_id", "h", "copies", "part", "parts", "a", "b", "last", "text"]


def digests(small: DataFrame, giant: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), n_chars and text_sha256 of the decoded text, by row of the input."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for frame in in_parts(frames, "ids", BATCH):
            texts = [v.decode(i) for i in frame["ids"]]
            yield frame[["doc_id", "h", "part", "parts", "copies"]].assign(n=[len(i) for i in frame["ids"]], ids=[np.asarray(i, "<u4").tobytes() for i in frame["ids"]], text=texts)

    schema = "doc_id long, h long, part int, parts int, copies long, n long, ids binary, text binary"

    def digest(n, ids, text):
        # the mark in front of a text is decoded as a space and dropped
        plain = F.substring(text, 2, 2147483647)
        return [n.alias("n_pieces"), F.crc32(ids).alias("ids_crc32"), F.length(F.decode(plain, "UTF-8")).cast("long").alias("n_chars"), F.sha2(plain, 256).alias("text_sha256")]

    one = map_rows(small, decode, schema).select("doc_id", *digest(F.col("n"), F.col("ids"), F.col("text")))
    many = map_rows(giant, decode, schema).groupBy("doc_id", "h", "copies").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "ids", "text"))).alias("x"))
    # joined as hex text, since binary values could only be joined two by two
    join = lambda f: F.unhex(F.array_join(F.transform(f"x.{f}", F.hex), ""))
    many = many.select("doc_id", "copies", "n", join("ids").alias("ids"), join("text").alias("text"))
    many = many.select("doc_id", "copies", *digest(F.col("n"), F.col("ids"), F.col("text")))
    many = many.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies", "copy")
    return one.union(many)
