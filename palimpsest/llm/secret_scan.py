"""Secret scans: a worklist unwraps nested encodings until nothing new appears, rescans each layer and maps spans back.

Layers. Percent escapes and ``\\u``/``\\x`` escapes are undone over the whole of a layer, so that a secret may be half escaped;
base64 runs (standard or URL alphabet, wrapped over lines or not) give a layer of their own from each of their first four
characters, so that it doesn't matter what stands before the encoded part. Layers hold one character a byte: all patterns are ASCII, and no byte
is refused. UTF-16 text of ASCII characters is read without its zero bytes. Gzip, zlib, bzip2 and xz data in them, of any number of members,
and raw deflate data at the start of a run, is inflated to further layers as far as it is whole. Percent signs that were escaped more than ``CHAIN``
times over lose all layers but the last of them at once, so that a chain of any length takes a fixed number of steps.
Layers seen before are not taken up again, which ends cycles. A span of a layer is mapped to the
smallest stretch of the text that encodes it: exact for escapes, to whole groups of four for base64, and the whole run for compressed data.

Kinds: ``assign``, ``access`` and ``hex`` as their patterns say, leftmost and non-overlapping for each kind, with short matches dropped.
Spans are code points, end exclusive. Spans of the text itself always stay; the layers only add.

Defined results: a null or empty text has no spans. Whole texts are scanned, of any length, and all that compressed runs inflate to: what
is larger than ``INFLATED`` is scanned in pieces, cut where no pattern or run can go on. Repeated rows are scanned one by one, empty tables give empty
tables, and other columns are carried or ignored, never read.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import in_parts, map_rows

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts of the words that an assignment starts with.
NAMES = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that line breaks part.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+")
GAP = re.compile(r"[ \t\r\n]+")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Layers of an escaped percent sign that are undone one by one.
CHAIN = 4
CHAINED = re.compile(rf"%(?:25){{{CHAIN + 1},}}")
WIDE = re.compile(r"(?:[\x01-\x7f]\x00){6,}|(?:\x00[\x01-\x7f]){6,}")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
ONE_ESCAPE = re.compile(r"\\[uxU]([0-9A-Fa-f]+)")
#: How gzip, zlib, bzip2 and xz data begins.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
INFLATED, BLOCK = 1 << 24, 1 << 20
#: No pattern and no run, wrapped or not, goes on over one of these.
ENDS = (b",", b";", b")", b"}", b">", b"!", b"?", b".\n", b"\n\n", b"\n\r\n")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, int]


class Layer:
    """A text with the place of each of its characters in the document: cut points and what each stretch stands for."""

    def __init__(self, text: str, parts: list[tuple[int, int, int, int, int]], raw: bool = False):
        # parts: (from, to, start, end, unit): layer characters from..to stand for start..end of the document;
        # with a unit each character stands for that many, else each for the whole stretch
        # raw: inflated bytes, which may be packed again
        self.text, self.parts, self.raw = text, parts, raw
        self.starts = [part[0] for part in parts]

    def place(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the document that characters a..b stand for."""
        found = [self._one(x) for x in (a, max(a, b - 1))]
        return found[0][0], found[1][1]

    def _one(self, x: int) -> tuple[int, int]:
        start, _, at, end, unit = self.parts[max(0, bisect_right(self.starts, x) - 1)]
        return (at + (x - start) * unit, at + (x - start + 1) * unit) if unit else (at, end)


def matches(text: str, runs: bool = True) -> list[Span]:
    """(start, kind, end) of the patterns in one text."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _inflated(data: bytes, at: int) -> Iterator[bytes]:
    """What the packed members from ``at`` on hold, in blocks, up to the first fault."""
    while found := PACKED.match(data, at):
        if found[0][:1] in (b"B", b"\xfd"):
            one = bz2.BZ2Decompressor() if found[0][:1] == b"B" else lzma.LZMADecompressor(lzma.FORMAT_XZ)
            take = lambda fed, one=one: one.decompress(fed, BLOCK)
            held = lambda one=one: b"" if one.needs_input or one.eof else None
        else:
            one = zlib.decompressobj(47)
            take = lambda fed, one=one: one.decompress(fed, BLOCK)
            held = lambda one=one: one.unconsumed_tail
        try:
            while at < len(data) and not one.eof:
                fed = data[at : at + BLOCK]
                at += len(fed)
                yield take(fed)
                while not one.eof and (rest := held()) != b"":
                    yield take(rest or b"")
            while not one.eof and (more := take(b"")):
                yield more
        except (zlib.error, lzma.LZMAError, OSError, EOFError):
            return
        if not one.eof:
            return
        at -= len(one.unused_data)


def _raw(data: bytes, check: bool = True) -> Iterator[bytes]:
    """What ``data`` holds, in blocks, if it is raw deflate data from its first byte to an end mark; read once before to see that."""
    one, fed = zlib.decompressobj(-15), data
    try:
        while (block := one.decompress(fed, BLOCK)) or one.unconsumed_tail:
            if not check:
                yield block
            fed = one.unconsumed_tail
    except zlib.error:
        return
    if check and one.eof:
        yield from _raw(data, False)


def _pieces(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks joined up to ``INFLATED`` and cut behind one of ``ENDS``; without one, or if packed again, they stay whole."""
    held = bytearray()
    for block in blocks:
        held += block
        if len(held) > INFLATED and not PACKED.match(held):
            fresh = max(0, len(held) - len(block) - 2)
            cut = max((at + len(end) for end in ENDS if (at := held.rfind(end, fresh)) >= 0), default=0)
            if cut:
                yield bytes(held[:cut])
                del held[:cut]
    if held:
        yield bytes(held)


def _worth(text: str) -> bool:
    """Whether a layer can hold a span or another layer."""
    low = text.lower()
    return any(name in low for name in NAMES) or "AKIA" in text or any(p.search(text) for p in (RUN, PERCENT, ESCAPE, WIDE))


def _rewritten(layer: Layer, pattern: re.Pattern, undo) -> Layer | None:
    """The layer with every match of ``pattern`` undone; None if there is none."""
    text, parts, at, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        new, exact = undo(m[0])
        if new is None:
            continue
        parts += _kept(layer, at, m.start(), size)
        size += m.start() - at
        text += [layer.text[at : m.start()], new]
        if exact:  # each new character stands for an equal share of the match
            step = len(m[0]) // len(new)
            for i in range(len(new)):
                parts.append((size + i, size + i + 1, *layer.place(m.start() + i * step, m.start() + (i + 1) * step), 0))
        else:
            parts.append((size, size + len(new), *layer.place(m.start(), m.end()), 0))
        size += len(new)
        at = m.end()
    if not at:
        return None
    parts += _kept(layer, at, len(layer.text), size)
    return Layer("".join([*text, layer.text[at:]]), parts)


def _kept(layer: Layer, a: int, b: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """The parts of the layer's characters a..b, moved to begin at ``size``."""
    out = []
    first = max(0, bisect_right(layer.starts, a) - 1)
    for start, end, at, to, unit in layer.parts[first : bisect_right(layer.starts, b)]:
        lo, hi = max(a, start), min(b, end)
        if lo < hi:
            moved = at + (lo - start) * unit if unit else at
            out.append((size + lo - a, size + hi - a, moved, to, unit))
    return out


def _from_percent(run: str) -> tuple[str | None, bool]:
    data = bytes.fromhex(run.replace("%", ""))
    text = data.decode("utf-8", "replace")
    return text, data.isascii()


def _from_escapes(run: str) -> tuple[str | None, bool]:
    codes = [int(x, 16) for x in ONE_ESCAPE.findall(run)]
    if max(codes) > 0x10FFFF:
        return None, False
    text = "".join(map(chr, codes)).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text, len(text) == len(codes) and len(run) % len(text) == 0 and len({len(x) for x in ONE_ESCAPE.findall(run)}) == 1


def _unwrapped(layer: Layer, runs: list[re.Match]) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        new = _rewritten(layer, CHAINED, lambda _: ("%" + "25" * CHAIN, False)) or _rewritten(layer, PERCENT, _from_percent)
        if new:
            yield new
    if "\0" in text and (new := _rewritten(layer, WIDE, lambda run: (run.replace("\0", ""), True))):
        yield new
    if "\\" in text and (new := _rewritten(layer, ESCAPE, _from_escapes)):
        yield new
    if layer.raw:
        yield from _unpacked(layer, text.encode("latin-1"), lambda at: layer.place(at, len(text)))
    for m in runs:
        yield from _decoded(layer, m.start(), m[0].rstrip("="), None)
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            spots = [i for i in range(m.start(), m.end()) if text[i] not in " \t\r\n"]
            yield from _decoded(layer, m.start(), GAP.sub("", m[0]), spots)


def _unpacked(layer: Layer, data: bytes, place) -> Iterator[Layer]:
    """Layers of the compressed data in ``data``, all of which stand for ``place`` of where it begins."""
    for m in PACKED.finditer(data):
        for piece in _pieces(_inflated(data, m.start())):
            yield Layer(piece.decode("latin-1"), [(0, len(piece), *place(m.start()), 0)], raw=True)


def _decoded(layer: Layer, start: int, run: str, spots: list[int] | None) -> Iterator[Layer]:
    """Layers of a base64 run read from each of its first four characters; ``spots`` are their places if blanks part them."""
    run = run.replace("-", "+").replace("_", "/")
    spot = (lambda i: spots[i]) if spots else (lambda i: start + i)
    for first in range(min(4, len(run) - 1)):
        size = len(run) - first
        size -= size % 4 == 1
        data = binascii.a2b_base64(run[first : first + size] + "=" * (-size % 4))
        whole = layer.place(spot(0), spot(len(run) - 1) + 1)
        yield from _unpacked(layer, data, lambda _, whole=whole: whole)
        for piece in _pieces(_raw(data)):
            yield Layer(piece.decode("latin-1"), [(0, len(piece), *whole, 0)], raw=True)
        held = data.decode("latin-1")
        if _worth(held):
            parts = []
            for i in range(0, len(held), 3):
                a = first + i // 3 * 4
                parts.append((i, min(i + 3, len(held)), *layer.place(spot(a), spot(min(a + 4, first + size) - 1) + 1), 0))
            yield Layer(held, parts)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself, and all spans with those of its layers, each (start, kind, end) in order."""
    text = text or ""
    runs = list(RUN.finditer(text))
    base = matches(text, any(m.end() - m.start() >= 24 for m in runs))
    if not runs and "%" not in text and "\\" not in text:
        return base, base
    every, seen = set(base), set()
    work = [_unwrapped(Layer(text, [(0, len(text), 0, len(text), 1)]), runs)]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        mark = (hashlib.blake2b(new.text.encode("utf-8", "replace"), digest_size=16).digest(), new.parts[0][2:4])
        if mark not in seen:
            seen.add(mark)
            every.update((s, k, e) for a, k, b in matches(new.text) for s, e in [new.place(a, b)])
            work.append(_unwrapped(new, list(RUN.finditer(new.text))))
    return base, sorted(every)


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans of every row."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_parts(frames):
            rows = []
            for doc, t in zip(frame["doc_id"], frame["text"], strict=True):
                base, every = scan(t if isinstance(t, str) else None)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc, *n, hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(read, each, RESULT)


def cover(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the name of the first kind in it."""
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in its text replaced by its kind in brackets; all other values as they came."""

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: cover(t, scan(t)[1]) if isinstance(t, str) else t)

    return docs.withColumn(text, clean(F.col(text)))
