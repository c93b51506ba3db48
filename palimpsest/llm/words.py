"""Word and shingle hashing over whole texts, vectorised over the bytes of a batch.

A word is a maximal run of bytes other than blank, tab, newline, vertical tab, form feed and carriage return.
A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, so that a batch needs no loop
over words; texts are worked through in pieces of at most ``PIECE`` bytes cut between words.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _pieces(data: bytes):
    """Byte ranges that cover ``data`` and never cut a word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            window = np.frombuffer(data, np.uint8, end - at, at)
            blanks = np.flatnonzero(BLANK[window[-65536:]])
            if len(blanks):
                end = end - min(65536, end - at) + int(blanks[-1]) + 1
            else:
                while end < n and not BLANK[data[end]]:
                    end += 1
        yield at, end
        at = end


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` in order, and the offsets where they start."""
    hashes, starts = [], []
    for at, end in _pieces(data):
        a = np.frombuffer(data, np.uint8, end - at, at)
        if lower:
            a = LOWER[a]
        edges = np.flatnonzero(np.diff((~BLANK[a]).view(np.int8), prepend=0, append=0))
        if not len(edges):
            continue
        up, down = _power(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        first, past = edges[::2], edges[1::2]
        hashes.append(mix((sums[past] - sums[first]) * down[first]))
        starts.append(first + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def batch_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all ``texts`` end to end, and the offset of each text's first word with the total last."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts = word_hashes(b"\n".join(coded), lower)
    lengths = np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded))
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashed shingles of ``width`` words; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k]
    return np.unique(mix(out))
