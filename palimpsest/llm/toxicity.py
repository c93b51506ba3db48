"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word enters as the embedding of its entry in the vocabulary (its first component starts as the word's log-odds under the
labels, in standard errors) beside the mean embedding of its hashed byte trigrams, so that unknown words are read by
their characters. A word of over ``LONGEST`` bytes is cut at marks and blanks beyond ASCII, and what is still too long into overlapping
pieces, which enter as words of their own, so that every byte is read but single marks between words, which count as blanks. Two GRUs read a window of ``WIDTH`` words forth and back, attention pools their states, and a linear layer gives
the window's logit. Windows begin every ``STEP`` words, so all overlap; a text scores as its highest window.

Training is plain numpy on the driver, on ``SAMPLE`` labelled texts at most (a documented bound: those of the smallest id hashes); in each round
every text is represented by the window that scores highest so far, which makes hard negatives of clean texts. Log-odds
for a training text come from the other half of the sample. Scoring runs over all rows and whole texts in Arrow batches.

Defined results: a null or empty text is one window without words and gets the score of the network's bias, as
do texts of blanks. Very long texts are scored window by window in bounded blocks. Repeated rows get equal scores. Without a
labelled row all scores are 0.5 times the prior of none: 0. An empty table gives an empty table. No column but id and
text is read; labels, language, source and id never enter a score.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import fresh, written
from palimpsest.llm.words import BLANK, LOWER, batch_words, mix

#: Bounds of the training sample: texts, and characters in all of them.
SAMPLE, CHARACTERS = 4000, 1 << 26
WIDTH, STEP = 32, 16
WORDS, HIDDEN, WORD_DIM, CHAR_DIM, GRAMS, ATTEND = 16_384, 8, 6, 4, 4096, 8
ROUNDS, SEED = 6, 7
#: Step size, the embeddings' share of it, and weight decay.
RATE, SLOWER, DECAY = 0.01, 0.05, 0.02
#: Steps of 64 texts in each round, about.
STEPS = 100
#: Bytes of the longest word that is read as one; pieces of longer ones have ``PIECE`` characters and begin every ``PIECE / 2``.
LONGEST, PIECE = 64, 16
LONG = re.compile(r"[^\x20\x09-\x0D]{17,}")
PARTS = re.compile(r"[^\W_]+|[\W_]{2,}")
#: Windows that are run at once, so that their states stay in a core's cache and no product is worth threads of its own.
BLOCK = 1024
#: Characters of the texts that a worker scores at once, one text at least.
BATCH = 1 << 20


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _cut(word: re.Match) -> str:
    """A word with blanks where it is cut because it is too long."""
    size = lambda t: len(t.encode("utf-8", "surrogatepass"))
    if size(word[0]) <= LONGEST:
        return word[0]
    out = []
    for part in PARTS.findall(word[0]):
        out += [part] if size(part) <= LONGEST else [part[i : i + PIECE] for i in range(0, max(1, len(part) - PIECE // 2), PIECE // 2)]
    return " ".join(out)


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts end to end: distinct word hashes, each word's place among them, text ends, and hashed byte trigrams with word ends."""
    texts = [LONG.sub(_cut, t) for t in texts]
    hashes, ends = batch_words(texts)
    known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    data = LOWER[np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)]
    edges = np.flatnonzero(np.diff((~BLANK[data]).view(np.int8), prepend=0, append=0))
    starts, stops = edges[::2][first], edges[1::2][first]
    sizes = stops - starts
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stop = np.repeat(stops, sizes)
    # trigrams of the word between two blanks; positions beyond the word read as a blank
    code = data[at].astype(np.uint64)
    for k in (1, 2):
        code = code * np.uint64(257) + np.where(at + k < stop, data[np.minimum(at + k, len(data) - 1)], 32)
    return known, place, ends, (mix(code) & np.uint64(GRAMS - 1)).astype(np.int32), np.cumsum(sizes)


def windows(place: np.ndarray, a: int, b: int) -> np.ndarray:
    """All windows of the words a..b as rows of places, -1 where a window has no word."""
    n = b - a
    count = max(1, -(-(n - WIDTH) // STEP) + 1)
    at = np.arange(count)[:, None] * STEP + np.arange(WIDTH)
    return np.where(at < n, place[np.minimum(a + at, max(b - 1, 0))] if n else -1, -1)


class Network:
    """The parameters, the forward pass over windows, and its gradient."""

    def __init__(self, vocabulary: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary  # sorted word hashes; the last row of "word" is the unknown word
        size = WORD_DIM + CHAR_DIM
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.05), "char": draw(GRAMS, CHAR_DIM, scale=0.1)}
        for d in "fb":
            self.p |= {d + "W": draw(size, 3 * HIDDEN, scale=size**-0.5), d + "U": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), d + "c": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, ATTEND, scale=0.3), "a": draw(ATTEND, scale=0.3), "o": draw(2 * HIDDEN, scale=0.3), "k": np.zeros(1, np.float32)}

    def rows(self, known: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(known), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, known), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == known, at, len(self.vocabulary))

    def inputs(self, rows: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        if not len(rows):
            return np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        begins = np.concatenate(([0], ends[:-1]))
        chars = np.add.reduceat(self.p["char"][grams], begins, axis=0) / (ends - begins)[:, None]
        return np.concatenate((self.p["word"][rows], chars), axis=1).astype(np.float32)

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct words as both directions' gates see them; the last row stands for "no word" and is reached by place -1."""
        return {d: np.concatenate((inputs @ self.p[d + "W"] + self.p[d + "c"], np.zeros((1, 3 * HIDDEN), np.float32))) for d in "fb"}

    def _run(self, d: str, projected: np.ndarray, at: np.ndarray, keep: bool):
        U, h = self.p[d + "U"], np.zeros((len(at), HIDDEN), np.float32)
        states, tape = np.empty((WIDTH, len(at), HIDDEN), np.float32), []
        for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
            x, u = projected[at[:, t]], h @ U
            zr = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            live = (at[:, t] >= 0)[:, None]
            new = np.where(live, new, h)
            if keep:
                tape.append((t, h, z, r, n, u[:, 2 * HIDDEN :], live))
            states[t] = h = new
        return states, tape

    def logits(self, inputs: np.ndarray, at: np.ndarray, keep: bool = False):
        return self.forward(self.project(inputs), at, keep)

    def forward(self, projected: dict[str, np.ndarray], at: np.ndarray, keep: bool = False):
        states, tapes = [], []
        for d in "fb":
            s, tape = self._run(d, projected[d], at, keep)
            states.append(s)
            tapes.append(tape)
        h = np.concatenate(states, axis=2)
        q = np.tanh(h @ self.p["A"])
        e = np.where((at >= 0).T, q @ self.p["a"], -1e9).astype(np.float32)
        w = np.exp(e - e.max(axis=0)) * (at >= 0).T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        c = np.einsum("tb,tbh->bh", w, h)
        out = c @ self.p["o"] + self.p["k"][0]
        return (out, (h, q, w, c, tapes)) if keep else out

    def gradient(self, inputs, at, rows, grams, ends, label):
        """Gradients by parameter; of "word" only for the rows in use, as (rows, gradient)."""
        p, g = self.p, {}
        used, local = np.unique(at, return_inverse=True)
        local = local.reshape(at.shape) - int(used[0] < 0)
        used = used[used >= 0]
        inputs, at = inputs[used] if len(used) else inputs[:1], local
        out, (h, q, w, c, tapes) = self.logits(inputs, at, keep=True)
        d_out = (_sigmoid(out) - label).astype(np.float32) / len(label)
        g["k"], g["o"] = np.array([d_out.sum()], np.float32), c.T @ d_out
        dc = d_out[:, None] * p["o"]
        dh = w[:, :, None] * dc
        dw = np.einsum("tbh,bh->tb", h, dc)
        de = w * (dw - (w * dw).sum(axis=0))
        dq = de[:, :, None] * p["a"] * (1 - q * q)
        g["a"] = np.einsum("tb,tba->a", de, q)
        g["A"] = np.einsum("tbh,tba->ha", h, dq)
        dh = dh + dq @ p["A"].T
        d_in = np.zeros((len(inputs) + 1, inputs.shape[1]), np.float32)
        for i, d in enumerate("fb"):
            U, back = p[d + "U"], np.zeros((len(at), HIDDEN), np.float32)
            dU, dW, dcst = np.zeros_like(U), np.zeros_like(p[d + "W"]), np.zeros(3 * HIDDEN, np.float32)
            for t, before, z, r, n, un, live in reversed(tapes[i]):
                total = dh[t, :, i * HIDDEN : (i + 1) * HIDDEN] + back
                on = total * live
                dn = on * (1 - z) * (1 - n * n)
                dz = on * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dx = np.concatenate((dz, dr, dn), axis=1)
                du = np.concatenate((dz, dr, dn * r), axis=1)
                dU += before.T @ du
                back = total * ~live + on * z + du @ U.T
                x = inputs[np.maximum(at[:, t], 0)] * live
                dW += x.T @ dx
                dcst += dx.sum(axis=0)
                np.add.at(d_in, at[:, t], dx @ p[d + "W"].T)
            g |= {d + "U": dU, d + "W": dW, d + "c": dcst}
        d_in = d_in[: len(used)]
        held, at_row = np.unique(rows[used], return_inverse=True)
        d_word = np.zeros((len(held), WORD_DIM), np.float32)
        np.add.at(d_word, at_row, d_in[:, :WORD_DIM])
        g["word"] = (held, d_word)
        begins = np.concatenate(([0], ends[:-1]))
        sizes = (ends - begins)[used]
        spread = np.repeat(d_in[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None], sizes, axis=0)
        where = np.repeat(begins[used], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], grams[where], spread)
        return g

    def score(self, texts: list[str], block: int = BLOCK) -> np.ndarray:
        """The highest logit of each text's windows."""
        known, place, ends, grams, gram_ends = word_grams(texts)
        projected = self.project(self.inputs(self.rows(known), grams, gram_ends))
        out, held, owner = np.full(len(texts), -np.inf, np.float32), [], []

        def flush() -> None:
            at, of = np.concatenate(held), np.concatenate(owner)
            for k in range(0, len(at), block):
                np.maximum.at(out, of[k : k + block], self.forward(projected, at[k : k + block]))
            held.clear()
            owner.clear()

        waiting = 0
        for i in range(len(texts)):
            at = windows(place, ends[i], ends[i + 1])
            held.append(at)
            owner.append(np.full(len(at), i))
            waiting += len(at)
            if waiting >= 8 * block:
                flush()
                waiting = 0
        if held:
            flush()
        return out


def _log_odds(member: list[np.ndarray], label: np.ndarray, rows: int) -> np.ndarray:
    """Per vocabulary row the log-odds of the label in standard errors, from the documents that hold the word."""
    seen = np.zeros((2, rows), np.float32)
    for m, y in zip(member, label, strict=True):
        seen[int(y), m] += 1
    n = np.array([(label == 0).sum(), (label == 1).sum()], np.float32)
    lo = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    z = lo / np.sqrt(1 / (seen[1] + 1) + 1 / (seen[0] + 1))
    return np.where(seen.sum(axis=0) >= 4, np.clip(z, -8, 8) / 3, 0).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Network | None:
    """A network fitted to labelled texts; None without any. Copies of a text count once."""
    once = list(dict(zip(texts, labels, strict=True)).items())
    if not once:
        return None
    texts, label = [t for t, _ in once], np.array([y for _, y in once], np.float32)
    known, place, ends, grams, gram_ends = word_grams(texts)
    member = [np.unique(place[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    often = np.bincount(np.concatenate(member), minlength=len(known))
    common = np.argsort(-often, kind="stable")[:WORDS]
    net = Network(known[np.sort(common[often[common] >= 3])], seed)
    rows = net.rows(known)
    member = [np.unique(rows[m]) for m in member]
    fold = np.arange(len(texts)) % 2
    odds = [_log_odds([m for m, f in zip(member, fold, strict=True) if f != k], label[fold != k], len(net.p["word"])) for k in (0, 1)]
    every = _log_odds(member, label, len(net.p["word"]))
    for o in (*odds, every):
        o[-1] = 0
    net.p["k"][0] = np.log((label.mean() + 0.01) / (1.01 - label.mean()))
    all_windows = [windows(place, a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in all_windows])
    all_windows = np.concatenate(all_windows)
    base, rng = net.p["word"][:, 0].copy(), np.random.default_rng(seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for round_ in range(rounds):
        chosen = np.zeros(len(texts), np.int64)
        for k in (0, 1):
            net.p["word"][:, 0] = base + odds[k]
            inputs = net.inputs(rows, grams, gram_ends)
            mine = np.flatnonzero(fold[owner] == k)
            if not len(mine):
                continue
            if round_:
                projected = net.project(inputs)
                value = np.concatenate([net.forward(projected, all_windows[mine[i : i + BLOCK]]) for i in range(0, len(mine), BLOCK)])
            else:  # before anything is learned, the window with the highest log-odds stands for its text
                value = np.where(all_windows[mine] >= 0, net.p["word"][rows[all_windows[mine]], 0], -9).max(axis=1)
            order = mine[np.argsort(value, kind="stable")]
            chosen[owner[order]] = order
        passes = max(1, min(STEPS // 2, round(STEPS * 64 / len(texts))))  # a pass takes a step of each half at least
        for k in (0, 1) * passes:
            mine = rng.permutation(np.flatnonzero(fold == k))
            for i in range(0, len(mine), 64):
                part = mine[i : i + 64]
                net.p["word"][:, 0] = base + odds[k]
                inputs = net.inputs(rows, grams, gram_ends) if i == 0 else inputs
                at = all_windows[chosen[part]]
                g = net.gradient(inputs, at, rows, grams, gram_ends, label[part])
                step += 1
                for name, value in g.items():
                    at, value = value if name == "word" else (slice(None), value)
                    m, v = moment[name]
                    m[at] += 0.1 * (value - m[at])
                    v[at] += 0.01 * (value * value - v[at])
                    change = RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)
                    if name == "word":  # the component that holds the log-odds stays
                        change[:, 0] = 0
                    net.p[name][at] -= change * (SLOWER if name in ("word", "char") else 1) + DECAY * RATE * net.p[name][at]
    net.p["word"][:, 0] = base + every
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Network | None:
    """A network from at most ``sample`` labelled texts that aren't held out, of at most ``characters`` in all (but one text at least).

    Of rows with one id the last text in order is taken, with its highest label.
    """
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("x")).select("doc_id", "x.*", F.xxhash64("doc_id").alias("h"))
    rows = written(rows)  # ``sample`` rows at most
    sizes = rows.select("h", "doc_id", F.length("text").alias("n")).orderBy("h", "doc_id").collect()
    fits = int(np.searchsorted(np.cumsum([r.n for r in sizes]), characters, "right"))
    if 0 < fits < len(sizes):
        last = sizes[fits - 1]
        rows = rows.where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("doc_id") <= last.doc_id)))
    elif not fits:
        rows = rows.orderBy("h", "doc_id").limit(1)
    rows = sorted((r.doc_id, r.text, r.toxic) for r in rows.collect())
    return train([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32))


def scored(text: Column, net: Network | None) -> Column:
    """The score of each whole text; 0 without a network."""

    @F.pandas_udf("double")
    def each(column: pd.Series) -> pd.Series:
        if net is None or not len(column):
            return pd.Series(np.zeros(len(column)))
        texts = [t if isinstance(t, str) else "" for t in column]
        ends = np.cumsum([len(t) for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH)) + 1).tolist(), len(texts)]  # parts of bounded characters
        return pd.Series(_sigmoid(np.concatenate([net.score(texts[a:b]) for a, b in itertools.pairwise(cuts)]).astype(np.float64)))

    return each(text)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = docs.select("doc_id", scored(F.col("text"), fit(docs, labels)).alias("score"))
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, columns as they came."""
    own = fresh(docs.columns, "score")
    return docs.withColumn(own, scored(F.col("text"), fit(docs, labels))).where(F.col(own) < limit).select(docs.columns)
