"""Operators against SQL, brute force, round trips and held-out labels, and their edge cases."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import bayes_quality, catalog, chat, embed_graph, minhash, packing, piece_scan, quality_rules, secret_scan, sharding, shared, toxicity
from tests.compare import against_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, id string, component_id string"


def docs(spark, *texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y", "z", "c") for i, t in zip(ids, texts, strict=True)], DOCS)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ODD = [None, "", " \n\t", "a", "a b", LONG, LONG, "é 日本 ␛ </s>", "x" * 70_000]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, sf_dir, name):
    against_sql(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


def test_odd_rows_everywhere(spark):
    d = docs(spark, *ODD, ids=[0, 1, 2, 3, 4, 5, 6, None, 8])
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert sharding.assign(d, 1000).count() == len(ODD)
    assert quality_rules.quality_measures(d).count() == len(ODD)
    assert quality_rules.judge(d).columns == d.columns
    assert secret_scan.find(d).count() == len(ODD)
    assert secret_scan.redact(d).columns == d.columns
    assert minhash.near_duplicates(d, 3, 85).count() == len(ODD)
    assert minhash.keep_one(d).count() == len(ODD) - 1
    assert packing.pack(packing.pieces(d)).select("doc_id").distinct().count() == len(ODD)
    assert toxicity.verdicts(d, labels).count() == len(ODD)
    assert bayes_quality.posterior(d, labels, F.col("source"), F.col("lang")).count() == len(ODD)
    assert piece_scan.digests(*piece_scan.encode(d)).count() == len(ODD)


def test_empty_tables(spark, sf_dir):
    d = docs(spark, "x").limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    import corpus_pipeline

    step = d
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir)
    for out in (
        step, secret_scan.redact(d), toxicity.clean(d, labels), sharding.attach(d, sharding.assign(d, 10)), packing.sequences(packing.pack(packing.pieces(d, with_ids=True))),
        sharding.assign(d, 10), quality_rules.quality_measures(d), quality_rules.judge(d), secret_scan.find(d), minhash.near_duplicates(d), minhash.keep_one(d),
        packing.pack(packing.pieces(d)), toxicity.verdicts(d, labels), bayes_quality.posterior(d, labels, F.col("source"), F.col("lang")), piece_scan.digests(*piece_scan.encode(d)),
        embed_graph.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        chat.digests(chat.read_back(chat.expand(spark.createDataFrame([], "conv_id long, turn int, role string, text string")))),
    ):
        assert out.count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2400)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = dict(shared.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: top(x) for x in root if any(a != b and x in (a, b) for a, b in pairs)}


def test_sharding_splits_hot_keys(spark):
    d = docs(spark, *(["x" * 100] * 60 + ["y" * 10] * 40), ids=[7] * 60 + list(range(100, 140)))
    out = sharding.assign(d, 1000)
    sums = out.groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("c"), F.first("shard_bytes").alias("s")).collect()
    assert all(r.n <= 1000 or r.c == 1 for r in sums) and all(r.n == r.s for r in sums)
    shards = [r.shard for r in sums]
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert sharding.attach(d, out).count() == 100
    assert sharding.attach(d, out).groupBy("shard").count().count() == len(shards)


@pytest.mark.parametrize("key, text", [("7", "'abc'"), ("cast(null as long)", "repeat('x', cast(id % 300 as int))"), ("if(id % 3 = 0, 7, id)", "if(id = 3, repeat('y', 50000), repeat('x', cast(id * 7919 % 30 as int)))")])
def test_sharding_hot_groups(spark, key, text):
    d = spark.range(0, 100_000, 1, 4).selectExpr(f"{key} as doc_id", f"{text} as text", "id as bytes", "id as `part`", "'old' as SHARD")
    out = sharding.assign(d, 2000)
    sums = out.groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("c"), F.first("shard_bytes").alias("b"), F.first("shard_docs").alias("d")).collect()
    assert sum(r.c for r in sums) == 100_000 and all((r.n <= 2000 or r.c == 1) and (r.n, r.c) == (r.b, r.d) for r in sums)
    names = sorted(r.shard for r in sums)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))
    held = {n: r.n for n, r in zip(names, sorted(sums), strict=True)}
    # a bucket fits only where its parent doesn't: no two halves fit together
    assert not any(a[:-1] == b[:-1] and held[a] + held[b] <= 2000 for a, b in itertools.pairwise(names))
    placed = sharding.attach(d, out)
    assert placed.columns == ["doc_id", "text", "bytes", "part", "shard"]
    again = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert again == {r.shard: r.n for r in sums} and placed.count() == 100_000


def test_shared_folder_on_a_cluster():
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "local-cluster[2,1,1024]"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///x/"
    assert shared.shared_folder(Session) == "hdfs:///x"


def test_settings_stay(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for op in ("op3_piece_scan", "op7_secret_scan", "op8_best_fit_packing"):
        catalog.QUERIES[op](spark, sf_dir)
    assert spark.conf.get(name) == before


def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_minhash_against_brute_force(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghijkl") + str(rng.randrange(40)) for _ in range(rng.choice([2, 30, 120]))] for _ in range(12)]
    texts = []
    for _ in range(260):  # near copies at all distances, so that many lie beside the threshold
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice("xyz") + str(rng.randrange(900))
        texts.append(" ".join(t))
    rows = list(enumerate(texts + ["", None, "One TWO", "one two"]))
    for width, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
        assert {r[0]: (r[1], r[2], r[3]) for r in got} == brute_near(rows, width, percent)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    seeds = rng.standard_normal((40, 16))
    x = np.concatenate([seeds[rng.integers(0, 40, 300)] + rng.standard_normal((300, 16)) * 0.12, rng.standard_normal((100, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(5)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0]), (2005, [None] * 16), (None, x[0].tolist())]
    got = {r[0]: r[1:] for r in embed_graph.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    truth = {i: int(n) for (i, _), n in zip(rows, near.sum(axis=1), strict=True)}
    assert sum(min(truth[i], got[i][0]) for i in truth) >= 0.98 * sum(truth.values())
    assert all(got[i][0] <= truth[i] for i in truth)
    assert all(got[i] == (0, i, True) for i, _ in odd[:6])


def _links(spark, x):
    """n_links and component found, and those of brute force."""
    got = {r[0]: (r[1], r[2]) for r in embed_graph.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    m = x / np.linalg.norm(x, axis=1)[:, None]
    near = m @ m.T >= 0.95
    root = np.arange(len(x))
    while (new := np.where(near, root, len(x)).min(axis=1)).tolist() != root.tolist():
        root = new
    return got, {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(x))}


def test_embeddings_between_tight_groups(spark):
    rng = np.random.default_rng(1)
    e = np.eye(32)
    tight = lambda at, n, spread: at + rng.standard_normal((n, 32)) * spread / 32**0.5
    x = np.concatenate([tight(e[0], 200, 0.03), tight(0.96 * e[0] + 0.28 * e[1], 200, 0.03), tight(e[2], 600, 0.4)])
    got, want = _links(spark, x)
    assert min(want[i][0] for i in range(400)) >= 390 and got == want


def test_embeddings_whole_after_failed_audits(spark, monkeypatch):
    monkeypatch.setattr(embed_graph, "audit", lambda *_: 0.0)
    monkeypatch.setattr(embed_graph, "SHARD", 20)
    monkeypatch.setattr(embed_graph, "MOST", 80)
    monkeypatch.setattr(embed_graph, "OVERLAP", 1)
    monkeypatch.setattr(embed_graph, "TRIES", 1)
    rng = np.random.default_rng(5)
    seeds = rng.standard_normal((12, 16))
    got, want = _links(spark, seeds[rng.integers(0, 12, 240)] + rng.standard_normal((240, 16)) * 0.2)
    assert got == want and sum(n for n, _ in want.values()) > 100


def test_embeddings_of_any_scale(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [1.0, -1.0]), (5, [1e308, -1e308]), (6, [5e-324, 5e-324])]
    got = {r[0]: r[1:] for r in embed_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 6: (3, 1, False), 4: (1, 4, True), 5: (1, 4, False)}


def test_embeddings_two_levels_of_centres(spark, monkeypatch):
    monkeypatch.setattr(embed_graph, "SHARD", 30)
    monkeypatch.setattr(embed_graph, "MOST", 120)
    monkeypatch.setattr(embed_graph, "CENTRES", 6)
    rng = np.random.default_rng(8)
    seeds = rng.standard_normal((60, 16))
    got, want = _links(spark, seeds[rng.integers(0, 60, 500)] + rng.standard_normal((500, 16)) * 0.1)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in want.values()) > 500


def test_graph_search_makes_few_cosines():
    rng = np.random.default_rng(4)
    seeds = rng.standard_normal((100, 32))
    x = embed_graph._unit(seeds[rng.integers(0, 100, 1500)] + rng.standard_normal((1500, 32)) * 0.1)
    near = x @ x.T
    graph = embed_graph.Graph(x, *embed_graph.robust_prune(near.astype(np.float32)))
    truth = near >= 0.95
    np.fill_diagonal(truth, False)
    found = graph.search(np.arange(1500), 0.95)
    assert not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum() > 1000


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("nrstl") for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(700):
        t, bad = [word() for _ in range(rng.randrange(5, 120))], i % 6 == 0
        for _ in range(3 if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(["grukk", "vobbat", "zhirn"])
        rows.append((i, " ".join(t), int(bad)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.verdicts(d, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.95


def test_toxicity_reads_words_without_blanks():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("nrstl") for _ in range(rng.randrange(1, 4)))
    texts = [" ".join([word() for _ in range(40)] + ["grukk"] * (i % 4 == 0)) for i in range(400)]
    net = toxicity.train(texts, np.array([i % 4 == 0 for i in range(400)], np.float32))
    clean = [word() for _ in range(40)]
    for gap in ("\u00a0", "\u3000", "_", "-", "/"):
        plain, toxic = net.score([gap.join(clean), gap.join([*clean, "grukk"])])
        assert plain < 0 < toxic, gap
    cjk = "日本語" * 30
    plain, toxic, token = (set(toxicity.word_grams([t])[0].tolist()) for t in (cjk, cjk + "毒", "x" * 100 + "grukk"))
    assert toxic - plain and token - set(toxicity.word_grams(["x" * 105])[0].tolist())
    *_, grams, ends = toxicity.word_grams(["x" * 100 + "grukk"])
    assert set(toxicity.word_grams(["x" * 11 + "grukk"])[3].tolist()) <= set(grams.tolist())


def plain_logit(net, text):
    """The forward pass word by word and window by window, in plain loops."""
    p, hidden = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    known, place, _, grams, gram_ends = toxicity.word_grams([text])
    begins, vector = [0, *gram_ends[:-1]], []
    for w in place:
        row = np.flatnonzero(net.vocabulary == known[w])
        word = p["word"][row[0] if len(row) else len(net.vocabulary)]
        vector.append(np.concatenate((word, np.mean([p["char"][g] for g in grams[begins[w] : gram_ends[w]]], axis=0))))
    scores = []
    for at in range(0, max(1, len(vector) - toxicity.WIDTH + toxicity.STEP), toxicity.STEP):
        part = vector[at : at + toxicity.WIDTH]
        states = [np.zeros(2 * hidden) for _ in part]
        for d, side in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            h = np.zeros(hidden)
            for t in side:
                x, u = part[t] @ p[d + "W"] + p[d + "c"], h @ p[d + "U"]
                z, r = sig(x[:hidden] + u[:hidden]), sig(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
                h = (1 - z) * np.tanh(x[2 * hidden :] + r * u[2 * hidden :]) + z * h
                states[t][slice(0, hidden) if d == "f" else slice(hidden, None)] = h
        e = [np.tanh(s @ p["A"]) @ p["a"] for s in states]
        w = np.exp(np.array(e) - max(e, default=0))
        pooled = sum((a * s for a, s in zip(w / w.sum(), states, strict=True)), np.zeros(2 * hidden)) if states else np.zeros(2 * hidden)
        scores.append(pooled @ p["o"] + p["k"][0])
    return max(scores)


def test_toxicity_forward_against_plain_loops():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "cde", "fg", "bad", "worse"]) + rng.choice(["", "x"]) for _ in range(rng.choice([1, 5, 31, 32, 33, 49, 80]))) for _ in range(40)]
    net = toxicity.train(texts, np.array(["worse" in t for t in texts], np.float32), rounds=2)
    some = [*texts[:12], "", "unknown words only", "a" * 100]
    assert np.allclose(net.score(some), [plain_logit(net, t) for t in some], atol=1e-4)


def test_toxicity_learns_without_log_odds(monkeypatch):
    """The network by itself: what the words' log-odds leave out is their neighbourhood, which alone tells these texts apart."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        t = [rng.choice("abcdefgh") * 3 for _ in range(20)]
        t[7:9] = ["you", "fool"] if i % 2 else ["fool", "gold"]
        t[14:16] = ["gold", "ring"] if i % 2 else ["you", "ring"]
        rows.append((" ".join(t), i % 2))
    monkeypatch.setattr(toxicity, "_log_odds", lambda m, y, n: np.zeros(n, np.float32))
    net = toxicity.train([t for t, _ in rows[:500]], np.array([y for _, y in rows[:500]], np.float32), rounds=10)
    assert np.mean([(s > 0) == y for s, (_, y) in zip(net.score([t for t, _ in rows[500:]]), rows[500:], strict=True)]) >= 0.9


def test_toxicity_keeps_columns(spark):
    d = spark.createDataFrame([(i, "bad text" if i % 3 == 0 else "some text", 7.0, 8.0) for i in range(40)], "doc_id long, text string, score double, _score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.clean(d, labels)
    assert out.columns == d.columns and {(r.score, r["_score"]) for r in out.collect()} == {(7.0, 8.0)}
    assert toxicity.clean(d.limit(0), labels).count() == 0
    # the bound on characters leaves one text at least
    assert toxicity.fit(d, labels, characters=1) is not None


def test_toxicity_gradient():
    net = toxicity.train(["a b c d", "e f g bad", "bad a", "x"], np.array([0, 1, 1, 0], np.float32), rounds=1)
    known, place, ends, grams, gram_ends = toxicity.word_grams(["a b bad q", "c"])
    rows = net.rows(known)
    at = np.concatenate([toxicity.windows(place, a, b) for a, b in itertools.pairwise(ends)])
    label = np.array([1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        s = toxicity._sigmoid(net.logits(net.inputs(rows, grams, gram_ends), at).astype(np.float64))
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).mean()

    g = net.gradient(net.inputs(rows, grams, gram_ends), at, rows, grams, gram_ends, label)
    for name in ("fW", "bU", "A", "o", "char"):
        where = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = net.p[name][where], 1e-2
        net.p[name][where] = old + step
        up = loss()
        net.p[name][where] = old - step
        down = loss()
        net.p[name][where] = old
        assert abs((up - down) / (2 * step) - g[name][where]) < 0.15 * abs(g[name][where]) + 1e-3


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "␛", "[␛INST]", "<␛␛/s>", "", None, "<<SYS>>a<</SYS>>", "[ROLE 41]x[/ROLE]", "<s>é"]
    roles = ["user", "assistant", "system", "tool]\n", None, "assistant", "user", "assistant", "user"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, texts, strict=True))] + [(2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    assert got[1].replies == [t or "" for r, t in zip(roles, texts, strict=True) if r == "assistant"]
    assert got[2].replies == [] and len(got[3].turns) == 2


def test_chat_trains_on_replies_only(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "r1"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2"), (1, 4, "user", "q3")]
    got = chat.expand(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("example").collect()
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] if r.loss_start is not None else None for r in got] == ["r1", "r2", None]
    assert got[1].text.startswith(got[0].text) and got[2].text.startswith(got[1].text)


BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def brute_secrets(text):
    found = [(m.start(), k, m.end()) for k, (p, flags, ok) in enumerate(BASE.values()) for m in re.finditer(p, text, flags) if ok(m)]
    return sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "ſecret", "=", ": ", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "%3D", "\\u0041", " ", "\n", "YWJj"]), max_size=25))
def test_secret_base(parts):
    text = "".join(parts)
    base, every = secret_scan.scan(text)
    assert base == brute_secrets(text)
    assert set(base) <= set(every) and all(0 <= a < b <= len(text) for a, _, b in every)


def test_secret_layers():
    inner = "password=hunter22"
    b64 = lambda t: base64.b64encode(t if isinstance(t, bytes) else t.encode()).decode()
    quote = lambda t: "".join(f"%{ord(c):02X}" for c in t)
    for wrap in (b64, quote, lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: b64(gzip.compress(t.encode())), lambda t: b64(quote(t)), lambda t: quote(b64(t)), lambda t: b64(b64(b64(t))), lambda t: urllib.parse.quote(t, safe="")):
        text = f"é {wrap(inner)} end"
        _, every = secret_scan.scan(text)
        assert any(k == 0 and a >= 2 and b <= len(text) - 4 for a, k, b in every), text
        assert "hunter22" not in secret_scan.cover(text, every) and secret_scan.cover(text, every).endswith(" end")
    assert secret_scan.scan("password=a%62cdefgh tail")[1] == [(0, 0, 19)]
    assert secret_scan.scan("%25" * 50 + "41")[1] == []


def test_secret_layers_of_other_formats():
    inner = b"password=hunter22"
    b64 = lambda t: base64.b64encode(t).decode()
    raw = lambda t: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(t) + c.flush()
    wide = inner.decode()
    cases = {
        "bzip2": b64(bz2.compress(inner)), "xz": b64(lzma.compress(inner)), "two members": b64(bz2.compress(b"first") + bz2.compress(inner)), "xz of gzip": b64(lzma.compress(gzip.compress(inner))),
        "raw": b64(raw(b"hello there " * 5 + inner)), "utf-16": b64(wide.encode("utf-16")), "big endian": b64(wide.encode("utf-16-be")), "packed utf-16": b64(gzip.compress(wide.encode("utf-16-le"))),
        "40 MB": b64(gzip.compress(b"plain text, " * 3_400_000 + inner)), "escaped often": "%" + "25" * 300 + "70assword=hunter22",
    }
    for name, held in cases.items():
        text = f"é {held} end"
        _, every = secret_scan.scan(text)
        assert any(k == 0 and a >= 2 and b <= len(text) - 4 for a, k, b in every), name


def test_secret_chains_take_few_steps(monkeypatch):
    steps, old = [], secret_scan._rewritten
    monkeypatch.setattr(secret_scan, "_rewritten", lambda *a: steps.append(1) or old(*a))
    for text in ("%" + "25" * 500_000 + "41", "%25" * 350_000):
        steps.clear()
        base, every = secret_scan.scan(text)
        assert not any(k == 0 for _, k, _ in every) and base == brute_secrets(text) and len(steps) < 30


def test_secret_layers_whole():
    inner = b"password=hunter22"
    b64 = lambda t: base64.b64encode(t).decode()
    url = lambda t: base64.urlsafe_b64encode(t).decode().rstrip("=")
    packed = gzip.compress(gzip.compress(b"plain text, " * 1_500_000 + inner))
    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(900))
    lines = base64.encodebytes(b"nothing to see here " * 4 + inner).decode()
    cases = {
        "large": b64(gzip.compress(b"plain text, " * 1_500_000 + inner)), "large lines": b64(gzip.compress(b"plain text\n" * 1_700_000 + inner)), "twice": b64(packed),
        "members": b64(gzip.compress(b"first") + gzip.compress(inner)), "zlib behind": b64(b"head " + zlib.compress(inner)), "cut short": b64(gzip.compress(noise + inner + noise)[:-9]),
        "nbsp": b64(b"a\xc2\xa0b " + inner), "bom": b64(b"\xef\xbb\xbf" + inner), "nul": b64(inner + b"\0"), "bad byte": b64(gzip.compress(b"\xff " + inner)),
        "url": "https://h/r/" + url(inner), "id": "id_" + url(inner), "dash": "some-" + url(inner) + "-tail/x", "packed id": "id_" + url(gzip.compress(inner)),
        "wrapped": lines, "crlf": lines.replace("\n", "\r\n"), "indented": lines.replace("\n", "\n    "),
    }
    for name, held in cases.items():
        text = f"é {held} end"
        _, every = secret_scan.scan(text)
        assert any(k == 0 and a >= 2 and b <= len(text) - 4 for a, k, b in every), name
    # the URL stays but for the groups of four that hold the secret
    text = "https://h/r/" + url(inner)
    assert secret_scan.cover(text, secret_scan.scan(text)[1]) == "https://h/r/[assign]"


@settings(max_examples=100, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), min_size=1))))
def test_packing_plan(case):
    capacity, counts = case
    fixed, rest = packing.reduce_instance(counts, capacity)
    packed = [*fixed, *packing.best_fit(rest, capacity)]
    total = {}
    for n, held in packed:
        assert n > 0 and sum(x * q for x, q in held.items()) <= capacity
        for x, q in held.items():
            total[x] = total.get(x, 0) + n * q
    assert total == counts
    # best-fit decreasing, item by item
    rooms = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [r for r in range(len(rooms)) if rooms[r] >= x]
        if fit:
            rooms[min(fit, key=lambda r: rooms[r])] -= x
        else:
            rooms.append(capacity - x)
    assert sum(n for n, _ in packed) <= len(rooms) + 1


def test_packing_rows(spark, sf_dir):
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).union(docs(spark, "a\x1cb <|endoftext|>", None, "it's  İx", ids=[9001, 9002, 9003]).select("doc_id", "text", "lang", "source", "n_chars"))
    tokenizer, want = Tokenizer.from_file(packing.TOKENIZER), {}
    for r in d.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = np.array(ids[k : k + 512], "<u4")
            want[r.doc_id, k // 512] = (k, len(part), zlib.crc32(part.tobytes()))
    got = packing.pack(packing.pieces(d, capacity=512), 512).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in held.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 512
    assert len(held) <= 1.02 * sum(n for _, n, _ in want.values()) / 512 + 2


def test_packed_sequences_hold_every_row(spark):
    d = docs(spark, "one two", "one two", "three", None, ids=[1, 1, 1, None])
    packed = packing.pack(packing.pieces(d, capacity=6, with_ids=True), 6)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    rows = packed.collect()
    assert len(rows) == packing.pieces(d, capacity=6).count() and sum(map(len, whole.values())) == sum(r.length for r in rows)
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in rows) and max(map(len, whole.values())) <= 6


def test_keep_one_of_repeated_ids(spark):
    far = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, far[0]), (1, far[1]), (1, far[1]), (2, far[0] + " end"), (3, far[2]), (None, far[2]), (None, None), (4, None), (4, None)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, own string, gone int")
    got = minhash.keep_one(d)
    assert got.columns == d.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    # one of the two near copies of the first text stays, under whichever id
    assert len(kept) == 6 and [k for k in kept if k[1].startswith("a")][0][0] in (1, 2)
    assert [k for k in kept if not k[1].startswith("a")] == sorted([(1, far[1]), (3, far[2]), (0, far[2]), (0, ""), (4, "")])


def test_large_ids_beside_null_ones(spark):
    """Ids beyond 2^53, which floats can't hold, next to null ids in a batch."""
    ids = [2**62 + 1, -(2**62) - 3, None, 2**53 + 1]
    d = docs(spark, *[f"text {i} " * 30 for i in range(4)], ids=ids)
    labels = spark.createDataFrame([(2**62 + 1, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (
        minhash.near_duplicates(d), packing.pieces(d), secret_scan.find(d), piece_scan.digests(*piece_scan.encode(d, chunk=40)), piece_scan.digests(*piece_scan.encode(d)),
        bayes_quality.posterior(d, labels, F.col("source"), F.col("lang")), toxicity.verdicts(d, labels), sharding.assign(d, 10),
    ):
        assert {r.doc_id for r in out.coalesce(1).collect()} == set(ids)


def test_bands_follow_the_threshold():
    for percent in (70, 80, 85, 90):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent) < minhash.MISSED


def test_pieces_against_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_scan.MODEL)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9000, "abcde" * 300), (9001, "   a  b\n\n c" * 40), (9002, "日本€😀\t" * 90), (9003, None), (9004, "▁x ▁"), (9004, "▁x ▁")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = piece_scan.digests(*piece_scan.encode(d, chunk=200)).collect()
    want = sorted((i, len(ids := model.encode(t or "")), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows)
    assert sorted((r.doc_id, r.n_pieces, r.ids_crc32) for r in got) == want
    # the model reads its own mark in a text as a space, as the library does
    whole = {i: (t or "").replace("▁", " ") for i, t in rows}
    assert all(r.text_sha256 == hashlib.sha256(whole[r.doc_id].encode()).hexdigest() for r in got)


def test_quality_bayes_held_out(spark, sf_dir):
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    some, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = bayes_quality.posterior(d, some, F.col("source"), F.col("lang")).join(rest, "doc_id").select((F.col("kept") == (F.col("quality") == 1)).cast("int").alias("ok"), "score").collect()
    assert np.mean([r.ok for r in got]) >= 0.8 and all(0 <= r.score <= 1 for r in got)


def test_quality_bayes_tells_classes_apart(spark):
    rng = random.Random(3)
    good, bad = [[f"{c}{i}" for i in range(40)] for c in "gb"]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 and rng.random() < 0.3 else good) for _ in range(60)), "h", "p") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    truth = {i: int(i % 5 != 0) for i, *_ in rows}
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in bayes_quality.posterior(d, labels, F.col("source"), F.col("lang")).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert np.mean([got[i] for i in held if truth[i]]) >= 0.95 and np.mean([not got[i] for i in held if not truth[i]]) >= 0.9


def brute_posterior(rows):
    """Plain loops over rows (k, host, path, p, y): score of each, leaving the row itself out of its groups."""
    said = [(h or "\0", t or "\0", p, p if y is None else y) for _, h, t, p, y in rows]
    mean = sum(o for *_, o in said) / len(said)

    def weight(groups):
        some = [(g, up) for g, up in groups if len(g) > 1]
        if not some:
            return 10.0
        n = sum(len(g) for g, _ in some)
        noise = sum(sum((o - sum(g) / len(g)) ** 2 for o in g) / (len(g) - 1) for g, _ in some) / len(some)
        real = max(sum(len(g) * (sum(g) / len(g) - up) ** 2 for g, up in some) / n - noise * len(some) / n, 1e-6)
        return min(1000.0, max(1.0, noise / real))

    hosts, paths = {}, {}
    for h, t, _, o in said:
        hosts.setdefault(h, []).append(o)
        paths.setdefault((h, t), []).append(o)
    hw = weight([(g, mean) for g in hosts.values()])
    pw = weight([(g, sum(hosts[h]) / len(hosts[h])) for (h, _), g in paths.items()])
    logit = lambda x: np.log(min(1 - 1e-6, max(1e-6, x)) / (1 - min(1 - 1e-6, max(1e-6, x))))
    out = []
    for h, t, p, o in said:
        top = (hw * mean + sum(hosts[h]) - o) / (hw + len(hosts[h]) - 1)
        low = (pw * top + sum(paths[h, t]) - o) / (pw + len(paths[h, t]) - 1)
        out.append(1 / (1 + np.exp(-(logit(p) + logit(low) - logit(mean)))))
    return out


def test_posteriors_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"h{i}"]), rng.choice(["x", "y", None]), rng.uniform(0.01, 0.99), rng.choice([None, None, 0.0, 1.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, host string, path string, p double, y double")
    want = brute_posterior(rows)
    for most in (10**6, 0):  # by broadcast, and salted
        monkeypatch.setattr(bayes_quality, "SENT_GROUPS", most)
        got = {r.k: r.score for r in bayes_quality.combine(df).collect()}
        assert np.allclose([got[i] for i in range(200)], want, atol=1e-9)


def test_labels_reach_the_posteriors(spark):
    d = docs(spark, *["same words here"] * 40)
    said = lambda y: spark.createDataFrame([(i, y if 20 <= i < 30 else 1 - y) for i in range(20, 40)] + [(20, y), (21, None), (None, y)], "doc_id long, quality int")
    got = [{r.doc_id: r.score for r in bayes_quality.posterior(d, said(y), F.when(F.col("doc_id") % 40 < 30, F.lit("a")).otherwise("b"), F.lit("p")).collect()} for y in (0, 1)]
    assert all(got[1][i] > got[0][i] for i in range(20)) and len(got[0]) == 40


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g in windows if windows.count(g) > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = {i + k for i, g in enumerate(windows) if g in often for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_measures_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a b c", "é\x1f\x85x\u00a0y #\r\n#", *("".join(rng.choice(["a ", "b ", "c\n", "dd\t", "#* ", "\n", "É "]) for _ in range(rng.randrange(90))) for _ in range(60))]
    got = {r.doc_id: r for r in quality_rules.quality_measures(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_measures(t)
        assert tuple(got[i][1:6]) == want and got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_cascade_stops_at_the_first_rejection(spark):
    d = docs(spark, "short", " ".join(f"w{i}" for i in range(60)))
    rules = {"short": lambda c: c("n_words") < 50, "fails": lambda c: F.raise_error(F.lit("evaluated")).cast("boolean")}
    verdict = quality_rules.cascade(F.col("text"), ["short", "fails"], rules)
    assert d.where("doc_id = 0").select(verdict.alias("v")).first().v == "short"
    with pytest.raises(Exception, match="evaluated"):
        d.select(verdict).collect()
    found = quality_rules.order_rules(spark.createDataFrame([(i, "# " * 80) for i in range(40)], "doc_id long, text string"))
    hits = {name: share for name, share, _ in found}
    assert hits["symbols"] == 1.0 and hits["too_short"] == 0.0 and [s / t for _, s, t in found] == sorted((s / t for _, s, t in found), reverse=True)


def test_rule_order_keeps_the_verdict(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = list(quality_rules.RULES)
    kept = [d.where(quality_rules.cascade(F.col("text"), order).isNull()).select("doc_id").collect() for order in (names, names[::-1])]
    assert sorted(kept[0]) == sorted(kept[1])
    judged = quality_rules.quality_measures(d).where("kept").select("doc_id").collect()
    assert sorted(judged) == sorted(kept[0])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = shared.written(stage(spark, before, sf_dir))
        assert after.columns == before.columns and 0 < after.count() <= before.count(), name
        before = after
    rows = {r.doc_id: r.text for r in before.collect()}
    assert not any(secret_scan.scan(t)[0] for t in rows.values())
    assert all(v[2] for v in brute_near(rows.items(), 5, 80).values())
    out = p.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(rows)
