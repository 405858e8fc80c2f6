"""Toxicity and language-model scores: held-out quality, exact counts, edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from hallmark.llm import lm_scores, toxicity

BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def corpus(n=700, seed=5):
    """Texts of a small language, a third of them with words of two bad stems."""
    r = random.Random(seed)
    plain = ["".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 3))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 160))]
        toxic = int(k % 3 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(("zorg", "kvex")) + r.choice(plain))
        rows.append((k, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9002, " .. "), (None, "zorga"), (9003, "la " * 30_000 + "zorgari " + "la " * 900)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, t) for d, _, t in rows] + [(0, 0), (None, 1), (1, None), (77777, 1)], "doc_id long, toxic int")
    net = toxicity.trained(docs, labels)
    found = toxicity.scored(docs.unionByName(odd.withColumn("score", F.lit(""))), net).collect()
    assert len(found) == len(rows) + 5
    got = {r.doc_id: r for r in found}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and remainder(r.doc_id) == 0) for r in found)
    held = [(got[d].predicted, t) for d, _, t in rows if remainder(d) == 0]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert got[9003].predicted == 1 and got[9000].predicted == got[9001].predicted == 0
    stay = toxicity.without_toxic(docs.unionByName(odd.withColumn("score", F.lit(""))), net)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in found if not r.predicted}
    assert toxicity.scored(docs.where("false"), toxicity.trained(docs.where("false"), labels.where("false"))).count() == 0


def test_gradients_of_the_recurrent_network():
    net = toxicity.Network(seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).normal(size=(6, 3 * toxicity.DIM))
    at = np.full((2, toxicity.WINDOW), -1)
    at[0, :5], at[1, :9] = [0, 1, 2, 3, 4], [5, 4, 3, 2, 1, 0, 1, 2, 3]

    def loss():
        return float(net.forward(net.gates(x), at) @ np.array([1.0, -2.0]))

    keep: dict = {}
    net.forward(net.gates(x), at, keep)
    g, d_gates = net.gradients(at, keep, np.array([1.0, -2.0]), 6)
    g["wf"], g["cb"] = x.T @ d_gates["f"], d_gates["b"].sum(axis=0)
    for name in ("out", "pool", "att", "uf", "ub", "wf", "cb"):
        place = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][place]
        net.p[name][place] = old + 1e-2
        up = loss()
        net.p[name][place] = old - 1e-2
        slope = (up - loss()) / 2e-2
        net.p[name][place] = old
        assert math.isclose(slope, float(g[name][place]), rel_tol=0.02, abs_tol=2e-3), name


def test_windows_cover_every_word():
    v = toxicity.Vocabulary(pa.array(["", " ".join(f"w{k}" for k in range(100)), "one", "a " * 32, "a " * 33], pa.large_string()))
    at, row = v.windows()
    assert set(row.tolist()) == {1, 2, 3, 4} and np.bincount(row).tolist() == [0, 4, 1, 1, 2]
    assert len(set(at[row == 1].ravel().tolist()) - {-1}) == 100


def test_language_model_counts_and_scores(spark):
    rows = [(d, t) for d, t, _ in corpus(500)] + [(600, None), (601, ""), (602, "É\xa0x NEW-Word " + "la " * 5000), (None, "trained on")]
    docs = spark.createDataFrame(rows + [rows[3]], "doc_id long, text string").withColumn("score", F.lit("clash"))
    old, lm_scores.HEAD_WORDS = lm_scores.HEAD_WORDS, 50  # both ways of counting
    try:
        got = lm_scores.scored(docs, BYTE, public_tokenizers.PATTERN).collect()
    finally:
        lm_scores.HEAD_WORDS = old
    assert len(got) == len(rows) + 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for d, t in rows + [rows[3]] if d is None or remainder(d) != 1 for w in tokens(t))
    total = sum(c.values())
    by_id = dict(rows)
    better = words = 0
    for r in got:
        own = tokens(by_id[r.doc_id])
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (r.doc_id is not None and remainder(r.doc_id) == 1)
        if r.held_out:
            better, words = better + r.score - base, words + len(own)
    assert better > -0.2 * words
    assert lm_scores.scored(docs.where("false"), BYTE, public_tokenizers.PATTERN).count() == 0


def test_language_model_learns_from_texts_that_no_sample_holds(spark):
    subwords = lm_scores.Subwords(BYTE, public_tokenizers.PATTERN)
    long = " ".join(f"море берег волна {k % 7} песок" for k in range(1000))  # over SAMPLE_CHARS
    rows = [(d, t) for d, t, _ in corpus(120)] + [(10**6, long), (10**6 + 1, long + " камень")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    near, often = lm_scores.neighbours(docs, BYTE, public_tokenizers.PATTERN, subwords.end + 1)
    ids, bounds, _, _, _ = lm_scores.encoded([t for _, t in rows], subwords)
    whole = np.zeros((subwords.end + 1) * (lm_scores.BESIDE + 1), np.int64)
    lm_scores.add_neighbours(whole, ids, bounds)
    whole = whole.reshape(subwords.end + 1, -1)
    assert (near == whole[:, :-1]).all() and (often == whole[:, -1]).all() and (often == np.bincount(ids, minlength=len(often))).all()
    classes, inner = lm_scores.classes_of(near, often, subwords.begins)
    model = lm_scores.Attention(subwords.end + 1, classes, inner, np.zeros((1, 1), np.float32))
    begun = model.p["id"].copy()
    long_ids, long_bounds, _, _, _ = lm_scores.encoded([long], subwords)
    seen, goal = model.blocks(long_ids, long_bounds)
    loss = lambda: -model.forward(seen)[goal >= 0][np.arange(len(long_ids)), classes[goal[goal >= 0]]].mean()
    before = loss()
    lm_scores.trained(docs, model, BYTE, public_tokenizers.PATTERN)
    own = np.unique([x for w in ("море", "берег", "волна", "песок") for x in subwords([w.encode()])[0]])
    rare = {0, lm_scores.BEGIN_CLASSES + 1}
    assert not rare & set(classes[own].tolist())
    assert (model.p["id"][own] != begun[own]).any(axis=1).all() and loss() < before


def test_every_block_of_a_long_text_is_trained_on(spark):
    """One block in 32 was, so most ids of a text left the model as it was."""
    subwords = lm_scores.Subwords(BYTE, public_tokenizers.PATTERN)
    long = " ".join(str(k * 7919) for k in range(800))
    docs = spark.createDataFrame([(1, long), (2, "a short one"), (3, "")], "doc_id long, text string")
    size = subwords.end + 1
    model = lm_scores.Attention(size, np.arange(size) % 5, np.array([False] * 5), np.zeros((1, 1), np.float32))
    begun = model.p["id"].copy()
    lm_scores.trained(docs, model, BYTE, public_tokenizers.PATTERN)
    ids, _, _, _, _ = lm_scores.encoded([long, "a short one"], subwords)
    changed = np.flatnonzero((model.p["id"] != begun).any(axis=1))
    assert set(changed.tolist()) == set(ids.tolist()) and len(changed) > 200


def test_mixture_does_not_depend_on_the_head(spark):
    rows = [(d, t) for d, t, _ in corpus(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    subwords = lm_scores.Subwords(BYTE, public_tokenizers.PATTERN)
    texts = [t for _, t in rows]
    ids, bounds, lengths, words, at = lm_scores.encoded(texts, subwords)
    counts = lm_scores.word_counts(docs)
    c, total = Counter(words[k] for k in at), float(len(at))
    model = lm_scores.Attention(subwords.end + 1, np.zeros(subwords.end + 1, np.int64), np.array([False]), np.zeros((1, 1)))
    model.words_logs = lambda ids, bounds, lengths: np.full(len(lengths), -5.0)
    lm_scores.set_mixture(model, texts, subwords, counts, total)
    kept = [w for t in texts[9::10] for w in [*lm_scores.split_words(t), b""]]
    own, share = np.log([(c[w] + 0.5) / total for w in kept]), 0.5
    for _ in range(30):
        share = float(np.clip(np.mean(1 / (1 + np.exp(np.log(1 - share) + own - np.log(share) + 5.0))), 0.01, 0.99))
    assert math.isclose(model.own_share, share, rel_tol=1e-9)


def test_attention_is_causal_and_scores_each_id_once():
    r = np.random.default_rng(2)
    classes = np.concatenate((r.integers(0, 5, 39), [5]))
    model = lm_scores.Attention(40, classes, np.array([0, 1, 0, 1, 0, 0], bool), np.zeros((6, 40)))
    ids, bounds = r.integers(0, 39, 120), np.array([0, 0, 1, 50, 120])
    seen, goal = model.blocks(ids, bounds)
    assert sorted(goal[goal >= 0].tolist()) == sorted(ids.tolist())
    lengths = np.ones(120, np.int64)
    logs = model.words_logs(ids, bounds, lengths)
    changed = ids.copy()
    changed[90] = (changed[90] + 1) % 39
    model.tables = None
    again = model.words_logs(changed, bounds, lengths)
    assert np.allclose(logs[:89], again[:89]) and not np.allclose(logs[90:], again[90:])
    slow = model.forward(seen)
    inside = goal >= 0
    fast, _ = model._scored(seen, goal, inside)
    assert np.allclose(fast, slow[inside][np.arange(inside.sum()), classes[goal[inside]]], atol=1e-4)
