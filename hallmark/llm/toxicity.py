"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs are words: a hashed embedding of the word, the mean of hashed embeddings of its
character 3- to 5-grams, and the mean of those of its beginnings of 2 to 5 characters,
so unseen forms of a known stem are recognised. Texts
are cut into overlapping windows, all of which are scored; a text's score comes from
its highest window. The network is trained in NumPy on a bounded sample of labelled
documents. Labels are of documents, so windows of toxic ones start as positive, and
are then relabelled by what the network finds in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallmark.llm import words as W
from hallmark.llm.tables import settled

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 24
#: Training documents of each label at most, and the longest text used in training.
SAMPLE, SAMPLE_CHARS = 800, 20_000
#: Words and character runs have embeddings if so many training documents have them.
LEAST_DOCS = 3
BUCKETS = 1 << 15
DIM, HIDDEN, POOL = 8, 8, 8
EPOCHS, LEAST_STEPS, BATCH = 3, 300, 256
#: Gradient steps before windows of toxic documents are relabelled.
DOCUMENT_STEPS = 120
BLOCK_WINDOWS = 2048

_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Vocabulary:
    """The distinct words of some texts with the buckets of their inputs."""

    def __init__(self, texts: pa.Array):
        words = W.Words(texts, _GAPS)
        hashes = words.hashes()
        self.hashes, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        self.bounds = words.bounds
        self.word = (self.hashes % np.uint64(BUCKETS)).astype(np.int64)
        starts, lengths = words.starts[first], words.ends[first] - words.starts[first]
        # Each word with a blank on both sides, one behind the other.
        wide = lengths + 2
        cuts = np.cumsum(wide) - wide
        place = np.arange(int(wide.sum())) - np.repeat(cuts, wide)
        flat = np.full(len(place), 32, np.uint64)
        inner = (place > 0) & (place <= np.repeat(lengths, wide))
        source = np.repeat(starts, wide) + place - 1
        flat[inner] = _LOWER[words.bytes_[source[inner]]]
        left = np.repeat(wide, wide) - place
        grams, owners, heads = [], [], []
        code = flat.copy()
        owner = np.repeat(np.arange(len(first)), wide)
        for size in range(2, 7):
            code = code[:-1] * np.uint64(257) + flat[size - 1 :] if len(code) > 1 else code[:0]
            fine = left[: len(code)] >= size
            if 2 < size < 6:
                grams.append(W.mixed(code[fine]) % np.uint64(BUCKETS))
                owners.append(owner[: len(code)][fine])
            if size > 2:  # how the word begins; a shorter word again as a whole
                long = wide >= size
                head = self.hashes.copy()
                head[long] = code[cuts[long]]
                heads.append(W.mixed(head + np.uint64(size)) % np.uint64(BUCKETS))
        self.heads = np.stack(heads, axis=1).astype(np.int64)
        owners_ = np.concatenate(owners)
        order = np.argsort(owners_, kind="stable")
        self.grams = np.concatenate(grams).astype(np.int32)[order]
        self.gram_counts = np.bincount(owners_, minlength=len(first))

    def windows(self, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) word numbers, -1 behind the end, and each window's row."""
        counts = np.diff(self.bounds)
        number = np.where(counts > 0, 1 + -(-np.maximum(counts - WINDOW, 0) // STRIDE), 0)
        row = np.repeat(np.arange(len(counts)), number)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        at = self.bounds[row][:, None] + (nth * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < self.bounds[row + 1][:, None]
        return np.where(inside, self.at[np.minimum(at, max(len(self.at) - 1, 0))] if len(self.at) else -1, -1), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * x.dtype.type(0.5)) * x.dtype.type(0.5) + x.dtype.type(0.5)


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by their place; rows of place -1 are left out."""
    order = np.argsort(at, kind="stable")
    order = order[np.searchsorted(at[order], 0) :]
    places, first = np.unique(at[order], return_index=True)
    total = np.zeros((size, rows.shape[1]), np.float32)
    if len(places):
        total[places] = np.add.reduceat(rows[order], first, axis=0)
    return total


@dataclass
class Network:
    """Parameters, scoring, and gradients of one batch."""

    seed: int = 5
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    empty: float = -2.0

    def __post_init__(self) -> None:
        if self.p:
            return
        rng = np.random.default_rng(self.seed)
        shapes = {"word": (BUCKETS, DIM), "gram": (BUCKETS, DIM), "head": (BUCKETS, DIM), "att": (2 * HIDDEN, POOL), "pool": (POOL,), "out": (2 * HIDDEN,)}
        for way in ("f", "b"):
            shapes |= {f"w{way}": (3 * DIM, 3 * HIDDEN), f"u{way}": (HIDDEN, 3 * HIDDEN), f"c{way}": (3 * HIDDEN,)}
        for name, shape in shapes.items():
            spread = 0.3 if name in ("word", "gram", "head") else 1 / np.sqrt(shape[0])
            self.p[name] = (rng.standard_normal(shape) * spread).astype(np.float32)
        self.p["cf"][:] = self.p["cb"][:] = 0
        self.p["bias"] = np.zeros(1, np.float32)

    def inputs(self, words: np.ndarray, grams: np.ndarray, counts: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Input vectors of words, from their buckets; every word has a gram."""
        ends = np.concatenate(([0], np.cumsum(counts)))
        sums = np.zeros((len(words), DIM), np.float32)
        for k in range(0, len(words), 8192):  # in parts, to bound memory
            own = ends[k : k + 8193]
            part = self.p["gram"][grams[own[0] : own[-1]]]
            sums[k : k + 8192] = np.add.reduceat(part, own[:-1] - own[0], axis=0)
        begins = self.p["head"][heads].mean(axis=1)
        return np.concatenate((self.p["word"][words], sums / counts[:, None].astype(np.float32), begins), axis=1)

    def _run(self, way: str, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps x windows x HIDDEN) in reading order of one direction."""
        u, h = self.p["u" + way], np.zeros((len(at), HIDDEN), np.float32)
        states = np.zeros((WINDOW, len(at), HIDDEN), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            g, a = gates[at[:, t]], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * HIDDEN :]))
            h = (n + z * (h - n)) * mask[:, t, None]
            states[t] = h
        return states

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates for each word, and zeros for the place behind the end."""
        return {w: np.concatenate((x @ self.p["w" + w] + self.p["c" + w], np.zeros((1, 3 * HIDDEN), np.float32))) for w in "fb"}

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        mask = (at >= 0).astype(np.float32)
        tapes: dict[str, list | None] = {w: [] if keep is not None else None for w in "fb"}
        both = np.concatenate([self._run(w, gates[w], at, mask, tapes[w]) for w in "fb"], axis=2)
        hidden = np.tanh(both @ self.p["att"])
        scores = hidden @ self.p["pool"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        weights = np.exp(scores - scores.max(axis=0))
        weights /= weights.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weights, both)
        if keep is not None:
            keep |= {"mask": mask, "both": both, "hidden": hidden, "weights": weights, "pooled": pooled, "tapes": tapes}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, at: np.ndarray, keep: dict, slope: np.ndarray, words: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Of the parameters, and of the gates' input parts by word."""
        g: dict[str, np.ndarray] = {"out": keep["pooled"].T @ slope, "bias": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * self.p["out"]
        weights, both, hidden = keep["weights"], keep["both"], keep["hidden"]
        d_weights = np.einsum("bh,tbh->tb", d_pooled, both)
        d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
        g["pool"] = np.einsum("tb,tbp->p", d_scores, hidden)
        d_hidden = d_scores[:, :, None] * self.p["pool"] * (1 - hidden**2)
        g["att"] = np.einsum("tbh,tbp->hp", both, d_hidden)
        d_both = weights[:, :, None] * d_pooled + d_hidden @ self.p["att"].T
        d_gates = {}
        for k, way in enumerate("fb"):
            own = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            u = self.p["u" + way]
            d_u, dh = np.zeros_like(u), np.zeros_like(own[0])
            outers = np.zeros((WINDOW, len(at), 3 * HIDDEN), np.float32)
            for t, h, z, r, n, a in reversed(keep["tapes"][way]):
                d = (dh + own[t]) * keep["mask"][:, t, None]
                dn = d * (1 - z) * (1 - n**2)
                dz, dr = d * (h - n) * z * (1 - z), dn * a * r * (1 - r)
                outers[t] = np.concatenate((dz, dr, dn), axis=1)
                inner = np.concatenate((dz, dr, dn * r), axis=1)
                d_u += h.T @ inner
                dh = d * z + inner @ u.T
            g["u" + way], d_gates[way] = d_u, _summed(at.T.ravel(), outers.reshape(-1, 3 * HIDDEN), words)
        return g, d_gates

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logits.astype(np.float64) + self.shift)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability for each text, from its highest window; of no words, a fixed one."""
        best = np.full(len(texts), -np.inf)
        vocabulary = Vocabulary(texts)
        if len(vocabulary.word):
            gates = self.gates(self.inputs(vocabulary.word, vocabulary.grams, vocabulary.gram_counts, vocabulary.heads))
            at, row = vocabulary.windows()
            for k in range(0, len(at), BLOCK_WINDOWS):
                np.maximum.at(best, row[k : k + BLOCK_WINDOWS], self.forward(gates, at[k : k + BLOCK_WINDOWS]))
        return np.where(np.isfinite(best), self.probability(np.where(np.isfinite(best), best, 0)), _sigmoid(np.float64(self.empty)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * x * x
            p[k] -= (self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-6)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """A network from documents and their labels; `prior` is the share of label 1.

    Every fifth document is kept back to set the scale on which a text's highest window
    becomes a probability. Without documents of both labels every text scores `prior`.
    """
    net = Network(seed)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    net.empty = float(np.log(prior / (1 - prior)))
    if len(set(labels.tolist())) < 2:
        net.scale, net.shift = 0.0, net.empty
        return net
    vocabulary = Vocabulary(pa.array(texts, pa.large_string()))
    at, row = vocabulary.windows()
    begins = np.cumsum(vocabulary.gram_counts) - vocabulary.gram_counts
    fit = row % 5 != 4
    target = labels[row].astype(np.float32)
    rng, adam = np.random.default_rng(seed), _Adam(0.01)
    squares = {k: np.full(BUCKETS, 1e-2, np.float32) for k in ("word", "gram", "head")}
    toxic = labels[row] == 1
    some = np.isin(np.arange(len(labels)), row)
    kept = some & (np.arange(len(labels)) % 5 == 4)
    if len(set(labels[kept].tolist())) < 2:
        kept = some
    least, best = np.inf, net.p
    _only_shared(net, vocabulary, at, row)
    for epoch in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, 2 * int(toxic.sum()))))):
        # As many windows of clean texts as of toxic ones, others in each epoch.
        clean = rng.permutation(np.flatnonzero(fit & ~toxic))
        order = rng.permutation(np.concatenate((np.flatnonzero(fit & toxic), clean[: int(toxic.sum())])))
        balance = (target[order] == 0).sum() / max(1, (target[order] == 1).sum())
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            words, inverse = np.unique(at[part], return_inverse=True)
            hole = int(words[0] == -1)
            words = words[hole:]
            local = inverse.reshape(at[part].shape) - hole  # -1 stays the place behind the end
            counts = vocabulary.gram_counts[words]
            ends = np.cumsum(counts)
            grams = vocabulary.grams[np.arange(ends[-1]) + np.repeat(begins[words] - ends + counts, counts)]
            heads = vocabulary.heads[words]
            x = net.inputs(vocabulary.word[words], grams, counts, heads)
            keep: dict = {}
            logits = net.forward(net.gates(x), local, keep)
            wanted = target[part]
            slope = (_sigmoid(logits) - wanted) * np.where(wanted == 1, min(balance, 10), 1) / len(part)
            g, d_gates = net.gradients(local, keep, slope.astype(np.float32), len(words))
            d_x = np.zeros_like(x)
            for way in "fb":
                g["w" + way], g["c" + way] = x.T @ d_gates[way], d_gates[way].sum(axis=0)
                d_x += d_gates[way] @ net.p["w" + way].T
            adam.step(net.p, g)
            d_grams = np.repeat(d_x[:, DIM : 2 * DIM] / counts[:, None], counts, axis=0)
            d_heads = np.repeat(d_x[:, 2 * DIM :] / heads.shape[1], heads.shape[1], axis=0)
            for name, at_, d in (
                ("word", vocabulary.word[words], d_x[:, :DIM]), ("gram", grams, d_grams), ("head", heads.ravel(), d_heads)
            ):
                bucket, where = np.unique(at_, return_inverse=True)
                total = _summed(where, d * len(part), len(bucket))
                total[~net.p[name][bucket].any(axis=1)] = 0  # cleared ones stay so
                squares[name][bucket] += (total**2).mean(axis=1)
                net.p[name][bucket] -= 0.1 * total / np.sqrt(squares[name][bucket])[:, None]
        logits = _all_logits(net, vocabulary, at)
        high = np.full(len(labels), -np.inf)
        np.maximum.at(high, row, logits)
        scale, shift, loss = _calibrated(high[kept], labels[kept], prior)
        if loss < least:
            least, net.scale, net.shift = loss, scale, shift
            best = {k: x.copy() for k, x in net.p.items()}
        # Windows of toxic texts count by what was found: the highest one of each, and
        # those above nearly all windows of clean texts.
        if adam.n >= DOCUMENT_STEPS:
            bar = np.quantile(logits[fit & ~toxic], 0.999)
            target = (toxic & ((logits > bar) | (logits == high[row]))).astype(np.float32)
    net.p = best
    return net


def _only_shared(net: Network, vocabulary: Vocabulary, at: np.ndarray, row: np.ndarray) -> None:
    """Clear the embeddings of what too few documents have: they could only be learned by heart."""
    least = max(LEAST_DOCS, (int(row.max()) + 1) // 200)
    docs = {name: np.zeros(BUCKETS, np.int64) for name in ("word", "gram", "head")}
    ends = np.cumsum(vocabulary.gram_counts)
    edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        words = np.unique(at[a:b])
        words = words[words >= 0]
        counts = vocabulary.gram_counts[words]
        grams = np.arange(int(counts.sum())) + np.repeat(ends[words] - np.cumsum(counts), counts)
        docs["word"][vocabulary.word[words]] += 1
        docs["gram"][np.unique(vocabulary.grams[grams])] += 1
        docs["head"][np.unique(vocabulary.heads[words])] += 1
    for name, met in docs.items():
        net.p[name][met < least] = 0


def _all_logits(net: Network, vocabulary: Vocabulary, at: np.ndarray) -> np.ndarray:
    gates = net.gates(net.inputs(vocabulary.word, vocabulary.grams, vocabulary.gram_counts, vocabulary.heads))
    return np.concatenate([net.forward(gates, at[k : k + BLOCK_WINDOWS]) for k in range(0, len(at), BLOCK_WINDOWS)])


def _calibrated(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Scale, shift and loss of a logistic fit, with labels weighted to the prior."""
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    weight /= weight.sum()
    scale, shift = 1.0, 0.0
    for _ in range(200):  # damped Newton steps with a small ridge
        p = _sigmoid(scale * logits + shift)
        g = np.array([(weight * (p - labels) * logits).sum() + 1e-4 * scale, (weight * (p - labels)).sum() + 1e-4 * shift])
        c = weight * p * (1 - p)
        h = np.array([[(c * logits**2).sum() + 1e-4, (c * logits).sum()], [(c * logits).sum(), c.sum() + 1e-4]])
        move = np.linalg.solve(h, g)
        size = min(1.0, 1.0 / (np.abs(move).max() + 1e-9))
        scale, shift = scale - size * move[0], shift - size * move[1]
    p = np.clip(_sigmoid(scale * logits + shift), 1e-9, 1 - 1e-9)
    loss = -(weight * np.where(labels == 1, np.log(p), np.log(1 - p))).sum()
    return float(max(scale, 0.01)), float(shift), float(loss)


def held_out(doc_id) -> object:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from a bounded sample of labelled documents that are not held out.

    The sample is the SAMPLE ids of each label that come first in the order of a hash,
    among labelled texts of up to SAMPLE_CHARS characters. A doc_id with several labels
    counts as toxic if one of them says so; null labels are left out.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    shares = known.agg(F.avg("toxic").alias("prior")).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(f"text is not null and length(text) <= {SAMPLE_CHARS}")
    rows: list = []
    for label in (0, 1):
        # Some of the first ids may have no text here, or too long a one.
        first = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
        found = texts.join(F.broadcast(first), "doc_id").dropDuplicates(["doc_id"])
        rows += found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), float(shares["prior"] or 0.0))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`.

    `score` is the probability of label 1, from the text alone; a null text, or one
    without words, gets the share of label 1. `predicted` is 1 from 0.5 on. A null
    doc_id is not held out. Repeated rows are scored as often.
    """
    settled(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(net.score(texts), pa.float64())], names=["doc_id", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all columns."""
    settled(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score(texts) for _, texts in W.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
