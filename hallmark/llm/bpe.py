"""BPE encoding and decoding in batched NumPy merge rounds.

The distinct words of a batch lie as symbol ids in one flat array. In each round a
binary search over the sorted keys of all merges ranks the neighbouring pairs; every
word merges its pair of the lowest rank, wherever it stands in the word, and words
without a pair left leave the array. Decoding joins the tokens' texts.

Vocabulary files are those of the `tokenizers` library with word ends (BPE model,
byte-level alphabet, NFC and lower-casing, white space dropped); their path is given.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallmark.llm import words as W
from hallmark.llm.tables import settled

#: Distinct words that a worker remembers between batches.
REMEMBERED = 100_000
DECODED_ROWS = 512

# --- fixed values: the pieces that the vocabulary file names --------------------------
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(last: int) -> re.Pattern[str]:
    """Pieces of texts that have no character beyond `last`."""
    letters, numbers = _ranges("L", last), _ranges("N", last)
    return re.compile(f"[{letters}]+|{_ENDINGS}|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")


def _ranges(kind: str, last: int) -> str:
    """Characters of a general category, as ranges of a character class."""
    of = np.array([unicodedata.category(chr(c))[0] == kind for c in range(last + 1)] + [False])
    edges = np.flatnonzero(of[1:] != of[:-1]) + 1
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


# Most texts need the short pattern only.
_LATIN, _LAST_LATIN = _pattern(0x24F), re.compile("[^\\x00-\\u024f]")
_any = lru_cache(maxsize=1)(lambda: _pattern(0x10FFFF))

_NONE = np.int64(1) << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown, spare = [], 256
    for byte in range(256):
        shown.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return shown


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in (vocab | self.special).items():
            self.shown[i] = token
        self.tokens = pa.array(self.shown, pa.string())
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = byte_alphabet()
        self.byte = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + self.end] for c in shown], np.int64)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = np.int64(len(self.shown))
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.known: dict[str, int] = {}
        self.stored = self.sizes = self.begins = np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """Words of a text, and special tokens that stand in it."""
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        found: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append(part)
                continue
            part = unicodedata.normalize("NFC", part)
            if "Σ" in part:  # a capital sigma becomes the same letter everywhere
                part = part.replace("Σ", "σ")
            part = part.lower()
            found += (_any() if _LAST_LATIN.search(part) else _LATIN).findall(part)
        return found

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word; words must not be empty."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.byte[flat]
        symbols[ends] = self.last[flat[ends]]
        owner = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ranks = np.full(len(symbols), _NONE)
        ranks[:-1] = self._rank(symbols[:-1], symbols[1:])
        ranks[ends] = _NONE
        while len(owner):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == _NONE
            if over.any():
                inside = np.repeat(over, lengths)
                done.append((owner[over], lengths[over], symbols[inside]))
                keep = ~inside
                symbols, ranks = symbols[keep], ranks[keep]
                owner, lengths, lowest = owner[~over], lengths[~over], lowest[~over]
                if not len(owner):
                    break
                starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            hit = _apart(hit)
            symbols[hit] = self.made[ranks[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            before = np.add.reduceat(gone.astype(np.int64), starts)
            kept = np.flatnonzero(~gone)
            moved = hit - np.searchsorted(hit, hit, "left")
            symbols, ranks = symbols[kept], ranks[kept]
            lengths = lengths - before
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(lengths) - 1] = True
            anew = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            anew = anew[~last[anew]]
            ranks[last] = _NONE
            if len(anew):
                ranks[anew] = self._rank(symbols[anew], symbols[anew + 1])
        owners = np.concatenate([d[0] for d in done])
        sizes = np.concatenate([d[1] for d in done])
        pieces = np.split(np.concatenate([d[2] for d in done]), np.cumsum(sizes)[:-1])
        result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for k, piece in zip(owners.tolist(), pieces, strict=True):
            result[k] = piece
        return result

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more)."""
        split = [self.words(t) for t in texts]
        words = list(chain.from_iterable(split))
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = set(words)
        if fresh:
            self._remember(list(fresh))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(total[-1]) + np.repeat(self.begins[at] - total[:-1], sizes)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return self.stored[place], total[np.concatenate(([0], np.cumsum(counts)))]

    def _remember(self, fresh: list[str]) -> None:
        if not self.known:
            self.stored, self.sizes, self.begins = (np.zeros(0, np.int64) for _ in range(3))
        plain = [w for w in fresh if w not in self.special]
        special = [w for w in fresh if w in self.special]
        ids = self.merge([w.encode() for w in plain]) + [np.array([self.special[w]]) for w in special]
        sizes = np.array([len(x) for x in ids], np.int64)
        self.known.update(zip(plain + special, range(len(self.known), len(self.known) + len(ids)), strict=True))
        self.begins = np.concatenate((self.begins, len(self.stored) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.stored = np.concatenate((self.stored, *ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the tokens' texts with a space between."""
        sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        shown = self.tokens.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown), " ")


def _apart(hit: np.ndarray) -> np.ndarray:
    """Without the hits that overlap one taken before: every other one of a run."""
    near = np.concatenate(([False], hit[1:] == hit[:-1] + 1))
    if not near.any():
        return hit
    place = np.arange(len(hit))
    begun = np.maximum.accumulate(np.where(near, 0, place))
    return hit[(place - begun) % 2 == 0]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row: the token ids of its whole text.

    Null and empty texts have no ids; special tokens in a text count as such. Only
    doc_id and text are read. `path` must be readable on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                flat, bounds = model.encode(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())),
                    ],
                    names=["doc_id", "ids"],
                )

    settled(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row: `encode` and `decode` in one pass, so that a
    task needs one Python worker with one copy of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                flat, bounds = model.encode(texts.to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), ids, model.decode(ids)], names=["doc_id", "ids", "decoded"]
                )

    settled(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row; no ids give an empty text, null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for k in range(0, len(batch), DECODED_ROWS):
                part = batch.slice(k, DECODED_ROWS)
                ids = part.column(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, model.decode(ids)], names=["doc_id", "ids", "decoded"]
                )

    settled(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
