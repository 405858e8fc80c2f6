"""Token counts of every prefix by dynamic programming, for BPE with byte fallback.

A token sequence is the one BPE gives exactly if each neighbouring pair is what BPE
gives for the two tokens' texts. So the last token of a prefix is the one token that
ends there and fits the last token before it, and the prefix's count is one more than
the count where that token begins: one pass gives the exact count of every prefix.

No token of the vocabulary goes on after a word into white space, so a text is cut into
units (white space and the word behind it) whose counts add up. A worker remembers the
counts of the units it met, in two generations: when the newer one is full it becomes the
older, and units met again move on. Truncation and budget questions are answered from the
counts, without encoding again.

Vocabulary files are `sentencepiece` BPE models with byte fallback, identity
normalisation and a dummy prefix; their path is given.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallmark.llm import words as W
from hallmark.llm.tables import settled

#: Units of a generation, and pairs of tokens, that a worker remembers; and their characters.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16 << 20
SPACE = "▁"


class PrefixCounter:
    """Counts the tokens of all prefixes under one vocabulary file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        if norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("white space must be kept, with a dummy prefix")
        # Only ordinary pieces are merged to; bytes and control pieces never are.
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        longer = [t for t in self.rank if len(t) > 1]
        if any(SPACE in t.lstrip(SPACE) for t in longer):
            raise ValueError("tokens must not reach over the end of a word")
        joined = set("".join(longer))
        alone = "".join(sorted({"\n", "\r", "\t"} - joined))
        cut = f"[{re.escape(alone)}]|" if alone else ""
        self.unit = re.compile(f"{cut}{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+")
        # How long tokens are that end in two given characters, the longest first.
        sizes: dict[str, set[int]] = {}
        for t in longer:
            sizes.setdefault(t[-2:], set()).add(len(t))
        self.sizes = {tail: sorted(found, reverse=True) for tail, found in sizes.items()}
        self.fit: dict[str, dict[str, bool]] = {}
        self.fits_known = 0
        self.total: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.chars = 0

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.rank.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        if self.fits_known > REMEMBERED:
            self.fit.clear()
            self.fits_known = 0
        fit = self.fit.setdefault(b, {})[a] = self.merged(a + b) == ([a, b] if a else [b])
        self.fits_known += 1
        return fit

    def prefixes(self, unit: str) -> array[int]:
        """Token count of each prefix of a unit, from one character to all."""
        rank, sizes, none = self.rank, self.sizes, ()
        tokens = [""]
        counts = [0]
        for end in range(1, len(unit) + 1):
            for size in sizes.get(unit[end - 2 : end], none) if end > 1 else none:
                token = unit[end - size : end] if size <= end else ""
                if token in rank:
                    before = tokens[end - size]
                    met = self.fit.get(token)
                    fine = met.get(before) if met is not None else None
                    if fine is None:
                        fine = self.fits(before, token)
                    if fine:
                        tokens.append(token)
                        counts.append(counts[end - size] + 1)
                        break
            else:
                char = unit[end - 1]
                tokens.append(char)
                counts.append(counts[-1] + (1 if char in rank else len(char.encode())))
        return array("i", counts[1:])

    def units(self, text: str) -> list[str]:
        """Units of a text behind its dummy prefix; their counts add up."""
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def totals(self, units: list[str]) -> list[int]:
        """Token count of each unit."""
        fresh = set(units).difference(self.total)
        if fresh:
            if len(self.total) + len(fresh) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.older, self.total, self.chars = self.total, {}, 0
                fresh = set(units)
            total, older = self.total, self.older
            for unit in fresh:
                met = older.get(unit)
                total[unit] = self.prefixes(unit)[-1] if met is None else met
                self.chars += len(unit)
        return list(map(self.total.__getitem__, units))

    def count(self, text: str) -> int:
        return sum(self.totals(self.units(text)))

    def counted(self, text: str, limit: int) -> tuple[int, int]:
        """Token count of a text, and characters of its longest prefix within `limit`.

        The limit is met in one unit: prefixes that end in units behind it have more
        tokens, and only this unit's prefixes are looked at.
        """
        units = self.units(text)
        totals = self.totals(units)
        n = sum(totals)
        if n <= limit:
            return n, len(text)
        before = np.cumsum([0, *totals[:-1]])
        k = int(np.searchsorted(before, limit)) - 1  # the last unit with less than the limit before it
        if k < 0:
            return n, 0
        within = np.frombuffer(self.prefixes(units[k]), np.int32)
        fine = np.flatnonzero(before[k] + within <= limit)
        chars = sum(map(len, units[:k])) + (int(fine[-1]) + 1 if len(fine) else 0)
        return n, max(chars - 1, 0)  # without the dummy prefix

    def counts(self, text: str) -> np.ndarray:
        """Entry i is the token count of the first i characters, from 0 to all."""
        units = self.units(text)
        if not units:
            return np.zeros(1, np.int32)
        known = {u: np.frombuffer(self.prefixes(u), np.int32) for u in set(units)}
        parts = [known[u] for u in units]
        totals = np.array([p[-1] for p in parts], np.int32)
        before = np.cumsum(totals) - totals
        flat = np.concatenate(parts) + np.repeat(before, [len(p) for p in parts])
        flat[0] = 0  # the dummy prefix alone is the empty text
        return flat.astype(np.int32)


@lru_cache(maxsize=2)
def loaded(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _rows(docs: DataFrame) -> DataFrame:
    settled(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts): entry i of counts is the token count of the first i characters.

    Null and empty texts have the one entry 0. Only doc_id and text are read. Special
    strings in a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                counts = [model.counts(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.list_(pa.int32()))],
                    names=["doc_id", "counts"],
                )

    return _rows(docs).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_of(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters; the whole text's if it has fewer."""
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    fine = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fine)


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) for each row.

    n_bytes is the text's length in UTF-8, over_limit whether it has more than `limit`
    tokens, and fit_chars the length in characters of its longest prefix within the
    limit. A null or empty text has 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                lists = texts.to_pylist()
                counted = [model.counted(t, limit) for t in lists]
                totals, fit = [n for n, _ in counted], [chars for _, chars in counted]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(t.encode()) for t in lists], pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([n > limit for n in totals], pa.bool_()),
                        pa.array(fit, pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    return _rows(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
