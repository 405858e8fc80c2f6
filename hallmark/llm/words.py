"""Words, word hashes and shingles of many texts in flat NumPy arrays.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Hashes
are 64 bit and the same in every worker. Work goes through slices of bounded bytes, so
a batch of long texts needs no more memory than one long text does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of at most `size` bytes, or one longer text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 :][: len(texts)]
    first, begun = 0, int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, begun + size, "right")))
        yield first, texts.slice(first, last - first)
        begun, first = int(ends[last - 1]), last


class Words:
    """Words of a slice: `bytes_`, `starts`, `ends` of each word, and `bounds`, the
    place of each text's first word among all (one entry more than texts). Bytes that
    `gaps` marks are between words."""

    def __init__(self, texts: pa.Array, gaps: np.ndarray = _GAP):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes_ = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        size = len(self.bytes_)
        inside = ~gaps[self.bytes_]
        begins = np.zeros(size + 1, bool)
        begins[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | begins[1:size]
        last[:-1] &= ~inside[1:] | begins[1:size]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self._inside = inside

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        cuts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(cuts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        sums = np.add.reduceat(_BYTE[self.bytes_[self._inside]] * powers[place], cuts)
        return mixed(sums ^ (lengths.astype(np.uint64) * _GOLDEN))

    def text(self, word: int) -> str:
        return self.bytes_[self.starts[word] : self.ends[word]].tobytes().lower().decode()


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, wherever it starts; empty if there is none."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, size, np.uint64) * _GOLDEN
    for k in range(size):
        total += hashes[k : k + count] * _PLACE[k % 64] + np.uint64(k // 64)
    return mixed(total)


def shingle_runs(words: Words, size: int) -> list[np.ndarray]:
    """For each text its shingle hashes in order, repeats included.

    A text of fewer words than `size` has its whole sequence as one; without words, none.
    """
    hashes = words.hashes()
    flat = runs(hashes, size)
    found = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            found.append(flat[a : b - size + 1])
        else:
            found.append(runs(hashes[a:b], b - a) if b > a else flat[:0])
    return found


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    return [distinct(x) for x in shingle_runs(words, size)]


def distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
