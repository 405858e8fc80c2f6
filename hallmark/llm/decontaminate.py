"""Benchmark decontamination: SimHash of item-sized windows, then exact comparison.

An item of L words is compared with every window of L words of every document, by their
multisets of word shingles; both sides have as many. A document of fewer words is one
window as a whole, compared exactly with all longer items by a table of which shingles
stand in which item. A window can only be similar if enough of its shingles occur in
some item, which a table of the items' shingles tells without loss. The windows left get 128-bit
SimHash fingerprints from running sums. Items are found by multi-index Hamming blocks:
fingerprints within the radius agree in one of 6 blocks of 21 or 22 bits up to 4 bits.
Items are posted under all keys within 2 bits of theirs, windows look up all keys within
2 bits of theirs, so none is missed, and about 1 in 50 unrelated items is met. What is
found is confirmed by exact weighted similarity of the multisets.

Repeated shingles weigh more in the fingerprint than in the similarity: two multisets may
be similar and yet at a wide angle. The norms of both bound the angle; where the bound is
wider than the radius is made for, the window is compared exactly by the items' postings.

The items are sent to the tasks in blocks of bounded size, one pass over the documents
for each block, so a benchmark of any size keeps to the workers' memory.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallmark.llm import words as W
from hallmark.llm.tables import settled

SHINGLE = 5
SIMILARITY = (80, 100)
BITS = 128
#: Of multisets without repeats, at similarity 0.8, 19 bits differ, with a deviation of 4.
RADIUS = 29
#: The least cosine that goes by fingerprints: 21 bits differ, 1 pair in 40 is beyond the radius.
COSINE = 0.87
#: Blocks of the fingerprint: with (4 + 1) * 6 > RADIUS, one differs in 4 bits at most.
CUTS = [0, 21, 42, 63, 84, 106, 128]
EACH_SIDE = 2
ITEM_BYTES = 1 << 20
_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """Rows of 128 times +1 or -1 for each shingle hash."""
    both = np.stack((shingles, W.mixed(shingles + np.uint64(1))), axis=1)
    bits = np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash of sums of signs, as 16 bytes a row; a sum of 0 is a 0."""
    return np.packbits(sums > 0, axis=1)


def _masks(width: int) -> np.ndarray:
    """All words of `width` bits with up to EACH_SIDE bits set."""
    sets = (c for k in range(EACH_SIDE + 1) for c in combinations(range(width), k))
    return np.array([sum(1 << x for x in c) for c in sets], np.uint32)


MASKS = [_masks(b - a) for a, b in zip(CUTS, CUTS[1:], strict=False)]


def block_keys(prints: np.ndarray) -> list[np.ndarray]:
    bits = np.unpackbits(prints, axis=1)
    return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.uint32)) for a, b in zip(CUTS, CUTS[1:], strict=False)]


class HammingBlocks:
    """Multi-index of fingerprints: of each block, the rows posted under all near keys."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.posted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for keys, masks in zip(block_keys(prints), MASKS, strict=True):
            near = (keys[:, None] ^ masks).ravel()
            order = np.argsort(near, kind="stable")
            there = np.zeros(1 << int(masks.max()).bit_length(), bool)
            there[near] = True
            self.posted.append((there, near[order], order // len(masks)))

    def met(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item), once each, whose fingerprints are near in some block."""
        pairs = []
        for keys, masks, (there, posted, item) in zip(block_keys(prints), MASKS, self.posted, strict=True):
            values, row_of = np.unique(keys, return_inverse=True)
            probes = (values[:, None] ^ masks).ravel()
            able = np.flatnonzero(there[probes])
            probes = probes[able]
            first = np.searchsorted(posted, probes)
            number = np.searchsorted(posted, probes, "right") - first
            at = np.arange(int(number.sum())) + np.repeat(first - np.cumsum(number) + number, number)
            value = np.repeat(able // len(masks), number)
            codes = np.unique(value * len(self.prints) + item[at])
            # Rows of equal keys meet the same items.
            start = np.searchsorted(codes, np.arange(len(values)) * len(self.prints))
            many = np.searchsorted(codes, (np.arange(len(values)) + 1) * len(self.prints)) - start
            each = many[row_of]
            rows = np.repeat(np.arange(len(prints)), each)
            take = np.arange(len(rows)) + np.repeat(start[row_of] - np.cumsum(each) + each, each)
            pairs.append(rows * len(self.prints) + codes[take] % len(self.prints))
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return both // len(self.prints), both % len(self.prints)

    def within(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of fingerprints within the radius."""
        rows, items = self.met(prints)
        close = _ONES[prints[rows] ^ self.prints[items]].sum(axis=1, dtype=np.int64) <= radius
        return rows[close], items[close]


@dataclass
class Item:
    item_id: int
    words: int
    size: int  # of its shingles, in words
    shingles: np.ndarray
    counts: np.ndarray


class ItemIndex:
    """A block of items: their shingles, fingerprints and Hamming blocks."""

    def __init__(self, items: list[tuple[int, str]], size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY):
        words = W.Words(pa.array([t for _, t in items], pa.large_string()))
        hashes = words.hashes()
        self.items: list[Item] = []
        prints = []
        for k, (item_id, _) in enumerate(items):
            own = hashes[words.bounds[k] : words.bounds[k + 1]]
            if len(own):
                width = min(size, len(own))
                flat = W.runs(own, width)
                self.items.append(Item(item_id, len(own), width, *np.unique(flat, return_counts=True)))
                prints.append(_signs(flat).sum(axis=0))
        self.prints = fingerprints(np.array(prints).reshape(-1, BITS))
        self.norms = np.array([_widest(item.counts, similarity) for item in self.items])
        self.by_words: dict[tuple[int, int], np.ndarray] = {}
        for k, item in enumerate(self.items):
            self.by_words.setdefault((item.words, item.size), []).append(k)  # type: ignore[arg-type]
        self.by_words = {k: np.array(v) for k, v in self.by_words.items()}
        self.sizes = sorted({item.size for item in self.items})
        self.known = {
            s: W.distinct(np.concatenate([i.shingles for i in self.items if i.size == s])) for s in self.sizes
        }
        self.slots = {s: _slots(x) for s, x in self.known.items()}
        self.spans = np.array([item.words - item.size + 1 for item in self.items], np.int64)
        self.postings = {s: self._postings(s) for s in self.sizes}
        # Items of a length without a useful fingerprint; the others' multi-index, by shingle size;
        # the largest squared norm of a window that fingerprints are good for.
        useful = self.norms >= self.spans
        self.wide = {k: v[~useful[v]] for k, v in self.by_words.items()}
        self.norm = {k: float(self.norms[v[useful[v]]].min(initial=np.inf)) for k, v in self.by_words.items()}
        self.able = {s: np.array([k for k, item in enumerate(self.items) if item.size == s and useful[k]], np.int64) for s in self.sizes}
        self.blocks = {s: HammingBlocks(self.prints[k]) for s, k in self.able.items()}

    def _postings(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, ascending, with the item that each stands in and how often."""
        own = [k for k, item in enumerate(self.items) if item.size == size]
        shingles = np.concatenate([self.items[k].shingles for k in own])
        order = np.argsort(shingles, kind="stable")
        item = np.repeat(np.array(own), [len(self.items[k].shingles) for k in own])
        return shingles[order], item[order], np.concatenate([self.items[k].counts for k in own])[order]

    def shared(self, flat: np.ndarray, size: int) -> np.ndarray:
        """Shared weight of a text's shingles and each item, exactly."""
        shingles, item, counts = self.postings[size]
        values, often = np.unique(flat, return_counts=True)
        first = np.searchsorted(shingles, values)
        number = np.searchsorted(shingles, values, "right") - first
        at = np.arange(int(number.sum())) + np.repeat(first - np.cumsum(number) + number, number)
        both = np.minimum(counts[at], np.repeat(often, number))
        return np.bincount(item[at], both, len(self.items)).astype(np.int64)

    def holds(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Which shingles occur in some item."""
        found = self.slots[size][(shingles >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(found)
        found[at] = _within(shingles[at], self.known[size])
        return found


def _widest(counts: np.ndarray, similarity: tuple[int, int]) -> float:
    """Squared norm up to which a similar window is within the angle of COSINE.

    A similar window shares `least` of the weight. What is shared has a product of at
    least the sum of its squared counts, which is smallest if the heaviest counts lose.
    """
    many, of = similarity
    total = int(counts.sum())
    least = -(-2 * many * total // (many + of))
    # Counts above the level t are cut to it: the sum of min(count, t) must reach `least`.
    t = 1 + bisect_left(range(1, int(counts.max()) + 1), least, key=lambda t: int(np.minimum(counts, t).sum()))
    cut = np.minimum(counts, t)
    over = int(cut.sum()) - least  # so many more counts of t lose one
    product = int((cut * cut).sum()) - over * (2 * t - 1)
    return (product / COSINE) ** 2 / float((counts * counts).sum())


def _slots(values: np.ndarray) -> np.ndarray:
    """Whether some value has the top 20 bits."""
    slots = np.zeros(1 << 20, bool)
    slots[(values >> np.uint64(44)).astype(np.int64)] = True
    return slots


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def similarity_of(item: Item, shingles: np.ndarray) -> tuple[int, int]:
    """Shared weight and joint weight of an item and a window's shingles."""
    values, counts = np.unique(shingles, return_counts=True)
    at = np.searchsorted(item.shingles, values)
    at[at == len(item.shingles)] = 0
    same = item.shingles[at] == values
    shared = int(np.minimum(item.counts[at[same]], counts[same]).sum())
    return shared, int(item.counts.sum()) + len(shingles) - shared


def matches(index: ItemIndex, texts: pa.Array, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int, int, int, int, float]]:
    """(row, item_id, start, words, windows, similarity) of each text and similar item.

    `start` is the first word of the most similar window, the earliest of equal ones;
    `words` how many it has; `windows` how many windows are similar.
    """
    many, of = similarity
    words = W.Words(texts)
    hashes = words.hashes()
    found: list[tuple[int, int, int, int, int, float]] = []
    for size in index.sizes:
        flat = W.runs(hashes, size)
        hits = index.holds(flat, size)
        if not hits.any():
            continue
        # Runs that reach over the end of a text belong to none.
        last = words.bounds[1:] - size
        hit_at = np.flatnonzero(hits)
        row_of = np.searchsorted(words.bounds, hit_at, "right") - 1
        for row in np.unique(row_of[hit_at <= last[row_of]]).tolist():
            a, b = int(words.bounds[row]), int(words.bounds[row + 1])
            found += _in_text(index, size, row, flat[a : b - size + 1], hits[a : b - size + 1], many, of)
    return found


def _in_text(index: ItemIndex, size: int, row_of: int, flat: np.ndarray, hits: np.ndarray, many: int, of: int) -> list[tuple[int, int, int, int, int, float]]:
    found = []
    total = np.concatenate(([0], np.cumsum(hits)))
    # Longer items meet the whole text: shared / (span + text - shared) must reach the similarity.
    least = min((length - width + 1 for length, width in index.by_words if width == size and length - width + 1 > len(flat)), default=0)
    if least and (many + of) * int(total[-1]) >= many * (least + len(flat)):
        both = index.shared(flat, size)
        joint = index.spans + len(flat) - both
        for k in np.flatnonzero((both > 0) & (index.spans > len(flat)) & (of * both >= many * joint)).tolist():
            found.append((row_of, index.items[k].item_id, 0, len(flat) + size - 1, 1, int(both[k]) / int(joint[k])))
    best: dict[int, tuple[float, int, int]] = {}

    def seen(k_item: int, start: int, both: int) -> None:
        span = int(index.spans[k_item])
        if of * both >= many * (2 * span - both):
            old, where, windows = best.get(k_item, (-1.0, 0, 0))
            value = both / (2 * span - both)
            better = (-value, start) < (-old, where)
            best[k_item] = (value, start, windows + 1) if better else (old, where, windows + 1)

    able, queued = index.able[size], []
    for length, width in index.by_words:
        span = length - width + 1
        if width != size or span > len(flat):
            continue
        # shared / (2 * span - shared) must reach the similarity.
        shared = total[span:] - total[:-span]
        starts = np.flatnonzero((many + of) * shared >= 2 * many * span)
        if not len(starts):
            continue
        wide, norm = index.wide[length, width], index.norm[length, width]
        loose = _norms(flat, starts, span) > norm
        if norm < np.inf:
            queued += [(span, part) for part in np.split(starts[~loose], range(2048, int((~loose).sum()), 2048)) if len(part)]
        # Windows and items whose repeats allow a wide angle are compared exactly.
        last, both = -2, np.zeros(0, np.int64)
        for start, free in zip(starts.tolist(), loose.tolist(), strict=True):
            if free or len(wide):
                if last != start - 1 or flat[last] != flat[last + span]:
                    both = index.shared(flat[start : start + span], size)
                last = start
                among = index.by_words[length, width] if free else wide
                for k_item in among[of * both[among] >= many * (2 * span - both[among])].tolist():
                    seen(k_item, start, int(both[k_item]))
    # Windows of all lengths are looked up together, a few thousand at a time.
    while queued:
        parts, held = [], 0
        while queued and held < 4096:
            parts.append(queued.pop(0))
            held += len(parts[-1][1])
        spans = np.concatenate([np.full(len(part), span) for span, part in parts])
        begins = np.concatenate([part for _, part in parts])
        rows, items = index.blocks[size].within(np.concatenate([_prints(flat, part, span) for span, part in parts]))
        same = index.spans[able[items]] == spans[rows]
        for row, k_item in zip(rows[same].tolist(), able[items[same]].tolist(), strict=True):
            start, span = int(begins[row]), int(spans[row])
            seen(k_item, start, similarity_of(index.items[k_item], flat[start : start + span])[0])
    return found + [(row_of, index.items[k].item_id, s, int(index.items[k].words), n, v) for k, (v, s, n) in best.items()]


def _prints(flat: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Fingerprints of the windows at `starts`."""
    first, end = int(starts[0]), int(starts[-1]) + span
    sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(_signs(flat[first:end]), axis=0)))
    return fingerprints(sums[starts - first + span] - sums[starts - first])


def _norms(flat: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Squared norms of the counts of the windows at `starts`."""
    order = np.argsort(flat, kind="stable")
    again = np.zeros(len(flat) + 1, np.int64)
    same = flat[order[1:]] == flat[order[:-1]]
    again[1 + order[1:][same]] = (order[1:] - order[:-1])[same] < span
    again = np.cumsum(again)
    norms = np.full(len(starts), span, np.int64)
    last, old = -2, 0
    for k in np.flatnonzero(again[starts + span] - again[starts]).tolist():
        start = int(starts[k])
        if last != start - 1 or flat[last] != flat[last + span]:
            old = int((np.unique(flat[start : start + span], return_counts=True)[1] ** 2).sum())
        norms[k], last = old, start
    return norms


def item_blocks(items: DataFrame, size: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of bounded text; null and empty ones are left out."""
    block, held = [], 0
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in rows.toLocalIterator():
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += len(text)
    if block:
        yield block


FOUND = "doc_id long, item_id long, start long, n_words long, n_windows long, similarity double"


def contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, n_windows, similarity): items that documents hold.

    One row for each row of `docs` and item of which it has a similar window: its first
    word (from 0), its words, how many windows are similar, and the best similarity. A
    text of fewer words than an item is one window as a whole.
    Pairs of windows and items at the very threshold may be missed by their fingerprints,
    1 in 40 at most; repeated shingles raise that by nothing.
    Texts and items that are null or have no words match nothing; items of fewer words
    than a shingle are matched as whole sequences; repeated documents and items are
    reported as often. Only doc_id, item_id and the texts are read.
    """
    settled(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], FOUND)
    for block in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, size, similarity)
            for batch in batches:
                for first, texts in W.slices(batch.column(1)):
                    out = matches(index, texts, similarity)
                    ids = batch.column(0).slice(first, len(texts)).take(pa.array([x[0] for x in out], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, *[pa.array([x[k] for x in out], pa.int64()) for k in range(1, 5)], pa.array([x[5] for x in out], pa.float64())],
                        names=["doc_id", "item_id", "start", "n_words", "n_windows", "similarity"],
                    )

        found = found.union(rows.mapInArrow(run, FOUND))
    return found


def without_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of `docs` that hold no item, with all columns.

    Rows whose text is null or has no words stay; repeated rows stay or go together.
    """
    settled(docs.sparkSession)
    at = docs.columns.index("text")
    for block in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, size, similarity)
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for first, texts in W.slices(batch.column(at)):
                    clean[[first + x[0] for x in matches(index, texts, similarity)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
