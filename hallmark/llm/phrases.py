"""Phrase collocations by Toivonen's sampling method.

A sample of the texts proposes phrases that look frequent. One pass over all texts then
counts these proposals and their negative border exactly: every word, every pair of
proposed words, every triple whose two pairs are proposed. A phrase of the border that
turns out frequent was missed by the sample; it joins the proposals, and a further pass
counts only what this adds to the border. When a pass finds no such phrase, every
frequent phrase has been counted: all parts of a frequent phrase are frequent.

The tasks know the proposals as a Bloom filter of fixed size, whatever the corpus. A
phrase that passes it by chance is counted for nothing; none is lost. Proposals are
counted by their text, the border by hashes, which only decide what is counted by its
text in the next pass: two phrases of one hash can cost a pass, but no count. Every task
adds up its own counts before the shuffle, so a phrase in very many texts is one entry a
task there. Hashes are cut into buckets of a few megabytes of text each; a task sends the sorted
hashes of a bucket as one packed value, and a bucket is added up by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hallmark.llm import words as W
from hallmark.llm.tables import settled, step

LONGEST = 3
SUPPORT = 10
TOP = 2000
#: One document in so many makes proposals, phrases that it holds twice or more.
SAMPLED = 8
SAMPLE_SUPPORT = 2
#: 64-bit words of the filter: 16 MB in every worker.
FILTER_WORDS = 1 << 21
#: Hashes, and phrases with their texts, that a task gathers before it sends their counts on.
HELD_HASHES = 4_000_000
HELD_PHRASES = 300_000
#: Bytes of text for each bucket of hashes, which have 32 bits besides the bucket's number.
BUCKET_BYTES = 1 << 20
NO_LANGUAGE = "und"

# fixed values: what ends a piece, and what else stands between words
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True

_rng = np.random.default_rng(11)
_PLACES = _rng.integers(0, 1 << 63, LONGEST + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# where a hash holds the places of its bits in a word of the filter
_BITS = (40, 46, 52, 58)
SENT = "bucket long, ones binary, more binary, counts binary, k int, lang string, phrase string, n long"
COUNTS = "k int, lang string, h long, phrase string, n long"


class Proposals:
    """Bloom filter of phrase hashes: four bits of one 64-bit word for each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        wanted = np.zeros(len(hashes), np.uint64)
        hashes = W.mixed(hashes)
        for shift in _BITS:
            wanted |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        held = self.words[(hashes & np.uint64(len(self.words) - 1)).astype(np.int64)]
        return (held & wanted) == wanted

    def __or__(self, other: Proposals) -> Proposals:
        return Proposals(self.words | other.words)


def proposals(hashes: DataFrame, size: int = FILTER_WORDS) -> Proposals:
    """Filter of the column `h`, scrambled short hashes; at most `size` words come to the driver."""
    h = F.col("h")
    one = F.lit(1).cast("long")
    mask: Column = F.lit(0).cast("long")
    for shift in _BITS:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, at))
    rows = hashes.groupBy(h.bitwiseAND(size - 1).alias("slot")).agg(F.bit_or(mask).alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Proposals(words)


@lru_cache(maxsize=1000)
def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class Phrases:
    """Phrases of a few texts: for each length their hashes at each word they begin at.

    `begins[k]` are the words at which a phrase of k + 1 words within one piece begins,
    `hashes[k]` their hashes, which differ by language and length, `short[k]` the first
    `bits` of these, `fresh[k]` those that the text's last window did not hold.
    """

    def __init__(self, texts: pa.Array, languages: np.ndarray, repeated: int = 0, bits: int = 32):
        self.words = words = W.Words(texts, _GAPS)
        count = len(words.starts)
        single = words.hashes()
        of_text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        self.text = of_text
        pieces = np.cumsum(_ENDS[words.bytes_], dtype=np.int64)[words.starts] if count else np.zeros(0, np.int64)
        joined = np.zeros(count, bool)
        joined[:-1] = (pieces[1:] == pieces[:-1]) & (of_text[1:] == of_text[:-1])
        language = languages[of_text]
        self.begins, self.hashes, self.short, self.fresh = [], [], [], []
        whole = np.ones(count, bool)
        total = language * _PLACES[-1]
        for k in range(LONGEST):
            if k:
                whole = whole.copy()
                whole[count - k :] = False
                whole[: count - k] &= joined[k - 1 : count - 1]
            total = total.copy()
            total[: count - k] += single[k:] * _PLACES[k]
            at = np.flatnonzero(whole)
            self.begins.append(at)
            self.fresh.append(at >= repeated - k)
            self.hashes.append(W.mixed(total[at] + np.uint64(k)))
            self.short.append(self.hashes[k] >> np.uint64(64 - bits))

    def phrase(self, begin: int, k: int) -> str:
        return " ".join(self.words.text(begin + i) for i in range(k + 1))

    def layers(self, proposed: Proposals | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: which phrases are counted, and which of them are proposed."""
        found = []
        below = np.zeros(len(self.words.starts) + 1, bool)
        for k, (at, hashes) in enumerate(zip(self.begins, self.short, strict=True)):
            if proposed is None:
                counted = known = np.zeros(len(at), bool)
            else:
                counted = below[at] & below[at + 1] if k else np.ones(len(at), bool)
                known = np.zeros(len(at), bool)
                known[counted] = proposed.holds(hashes[counted])
            found.append((counted, known))
            below = np.zeros_like(below)
            below[at[known]] = True
        return found


def _windows(texts: pa.Array, size: int = W.SLICE_BYTES) -> Iterator[tuple[int, pa.Array, int]]:
    """(first row, texts, repeated): slices of texts, and windows of a text of more than
    `size` bytes; each but the first repeats the last `repeated` words of the one before."""
    for first, part in W.slices(texts, size):
        data = part[0].as_buffer() if len(part) == 1 else None
        if data is None or data.size <= size:
            yield first, part, 0
            continue
        whole = np.frombuffer(data, np.uint8)
        begin, repeated, reach = 0, 0, size
        while True:
            end = begin + reach
            if end < len(whole):
                gaps = np.flatnonzero(_GAPS[whole[end : end + reach]])
                end += int(gaps[0]) if len(gaps) else 0
                inside = ~_GAPS[whole[begin:end]]
                starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
                if not len(gaps) or len(starts) < LONGEST:
                    reach *= 2
                    continue
            yield first, pa.array([bytes(whole[begin:end]).decode()], pa.large_string()), repeated
            if end >= len(whole):
                break
            repeated, reach = LONGEST - 1, size
            begin += int(starts[-repeated])


class _Counts:
    """Counts that a task adds up before it sends them on."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.hashes: list[np.ndarray] = []
        self.size = 0
        self.phrases: dict[int, list] = {}
        self.totals: dict[str, int] = {}

    def of_border(self, short: np.ndarray) -> None:
        self.hashes.append(short)
        self.size += len(short)

    def of_phrases(self, found: Phrases, k: int, chosen: np.ndarray, names: list[str]) -> None:
        hashes, first, counts = np.unique(found.hashes[k][chosen], return_index=True, return_counts=True)
        begins = found.begins[k][chosen][first]
        for h, begin, n in zip(hashes.tolist(), begins.tolist(), counts.tolist(), strict=True):
            held = self.phrases.get(h)
            if held is None:
                self.phrases[h] = [k + 1, names[found.text[begin]], found.phrase(begin, k), n]
            else:
                held[3] += n

    def border_rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            hashes = np.sort(np.concatenate(self.hashes))
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            counts = np.diff(np.append(first, len(hashes)))
            hashes = hashes[first]
            buckets = hashes >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True):
                low, n = (hashes[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts[a:b]
                rows.append((int(buckets[a]), _packed(low[n == 1]), _packed(low[n > 1]), n[n > 1].astype("<u4").tobytes()))
                if len(rows) == 4096:
                    yield _sent(*zip(*rows, strict=True))
                    rows = []
            if rows:
                yield _sent(*zip(*rows, strict=True))
        self.hashes, self.size = [], 0

    def phrase_rows(self) -> Iterator[pa.RecordBatch]:
        rows = list(self.phrases.items())
        for k in range(0, len(rows), 1 << 15):
            part = rows[k : k + (1 << 15)]
            buckets = [h >> (64 - self.bits + 32) if self.bits > 32 else 0 for h, _ in part]
            yield _sent(buckets, None, None, None, *zip(*[held for _, held in part], strict=True))
        if self.totals:
            names = list(self.totals)
            yield _sent([0] * len(names), None, None, None, [0] * len(names), names, [""] * len(names), list(self.totals.values()))
        self.phrases, self.totals = {}, {}


def _packed(ascending: np.ndarray) -> bytes:
    """Steps between 32-bit numbers, first all lowest bytes, then the next: the shuffle's
    compression takes the high ones away."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.uint64)


def _sent(bucket, ones=None, more=None, counts=None, k=None, lang=None, phrase=None, n=None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    columns = [bucket, ones, more, counts, k, lang, phrase, n]
    size = len(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, kind) if c is None else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
        names=[field.split()[0] for field in SENT.split(", ")],
    )


def counted(texts: DataFrame, now: Proposals | None, before: Proposals | None, support: int, bits: int) -> DataFrame:
    """Counts (k, lang, h, phrase, n) that are new with the proposals `now` after `before`.

    Proposals come with their text, the border by hashes alone (k, lang, phrase null);
    k = 0 is the number of all words. Only counts of at least `support` stay. Without
    `now` every phrase is counted by its hash.
    """
    spark = texts.sparkSession
    sent = [spark.sparkContext.broadcast(x.words) if x else None for x in (now, before)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = [Proposals(x.value) if x else None for x in sent]
        counts = _Counts(bits)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, part, repeated in _windows(batch.column(1)):
                own = names[first : first + len(part)]
                found = Phrases(part, np.array([_language(x) for x in own], np.uint64), repeated, bits)
                if new is None:
                    for short, fresh in zip(found.short, found.fresh, strict=True):
                        counts.of_border(short[fresh])
                else:
                    _add(counts, found, own, new, old, repeated)
                if counts.size > HELD_HASHES:
                    yield from counts.border_rows()
                if len(counts.phrases) > HELD_PHRASES:
                    yield from counts.phrase_rows()
        yield from counts.border_rows()
        yield from counts.phrase_rows()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if first == end:
                    continue
                if held and held[0].column(0)[0].as_py() != buckets[first]:
                    yield from _added_up(pa.Table.from_batches(held), support)
                    held = []
                held.append(batch.slice(first, end - first))
        if held:
            yield from _added_up(pa.Table.from_batches(held), support)

    return texts.mapInArrow(count, SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, COUNTS)


def _added_up(rows: pa.Table, support: int) -> Iterator[pa.RecordBatch]:
    """Counts of one bucket."""
    of_phrases = pc.is_null(rows.column("ones"))
    border, texts = rows.filter(pc.invert(of_phrases)), rows.filter(of_phrases)
    hashes, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for packed in zip(*[border.column(n).to_pylist() for n in ("ones", "more", "counts")], strict=True):
        ones, more = _unpacked(packed[0]), _unpacked(packed[1])
        hashes += [ones, more]
        weights += [np.ones(len(ones), np.int64), np.frombuffer(packed[2], "<u4").astype(np.int64)]
    kinds, of = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(of, np.concatenate(weights), len(kinds)).astype(np.int64)
    often = counts >= support
    bucket = rows.column("bucket")[0].as_py()
    kinds = W.mixed(kinds[often] | np.uint64(bucket << 32)).view(np.int64)
    nothing = pa.nulls(len(kinds), pa.string())
    yield _counted(pa.nulls(len(kinds), pa.int32()), nothing, pa.array(kinds), nothing, pa.array(counts[often]))
    sums = texts.group_by(["k", "lang", "phrase"]).aggregate([("n", "sum")])
    sums = sums.filter(pc.or_(pc.greater_equal(sums.column("n_sum"), support), pc.equal(sums.column("k"), 0)))
    k, lang, phrase, n = [sums.column(x).combine_chunks() for x in ("k", "lang", "phrase", "n_sum")]
    yield _counted(k, lang, pa.nulls(len(sums), pa.int64()), phrase, n)


def _counted(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["k", "lang", "h", "phrase", "n"])


def _add(counts: _Counts, found: Phrases, names: list[str], new: Proposals, old: Proposals | None, repeated: int) -> None:
    if old is None:
        for name, words in zip(names, np.diff(found.words.bounds).tolist(), strict=True):
            counts.totals[name] = counts.totals.get(name, 0) + words - repeated
    for k, (now, then) in enumerate(zip(found.layers(new), found.layers(old), strict=True)):
        by_text = found.fresh[k] & now[1] & ~then[1]
        by_hash = found.fresh[k] & now[0] & ~now[1] & ~then[0]
        counts.of_border(found.short[k][by_hash])
        if by_text.any():
            counts.of_phrases(found, k, np.flatnonzero(by_text), names)


def frequent(
    docs: DataFrame, support: int = SUPPORT, sampled: int = SAMPLED, filter_words: int = FILTER_WORDS
) -> DataFrame:
    """(k, lang, phrase, n): exact counts of all phrases of up to three words that occur
    `support` times or more in their language, and of all its words (k = 0).

    Texts are split and lower-cased as `collocations` says. `sampled` sets how many
    documents propose; it changes the number of passes, never the result.
    """
    spark: SparkSession = settled(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(sampled)) == 0)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 32 + min(31, (size // BUCKET_BYTES).bit_length())
    now = proposals(counted(sample, None, None, SAMPLE_SUPPORT, bits), filter_words)
    before: Proposals | None = None
    passes: list[DataFrame] = []
    while True:
        counts = step(counted(texts, now, before, support, bits))
        passes.append(counts.where("k is not null"))
        failures = counts.where("k is null")
        if failures.isEmpty():
            break
        before, now = now, now | proposals(failures, filter_words)
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    return found.select("k", "lang", "phrase", "n")


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    top: int = TOP,
    sampled: int = SAMPLED,
    filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 and 3 words.

    A-Z is lower-cased. A text is split at `.,;:!?` and line breaks (0x0A-0x0D) into
    pieces and these at spaces and tabs into words; phrases lie within a piece. `n` counts
    all words of the language, `a` the phrase, `l` and `r` the first part and the rest at
    the cut with the lowest score floor(1000000 a a / (l r)); of equal scores the first
    cut counts. Phrases of fewer than `support` occurrences are no candidates; one that
    lies in a longer candidate with at least half its count is left out. `rank` goes by
    score, then `a`, both descending, then the phrase by UTF-8 bytes, up to `top`.

    A null language is `und`; null and empty texts have no words; repeated rows count as
    often as they stand there; other columns than lang and text are not read. A language
    without candidates has no row. Counts up to 10^15 are multiplied exactly.
    """
    found = step(frequent(docs, support, sampled, filter_words))
    counts = found.where("k between 1 and 2").select("lang", "phrase", "n")
    candidates = found.where("k > 1").select("k", "lang", "phrase", F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    cuts = candidates.select(
        "k", "lang", "phrase", "a", parts.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("_w", F.col("cut") + 1, F.col("k")), " ").alias("rest"),
    )
    exact = {x: F.col(x).cast("decimal(16,0)") for x in ("a", "l", "r")}
    score = F.expr("cast(1000000 as decimal(7,0)) * (x * x) div (y * z)")
    scored = (
        cuts.join(counts.selectExpr("lang", "phrase as first", "n as l"), ["lang", "first"])
        .join(counts.selectExpr("lang", "phrase as rest", "n as r"), ["lang", "rest"])
        .select("lang", "phrase", "a", "cut", "l", "r", exact["a"].alias("x"), exact["l"].alias("y"), exact["r"].alias("z"))
        .select("lang", "phrase", "a", "cut", "l", "r", score.cast("long").alias("score"))
        .groupBy("lang", "phrase")
        .agg(F.min("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    )
    inner = F.explode(F.array(*[F.array_join(F.slice(parts, k, 2), " ") for k in (1, 2)])).alias("phrase")
    longer = candidates.where("k = 3").select("lang", "a", inner).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("within is null or 100 * within < 50 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )
