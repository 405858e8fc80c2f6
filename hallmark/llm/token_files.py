"""Token ids of a corpus in compressed files, readable from any place.

Documents are dealt by ranges of doc_id; each task encodes its texts, one after the
other, and cuts their ids into shards of a million. A shard is one binary record: a
header, the documents whose ids it holds, and a Re-Pair grammar of the ids
(`hallmark.llm.grammar`), whose rules know how many ids they derive, so that any run of
ids is found and expanded alone. Records lie in Parquet files, written by Spark's own
committer: a lost task leaves nothing behind. A document may go on in the next shards.

    magic "HTOK", then uint32: version, base, documents, rules, rounds, symbols, and the
    bytes of a symbol; of each document int64 doc_id, uint8 null, int64 ids in
    earlier shards, uint32 ids here; of each rule 2 x uint32 symbols, uint32 ids
    it derives; of each round uint32 rules until then; the symbols. Little-endian.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hallmark.llm import words as W
from hallmark.llm.grammar import Grammar, compressed, spread
from hallmark.llm.tables import settled

SHARD_IDS = 1 << 20
END = 0
#: Pieces that a worker remembers between slices of texts, and the characters of them all.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 24 << 20
ENCODED_AT_ONCE = 10_000
SLICE = 8 << 20
_HEAD = struct.Struct("<4s7I")
_VERSION = 1
FILES = (
    "part int, shard int, first_document long, first_id long, n_ids long, "
    "low_doc long, high_doc long, body binary"
)

_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14), *range(28, 32)]] = True
_KIND = np.zeros(256, np.int8)
_KIND[[*range(48, 58)]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2


def _cuts(data: np.ndarray) -> np.ndarray:
    """True where the vocabulary's splitting always cuts, so that both sides can be encoded apart.

    That is before a space that follows no white space, and between a letter or digit and
    another kind of ASCII character, but not before a bar, which special tokens hold. Of letters
    beyond ASCII only those of two bytes (U+00C0 to U+07FF) are known not to be white space.
    """
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    last, next_ = data[:-1], data[1:]
    plain = (last < 0x80) & ~_SPACES[last]
    plain[1:] |= (last[1:] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    cut[1:] = (next_ == 32) & plain
    cut[1:] |= (_KIND[last] > 0) & (_KIND[next_] != _KIND[last]) & (next_ < 0x80) & (next_ != 124)
    return cut


class Encoder:
    """Ids of texts as the `tokenizers` library gives them.

    Texts are cut into pieces that do not touch each other; the library encodes each
    piece that is new, and the others are looked up. A piece without a place to cut is encoded in
    one call, whatever its size.
    """

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.base = self.library.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, int] = {}
        self.chars = 0
        # piece 0 is the end of a document
        self.flat = np.full(1 << 16, end, np.uint32)
        self.used = 1
        self.begins, self.sizes, self.last = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)
        self.slice = 0

    def _forget(self) -> None:
        """Drop the half of the pieces that were used the longest ago."""
        kept = self.last > np.median(self.last[1:])
        kept[0] = True
        pieces = [x for x, slot in self.known.items() if kept[slot]]
        slots = np.array([0, *[self.known[x] for x in pieces]], np.int64)
        flat, sizes = self._ids(slots), self.sizes[slots]
        self.flat, self.used = flat.copy(), len(flat)
        self.begins, self.sizes, self.last = np.cumsum(sizes) - sizes, sizes, self.last[slots]
        self.known = dict(zip(pieces, range(1, len(slots)), strict=True))
        self.chars = sum(map(len, pieces))

    def _learn(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), ENCODED_AT_ONCE):
            part = pieces[k : k + ENCODED_AT_ONCE]
            ids = [x.ids for x in self.library.encode_batch(part, add_special_tokens=False)]
            sizes = np.array([len(x) for x in ids], np.int64)
            total = int(sizes.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(max(total, len(self.flat)), np.uint32)))
            self.flat[self.used : self.used + total] = list(chain.from_iterable(ids))
            first = len(self.sizes)
            self.begins = np.concatenate((self.begins, self.used + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.last = np.concatenate((self.last, np.zeros(len(part), np.int64)))
            self.used += total
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
            self.chars += sum(map(len, part))

    def _slots(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Number of each piece of `data`, which begin at `begins`."""
        ends = np.append(begins, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        self._learn([x for x in kinds if x not in self.known])
        slot = np.array([self.known[x] for x in kinds], np.int64)
        self.slice += 1
        self.last[slot] = self.slice
        return slot[coded.indices.to_numpy()] if len(begins) else slot

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.begins[slots], self.sizes[slots])]

    def stream(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, ids, ended): each text's ids, in several pieces if it is long, and the end id."""
        for first, part in W.slices(texts, SLICE):
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset :][: len(part) + 1]
            whole = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            if len(part) == 1 and len(whole) > SLICE:
                for data, ended in _windows(whole):
                    cuts = _cuts(data)
                    cuts[0] = True
                    slots = self._slots(data, np.flatnonzero(cuts))
                    yield first, self._ids(np.append(slots, 0) if ended else slots), ended
                continue
            offsets = offsets - offsets[0]
            cuts = _cuts(whole)
            cuts[offsets[:-1][np.diff(offsets) > 0]] = True
            begins = np.flatnonzero(cuts)
            slots = self._slots(whole, begins)
            texts_end = np.searchsorted(begins, offsets[1:])
            slots = np.insert(slots, texts_end, 0)
            ids = self._ids(slots)
            ends = np.cumsum(self.sizes[slots])[texts_end + np.arange(len(part))]
            for row, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                yield first + row, ids[a:b], True


@lru_cache(maxsize=1)
def _encoder(path: str, end: int) -> Encoder:
    """One for all tasks of a worker: it remembers pieces."""
    return Encoder(path, end)


def _windows(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    begin, reach = 0, SLICE
    while begin < len(data):
        part = data[begin : begin + reach]
        if begin + reach < len(data):
            cuts = np.flatnonzero(_cuts(part))
            if not len(cuts):
                reach *= 2
                continue
            part = part[: int(cuts[-1])]
        begin, reach = begin + len(part), SLICE
        yield part, begin >= len(data)


class Shards:
    """Ids of documents, gathered and cut into records."""

    def __init__(self, part: int, base: int, size: int = SHARD_IDS):
        self.part, self.base, self.size = part, base, size
        self.shard = self.first_id = self.document = 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.entries: list[tuple[int | None, int, int]] = []
        self.held, self.first_document = 0, self.document

    def add(self, doc_id: int | None, before: int, ids: np.ndarray, ended: bool) -> Iterator[tuple]:
        """Take ids of one document, of which `before` were taken already."""
        while len(ids):
            part = ids[: self.size - self.held]
            if self.entries and before and self._open:
                _, begun, n = self.entries[-1]
                self.entries[-1] = (doc_id, begun, n + len(part))
            else:
                self.entries.append((doc_id, before, len(part)))
            self._open = True
            self.ids.append(part)
            self.held += len(part)
            before, ids = before + len(part), ids[len(part) :]
            if self.held == self.size and (len(ids) or not ended):
                yield from self.record()
        if ended:
            self._open = False
            self.document += 1
            if self.held == self.size:
                yield from self.record()

    def record(self) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        named = [d for d, _, _ in self.entries if d is not None]
        low, high = (min(named), max(named)) if named else (None, None)
        yield (
            self.part, self.shard, self.first_document, self.first_id, len(ids), low, high,
            packed(self.entries, compressed(ids, self.base)),
        )
        self.shard += 1
        self.first_id += len(ids)
        self._clear()

    _open = False


def packed(entries: list[tuple[int | None, int, int]], grammar: Grammar) -> bytes:
    highest = grammar.base + len(grammar.rules)
    symbol = "<u2" if highest <= 1 << 16 else "<u4"
    head = _HEAD.pack(
        b"HTOK", _VERSION, grammar.base, len(entries), len(grammar.rules), len(grammar.rounds), len(grammar.symbols), int(symbol[2])
    )
    ids, before, here = zip(*entries, strict=True)
    arrays = [
        np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], "u1"), np.array(before, "<i8"),
        np.array(here, "<u4"), grammar.rules.astype("<u4"), grammar.lengths.astype("<u4"), grammar.rounds.astype("<u4"),
        grammar.symbols.astype(symbol),
    ]
    return head + b"".join(x.tobytes() for x in arrays)


@dataclass
class Shard:
    doc_ids: np.ndarray
    null: np.ndarray
    before: np.ndarray
    here: np.ndarray
    grammar: Grammar

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.here) - self.here


def unpacked(body: bytes) -> Shard:
    magic, version, base, docs, rules, rounds, symbols, width = _HEAD.unpack_from(body)
    if magic != b"HTOK" or version != _VERSION:
        raise ValueError("not a shard of token ids")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(body, kind, count, at)
        at += found.nbytes
        return found

    doc_ids, null, before = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs)
    here = take("<u4", docs).astype(np.int64)
    pairs, lengths = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64), take("<u4", rules).astype(np.int64)
    until = take("<u4", rounds).astype(np.int64)
    return Shard(doc_ids, null, before, here, Grammar(base, take(f"<u{width}", symbols).astype(np.int64), pairs, lengths, until))


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode the texts of `docs` into shard records under `path`, in ascending doc_id order.

    Each document's ids are those of the whole text, then `end`. A null doc_id goes first;
    rows that share a doc_id go by their text's hash, then their text; null texts are empty; other columns
    are not read. A doc_id in very many rows is dealt by its texts' hashes; equal rows
    meet in one task, which holds one shard at a time.
    """
    settled(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("_hash", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end)
        shards = Shards(TaskContext.get().partitionId(), encoder.base, shard_ids)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            row, before = -1, 0
            for k, ids, ended in encoder.stream(batch.column(1)):
                before = before if k == row else 0
                for record in shards.add(doc_ids[k], before, ids, ended):
                    yield _record(record)
                row, before = k, before + len(ids)
        for record in shards.record():
            yield _record(record)

    (
        rows.repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
        .mapInArrow(encode, FILES)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _record(values: tuple) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [field.split()[0] for field in FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """(part, base): ids of all parts before; one row for each file."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    return sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("base"))


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, before, ids): the ids of the documents low..high, a row for each shard
    that a document lies in; `before` of its ids are in earlier shards.

    Files and records of other documents are skipped by their statistics, and of a record only the
    symbols that derive the wanted ids are expanded. `start` counts the ids of all documents
    before, whether wanted or not. Rows without a doc_id are read when both bounds are None.
    """
    shards = files(spark, path)
    wanted = F.lit(True)
    for bound, holds in ((low, F.col("high_doc") >= F.lit(low)), (high, F.col("low_doc") <= F.lit(high))):
        wanted = wanted & holds if bound is not None else wanted

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                shard = unpacked(record["body"])
                kept = np.ones(len(shard.null), bool)
                if low is not None or high is not None:
                    kept &= ~shard.null
                if low is not None:
                    kept &= shard.doc_ids >= low
                if high is not None:
                    kept &= shard.doc_ids <= high
                for k in np.flatnonzero(kept).tolist():
                    a, n = int(shard.begins[k]), int(shard.here[k])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([record["part"]], pa.int32()),
                            "doc_id": pa.array([None if shard.null[k] else int(shard.doc_ids[k])], pa.int64()),
                            "start": pa.array([record["first_id"] + a - int(shard.before[k])], pa.int64()),
                            "before": pa.array([int(shard.before[k])], pa.int64()),
                            "ids": pa.array([shard.grammar.ids(a, a + n)], pa.list_(pa.int64())),
                        }
                    )

    pieces = shards.where(wanted).mapInArrow(expand, "part int, doc_id long, start long, before long, ids array<long>")
    return pieces.join(_starts(shards), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "before", "ids")


# --- check sums of documents that lie in several shards ------------------------------------

_POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, lowest power in the highest bit."""
    total = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            total ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return total


def joined_crc32(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings one after the other; `size` is that of the second."""
    power, square = 1 << 31, 1 << 23  # 1, and x to the 8th
    while size:
        if size & 1:
            power = _product(power, square)
        square, size = _product(square, square), size >> 1
    return _product(first, power) ^ second


def summed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from its shards.

    `start` counts the ids of all documents before; the check sum is that of the ids as
    little-endian 32-bit integers.
    """
    shards = files(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                part, first_document, first_id, body = (batch.column(n)[k].as_py() for n in range(4))
                shard = unpacked(body)
                data = memoryview(shard.grammar.ids().astype("<u4").tobytes())
                ends = 4 * np.cumsum(shard.here)
                crc = [zlib.crc32(data[b - 4 * n : b]) for b, n in zip(ends.tolist(), shard.here.tolist(), strict=True)]
                count = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * count, pa.int32()),
                        "document": pa.array(first_document + np.arange(count), pa.int64()),
                        "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.null),
                        "start": pa.array(first_id + shard.begins - shard.before, pa.int64()),
                        "before": pa.array(shard.before, pa.int64()),
                        "n_tokens": pa.array(shard.here, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                pieces = row.pop("pieces")
                crc = pieces[0]["ids_crc32"]
                for piece in pieces[1:]:
                    crc = joined_crc32(crc, piece["ids_crc32"], 4 * piece["n_tokens"])
                row |= {"n_tokens": sum(p["n_tokens"] for p in pieces), "ids_crc32": crc}
            yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)

    pieces = shards.select("part", "first_document", "first_id", "body").mapInArrow(
        sums, "part int, document long, doc_id long, start long, before long, n_tokens long, ids_crc32 long"
    )
    piece: Column = F.struct("before", "n_tokens", "ids_crc32")
    found = (
        pieces.groupBy("part", "document")
        .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sort_array(F.collect_list(piece)).alias("pieces"))
        .join(_starts(shards), "part")
        .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "pieces")
    )
    return found.mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


_WHOLE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
