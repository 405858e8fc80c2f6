"""MinHash near-duplicates with circulant signatures.

A text's shingle hashes are placed in a universe of 2^20 slots by a first, scrambling
permutation. One second permutation, shifted circularly by 1, 2, ... gives every further
coordinate of the signature (C-MinHash): the ranks of one shingle under all shifts lie
side by side, so a signature is the minimum over rows of one array. Six coordinates
make a band, 40 bands a signature: a pair with similarity 0.8 shares a band but for
5 in a million cases.

Texts with the same set are one class, so copies cost one row each. Candidates are
classes that share a band. First every class meets the smallest class of each of its
bands; links confirmed on full sets give components; then classes of one band that are
still in different components meet, unless their sizes and bitmaps rule the link out: a bit
that one set has and the other has not stands for a shingle that they do not share. No pair inside a component is ever listed, and no
candidate between components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hallmark.llm import words as W
from hallmark.llm.components import components
from hallmark.llm.tables import settled, step

BANDS = 40
ROWS = 6
SLOTS = 1 << 20
BITMAP_WORDS = 16
SIMILARITY = (80, 100)


class Signer:
    """Circulant MinHash of shingle sets, as band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, slots: int = SLOTS, seed: int = 9):
        self.bands, self.rows, self.slots = bands, rows, slots
        self.width = bands * rows
        rng = np.random.default_rng(seed)
        self.scramble = np.uint64(rng.integers(1, 1 << 63))
        ranks = rng.permutation(slots).astype(np.int32)
        around = np.concatenate((ranks, ranks[: self.width]))
        self.shifts = np.lib.stride_tricks.sliding_window_view(around, self.width)
        self.weights = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Ranks of the smallest shingle under each shift; shingles must not be empty."""
        at = (W.mixed(shingles ^ self.scramble) & np.uint64(self.slots - 1)).astype(np.int64)
        lowest = np.full(self.width, self.slots, np.int32)
        for k in range(0, len(at), 2048):
            np.minimum(lowest, self.shifts[at[k : k + 2048]].min(axis=0), out=lowest)
        return lowest

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        ranks = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        return W.mixed((ranks * self.weights).sum(axis=1, dtype=np.uint64)).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes | None:
    """128-bit name of a set; null for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bit h mod 1024 of each shingle hash h, as 16 longs."""
    bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
    bits[(shingles % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


SIGNED = "doc_id long, set_key binary, n_shingles long, bands array<long>, bits array<long>"


def signed(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, set_key, n_shingles, bands, bits) for each row; an empty set has no key."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                sets = W.shingle_sets(W.Words(texts), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([set_key(x) for x in sets], pa.binary()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([signer.keys(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
                        pa.array([bitmap(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "set_key", "n_shingles", "bands", "bits"],
                )

    return _texts(docs).mapInArrow(sign, SIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    settled(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs (a, b) with similarity at least that, compared on full sets.

    `pairs` has the rows (a, b, key_a, key_b): documents and the names of their sets. A
    document id that several texts share is compared by the text that the key names.
    """
    many, of = similarity

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                a, b = _sets(part.column(2), size), _sets(part.column(3), size)
                ids, keys = [part.column(i).to_pylist() for i in (0, 1)], [part.column(i).to_pylist() for i in (4, 5)]
                kept = []
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    both = W.common(x, y)
                    if of * both >= many * (len(x) + len(y) - both) and (set_key(x), set_key(y)) == (keys[0][i], keys[1][i]):
                        kept.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[0][i] for i in kept], pa.int64()), pa.array([ids[1][i] for i in kept], pa.int64())],
                    names=["a", "b"],
                )

    texts = _texts(docs)
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = pairs.join(of_a, "a").select("a", "b", "key_a", "text_a")
    right = pairs.join(of_b, "b").select("a", "b", "key_b", "text_b")
    return (
        left.join(right, ["a", "b"])
        .select("a", "b", "text_a", "text_b", "key_a", "key_b")
        .mapInArrow(compare, "a long, b long")
        .distinct()
    )


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sets of a column in which the same text may stand many times."""
    coded = texts.dictionary_encode()
    sets: list[np.ndarray] = []
    for _, part in W.slices(coded.dictionary):
        sets += W.shingle_sets(W.Words(part), size)
    return [sets[i] for i in coded.indices.to_pylist()]


def near_duplicates(
    docs: DataFrame, size: int = 5, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Two documents are linked when `similarity[1]` * shared shingles is at least
    `similarity[0]` * shingles of either; components follow the links, and a component's
    id is its smallest doc_id. Texts that are null, empty or without words have an empty
    set and stand alone; a null doc_id stands alone with a null component, and is kept.
    Rows that repeat a doc_id are returned as often, each with the component of its own
    text. Columns other than doc_id and text are not read.
    """
    marks = step(signed(docs, size, bands, rows))
    classes = step(
        marks.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"))
    )
    links = _links(classes, docs, size, similarity)
    named = components(links).withColumnsRenamed({"node": "id", "component": "via"})
    merged = classes.select("set_key", "id").join(named, "id", "left").select(
        "set_key", F.coalesce("via", "id").alias("component")
    )
    return marks.select("doc_id", "set_key", "n_shingles").join(merged, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def _missing(bits: str, other: str) -> Column:
    """Shingles, at least, that the first set has and the second has not."""
    alone = [
        F.bit_count(F.col(f"{bits}{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}{k}"))))
        for k in range(BITMAP_WORDS)
    ]
    return reduce(lambda x, y: x + y, alone)


def _links(classes: DataFrame, docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) that join all classes which any confirmed candidate joins."""
    many, of = similarity
    # One long names a band's mark: two that meet by chance are only compared in vain.
    # The groups and their members come from one exchange.
    banded = classes.select("id", F.posexplode("bands").alias("band", "mark")).select(
        "id", F.xxhash64("band", "mark").alias("mark")
    ).repartition("mark")
    shared = banded.groupBy("mark").agg(F.min("id").alias("first"), F.count("*").alias("members"))
    members = step(banded.join(shared.where("members > 1").drop("members"), "mark"))
    # All that may have to be compared is fetched by one shuffle of the texts.
    texts = step(_texts(docs).join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id"))
    sizes = classes.select("id", "n", "set_key")
    fits = f"{of} * least(n, other_n) >= {many} * greatest(n, other_n)"
    stars = step(
        members.where("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        .join(sizes.toDF("a", "other_n", "key_a"), "a")
        .join(sizes.toDF("b", "n", "key_b"), "b")
        .where(fits)
        .select("a", "b", "key_a", "key_b")
    )
    near = step(confirmed(stars, texts, size, similarity))
    named = components(near).withColumnsRenamed({"node": "id", "component": "via"})
    apart = members.drop("first").join(named, "id", "left").withColumn("via", F.coalesce("via", "id"))
    split = apart.groupBy("mark").agg(F.min("via").alias("low"), F.max("via").alias("high"))
    split = split.where("low <> high").select("mark")
    open_ = step(apart.join(split, "mark", "left_semi"))
    flat = [F.col("bits")[k].alias(f"bits{k}") for k in range(BITMAP_WORDS)]
    open_ = open_.join(classes.select("id", "n", "set_key", *flat), "id")
    other = open_.select(
        "mark", F.col("id").alias("b"), F.col("n").alias("other_n"), F.col("set_key").alias("key_b"),
        F.col("via").alias("other_via"), *[F.col(f"bits{k}").alias(f"other{k}") for k in range(BITMAP_WORDS)],
    )
    # What both can share, at most, is what one has less what the other misses of it.
    need = many * (F.col("n") + F.col("other_n"))
    able = (F.col("id") < F.col("b")) & (F.col("via") != F.col("other_via")) & F.expr(fits)
    able &= (many + of) * (F.col("n") - _missing("bits", "other")) >= need
    able &= (many + of) * (F.col("other_n") - _missing("other", "bits")) >= need
    across = (
        open_.withColumnRenamed("set_key", "key_a")
        .join(other, "mark")
        .where(able)
        .select(F.col("id").alias("a"), "b", "key_a", "key_b")
        .distinct()
        .join(stars.select("a", "b"), ["a", "b"], "left_anti")
    )
    return near.union(step(confirmed(step(across), texts, size, similarity)))


def first_of_each(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row for each document of `docs` that is the first of its group, with all columns.

    A doc_id that stands in several rows is one document: it stays if one of its texts
    is the first of a group, with the text of the smallest hash. Rows without a doc_id
    all stay.
    """
    found = near_duplicates(docs, size, similarity).where("doc_id is not null")
    ids = found.groupBy(F.col("doc_id").alias("id")).agg(F.max("kept").alias("first"), F.count("*").alias("rows"))
    # The user's columns go through the join as one, so no name can clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("doc"))
    firsts = rows.join(ids.where("first").drop("first"), "id")
    order = Window.partitionBy("id").orderBy(F.xxhash64("doc.text"), F.col("doc.text"))
    again = firsts.where("rows > 1").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    stay = firsts.where("rows = 1").select("doc.*").union(again.select("doc.*"))
    return stay.union(docs.where("doc_id is null"))
