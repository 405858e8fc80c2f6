"""Licence scans: TF-IDF cosine to templates, then inheritance from directories.

Lines and paragraphs of every file, and licence files as a whole, are compared with
licence templates by the cosine of sparse TF-IDF vectors. Document frequencies of all
terms are counted over all files, so a header's score keeps with the shares of its
words, not with the size of the corpus. The most frequent terms, a bounded list, go to
the tasks; the others are joined to the units that they can still decide, so frequent
terms cause no hot keys. A unit that shares only the common terms of a template stays
below the threshold whatever else it holds, so only units with one of its telling terms
are scored, which loses nothing. A file without a licence of its own takes that of the
nearest directory above it whose licence file was recognised, by joins on the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallmark.llm import words as W
from hallmark.llm.tables import settled, step

THRESHOLD = 0.7
#: Terms whose frequencies go to the tasks.
HEAD_TERMS = 100_000
#: Term hashes that a task holds while it counts.
HELD_TERMS = 1 << 21
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"

# --- fixed values: notices that the licences' publishers ask for ------------------------
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False


def _hashed(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    words = W.Words(texts, _GAPS)
    return words, words.hashes()


class Templates:
    """Templates as TF-IDF vectors, with the terms that tell them."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [name for name, _ in templates]
        words, hashes = _hashed(pa.array([t for _, t in templates], pa.large_string()))
        self.terms = np.unique(hashes)
        self.tf = np.zeros((len(templates), len(self.terms)))
        for k in range(len(templates)):
            own = hashes[words.bounds[k] : words.bounds[k + 1]]
            np.add.at(self.tf[k], np.searchsorted(self.terms, own), 1)
        self.slots = np.zeros(1 << 16, bool)
        self.slots[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Which term each hash is, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        able = np.flatnonzero(self.slots[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.terms, hashes[able]).clip(max=len(self.terms) - 1)
        fine = self.terms[at] == hashes[able]
        found[able[fine]] = at[fine]
        return found

    def weighted(self, files: int, frequencies: np.ndarray, threshold: float) -> None:
        """Weigh terms by log((1 + files) / (1 + files with it)) + 1."""
        self.files = files
        self.idf = self.weight(frequencies)
        vectors = self.tf * self.idf
        self.vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.threshold = threshold
        # Leaving out a template's telling terms, the rest alone cannot reach the threshold.
        self.telling = np.zeros(len(self.terms), bool)
        for v in self.vectors:
            order = np.argsort(v, kind="stable")
            rest = np.sqrt(np.cumsum(v[order] ** 2))
            self.telling[order[(rest >= threshold - 1e-9) & (v[order] > 0)]] = True

    def weight(self, frequencies: np.ndarray) -> np.ndarray:
        return np.log((1 + self.files) / (1 + frequencies)) + 1

    def with_head(self, terms: np.ndarray, frequencies: np.ndarray) -> None:
        """Frequencies of the most frequent terms; no other term stands in more files."""
        order = np.argsort(terms)
        self.head, self.head_weights = terms[order], self.weight(frequencies[order])
        self.least = float(self.head_weights.max()) if len(terms) else 1.0

    def best(self, numbers: np.ndarray, hashes: np.ndarray) -> tuple[float, int, float, np.ndarray, np.ndarray]:
        """(product, template, norm, terms, counts) of a unit: its product with the most
        similar template, of equal ones the first; its own squared norm without the terms
        that are neither in templates nor in the head; and those terms."""
        vector = np.bincount(numbers[numbers >= 0], minlength=len(self.terms)) * self.idf
        others, counts = np.unique(hashes[numbers < 0], return_counts=True)
        norm = float((vector**2).sum())
        if len(self.head) and len(others):
            at = np.searchsorted(self.head, others).clip(max=len(self.head) - 1)
            known = self.head[at] == others
            norm += float(((counts * self.head_weights[at])[known] ** 2).sum())
            others, counts = others[~known], counts[~known]
        products = self.vectors @ vector
        k = int(np.round(products / np.sqrt(norm), 12).argmax())
        return float(products[k]), k, norm, others, counts


def term_files(files: DataFrame) -> DataFrame:
    """(term, n): in how many files each term stands, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return terms, np.bincount(at, np.concatenate([n for _, n in held]), len(terms)).astype(np.int64)

        def out(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        size = 0
        for batch in batches:
            for _, texts in W.slices(batch.column(0)):
                words, hashes = _hashed(texts)
                if not len(hashes):
                    continue
                row = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
                order = np.argsort(hashes, kind="stable")
                by_term, by_row = hashes[order], row[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (by_term[1:] != by_term[:-1]) | (by_row[1:] != by_row[:-1])
                held.append(np.unique(by_term[fresh], return_counts=True))
                size += len(held[-1][0])
                if size > HELD_TERMS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_TERMS // 2:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merged())

    return files.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def recognised(words: W.Words, row: int, hashes: np.ndarray, numbers: np.ndarray, templates: Templates, whole: bool) -> tuple[float, int, list[dict]]:
    """(similarity, template, open) of a text: its best unit whose terms are all in
    templates or the head, (0, -1) if none reaches the threshold; and the units that may
    be as similar, once the weights of their other terms are known."""
    a, b = int(words.bounds[row]), int(words.bounds[row + 1])
    own = numbers[a:b]
    telling = np.flatnonzero((own >= 0) & templates.telling[own])
    if not len(telling):
        return 0.0, -1, []
    begin, end = int(words.offsets[row]), int(words.offsets[row + 1])
    data = words.bytes_[begin:end]
    breaks = np.flatnonzero((data == 10) | (data == 13)) + begin
    line = np.searchsorted(breaks, words.starts[a:b])
    blank = np.array([m.start() for m in re.finditer(rb"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)", data.tobytes())], np.int64) + begin
    block = np.searchsorted(blank, words.starts[a:b])
    units = {(int(np.searchsorted(x, x[k])), int(np.searchsorted(x, x[k], "right"))) for x in (line, block) for k in telling}
    if whole:
        units.add((0, b - a))
    score, template, later = 0.0, -1, []
    for i, j in units:
        product, k, norm, others, counts = templates.best(own[i:j], hashes[a:b][i:j])
        # No other term weighs less than those of the head.
        most = round(product / np.sqrt(norm + float((counts.astype(float) ** 2).sum()) * templates.least**2), 12)
        if most < templates.threshold:
            continue
        if len(others):
            later.append((most, {"product": product, "template": k, "norm": norm, "terms": others.view(np.int64), "counts": counts}))
        elif (most, -k) > (score, -template):
            score, template = most, k
    return score, template, [unit for most, unit in later if most >= score]


PASSED = (
    "row_id long, doc_id long, path string, folder string, is_license_file boolean, score double, template int, "
    "open array<struct<product double, template int, norm double, terms array<long>, counts array<long>>>"
)
_OPEN = pa.list_(
    pa.struct(
        [("product", pa.float64()), ("template", pa.int32()), ("norm", pa.float64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )
)


def own_licenses(files: DataFrame, templates: Templates, frequencies: DataFrame) -> DataFrame:
    """(doc_id, path, folder, is_license_file, license, similarity) of each file's own text."""
    sent = files.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = sent.value
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            is_file = batch.column(3).to_pylist()
            for first, texts in W.slices(batch.column(4)):
                words, hashes = _hashed(texts)
                numbers = templates.numbers(hashes)
                found = [
                    recognised(words, k, hashes, numbers, templates, bool(is_file[first + k])) for k in range(len(texts))
                ]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_id + np.arange(len(texts)), pa.int64()),
                        *[part.column(k) for k in range(4)],
                        pa.array([x[0] for x in found], pa.float64()),
                        pa.array([x[1] for x in found], pa.int32()),
                        pa.array([x[2] for x in found], _OPEN),
                    ],
                    names=["row_id", "doc_id", "path", "folder", "is_license_file", "score", "template", "open"],
                )
                row_id += len(texts)

    passed = step(files.select("doc_id", "path", "folder", "is_license_file", "text").mapInArrow(run, PASSED))
    units = passed.where(F.size("open") > 0).select("row_id", F.posexplode("open").alias("unit", "x"))
    terms = units.select("row_id", "unit", F.explode(F.arrays_zip(F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))).alias("t"))
    terms = terms.select("row_id", "unit", F.col("t.term").alias("term"), F.col("t.count").alias("count"))
    weight = F.log(F.lit(1 + templates.files) / (1 + F.col("n"))) + 1
    rest = terms.join(frequencies, "term").groupBy("row_id", "unit").agg(F.sum((F.col("count") * weight) ** 2).alias("rest"))
    scored = units.join(rest, ["row_id", "unit"]).select(
        "row_id", F.round(F.col("x.product") / F.sqrt(F.col("x.norm") + F.col("rest")), 12).alias("score"), F.col("x.template").alias("template")
    )
    scored = scored.where(F.col("score") >= templates.threshold)
    later = scored.groupBy("row_id").agg(F.max(F.struct("score", (-F.col("template")).alias("first"))).alias("later"))
    least = F.struct("score", (-F.col("template")).alias("first"))
    best = F.when(F.col("template") < 0, F.col("later")).when(F.col("later").isNull() | (least >= F.col("later")), least).otherwise(F.col("later"))
    names = F.array(*[F.lit(x) for x in templates.names])
    return passed.join(later, "row_id", "left").withColumn("best", best).select(
        "doc_id", "path", "folder", "is_license_file",
        F.get(names, -F.col("best.first")).alias("license"), F.col("best.score").alias("similarity"),
    )


def _above(folder: Column) -> Column:
    """array<struct<depth, folder>>: a folder and all above it, the top one (empty) too."""
    parts = F.split(folder, "/", -1)
    named = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    top = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))
    return F.when(folder == "", top).otherwise(F.concat(top, named))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, similarity, license, inherited_from) for each row of `files`.

    `files` has doc_id, path and text. `own_license` is that of the most similar line or
    paragraph, or of the whole text of a licence file (by its name), with its
    `similarity`; null below the threshold. `license` is the own one, else that of the
    nearest folder, the file's own first, with a recognised licence file; among several
    in one folder the most similar, then the first path. `inherited_from` is that
    folder, empty for the top one. A null path inherits nothing; null and empty texts
    have no licence of their own; repeated rows are returned as often and count as often.
    """
    settled(files.sparkSession)
    path = F.col("path").cast("string")
    rows = files.select(
        F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"),
        F.regexp_replace(F.regexp_extract(path, "^(.*/)?", 0), "/+$", "").alias("folder"),
        F.coalesce(F.regexp_extract(path, "[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False)).alias("is_license_file"),
        F.col("text").cast("string").alias("text"),
    )
    known = Templates(templates)
    frequencies = step(term_files(rows))
    number = F.lit(known.terms.view(np.int64).tolist())
    of_templates = {r["term"]: r["n"] for r in frequencies.where(F.array_contains(number, F.col("term"))).collect()}
    known.weighted(rows.count(), np.array([of_templates.get(int(t), 0) for t in known.terms.view(np.int64)], np.int64), threshold)
    head = frequencies.orderBy(F.desc("n"), "term").limit(HEAD_TERMS).toArrow()
    known.with_head(head["term"].to_numpy().view(np.uint64), head["n"].to_numpy())
    own = step(own_licenses(rows, known, frequencies))
    licensed = (
        own.where("is_license_file and license is not null")
        .groupBy(F.col("folder").alias("above"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("less"), "path", "license")).alias("best"))
        .select("above", F.col("best.license").alias("given"))
    )
    folders = own.where("folder is not null").select("folder").distinct()
    spread = folders.select("folder", F.explode(_above(F.col("folder"))).alias("x")).select("folder", "x.depth", "x.above")
    nearest = spread.join(licensed, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    return own.join(nearest, "folder", "left").select(
        "doc_id", "path", F.col("license").alias("own_license"), "similarity",
        F.coalesce("license", "near.given").alias("license"),
        F.when(F.col("license").isNull(), F.col("near.above")).alias("inherited_from"),
    )
