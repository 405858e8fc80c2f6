"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hallmark.llm import phrases

DOCS = "doc_id long, lang string, text string, score string"


def brute(rows, support, top):
    upper = {c: c + 32 for c in range(65, 91)}
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    found = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in candidates.items():
            score, _, l, r = min(
                (1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
            )
            hidden = any(
                100 * b >= 50 * a for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if not hidden:
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(found)


def texts(seed, count=150):
    r = random.Random(seed)
    words = ["the", "The", "of", "New", "York", "new york", "été", "ß", "x-y", "a\tb", "naïve"] + [f"w{k}" for k in range(25)]
    rows = []
    for _ in range(count):
        parts = []
        for _ in range(r.randint(0, 30)):
            parts.append(r.choice(words) if r.random() < 0.6 else "New  York City")
            parts.append(r.choice([" ", " ", " ", "  ", ", ", ".\n", "\t", "; ", " "]))
        rows.append((r.choice(["en", "en", "de", None, ""]), "".join(parts)))
    return rows + [("en", None), (None, ""), ("fr", ",,; \n"), ("en", "the end")] + rows[:5] * 3


@pytest.mark.parametrize("sampled", [1, 3, 10**9])
def test_equals_plain_counts_however_few_propose(spark, sampled):
    rows = texts(sampled % 7)
    docs = spark.createDataFrame([(k, lang, text, "clash") for k, (lang, text) in enumerate(rows)], DOCS)
    docs = docs.withColumns({"n": F.lit("clash"), "phrase": F.lit(1), "k": F.lit(None).cast("int"), "h": F.lit("x")})
    found = phrases.collocations(docs, support=5, top=60, sampled=sampled, filter_words=1 << 12)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 60)


def test_a_full_filter_costs_work_but_no_phrase(spark):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = phrases.collocations(docs, support=3, top=100, sampled=2, filter_words=4)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, 100)


def test_windows_of_long_texts_hold_each_phrase_once():
    r = random.Random(1)
    text = "".join(r.choice(["ab ", "é, ", "abcdefghij ", " " * 90, "x" * 70 + ".", "c\n"]) for _ in range(3000))
    for size in (64, 1000, 1 << 20):
        counts = [Counter() for _ in range(3)]
        for _, part, repeated in phrases._windows(pa.array([text]), size):
            found = phrases.Phrases(part, np.zeros(1, np.uint64), repeated)
            for k in range(3):
                counts[k].update(found.phrase(b, k) for b in found.begins[k][found.fresh[k]].tolist())
        if size == 64:
            first = counts
        assert counts == first
    assert first[0].total() == len(re.findall(r"[^ \n,.]+", text))


def test_very_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([("en", "to be or not " * 400_000)], "lang string, text string")
    got = {r.phrase: (r.a, r.n) for r in phrases.collocations(docs).collect()}
    assert got["to be or"] == (400_000, 1_600_000) and got["not to be"] == (399_999, 1_600_000)
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.select("lang", F.lit(None).cast("string").alias("text"))).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    a, l, r = 3 * 10**13, 7 * 10**13, 5 * 10**13
    rows = [(1, "en", "x", l), (1, "en", "y", r), (2, "en", "x y", a), (0, "en", "", 10**14)]
    table = spark.createDataFrame(rows, "k int, lang string, phrase string, n long")
    monkeypatch.setattr(phrases, "frequent", lambda *_: table)
    assert phrases.collocations(table).first().score == 1000000 * a * a // (l * r)
