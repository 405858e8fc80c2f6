"""Near-duplicates and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hallmark.llm.components import components
from hallmark.llm.near_dups import first_of_each, near_duplicates

DOCS = "doc_id long, text string, lang string"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute(rows, size):
    """{row number: (set size, component)}"""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def made(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice((3, 30, 80, 150)))]
        for _ in range(r.randint(1, 9)):
            copy = list(text)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy))
    rows += ["", None, "  \n ", "One", "one", "a b", "A\tB", "a b c"]
    r.shuffle(rows)
    return [(n, t) for n, t in enumerate(rows)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rows = made(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    found = near_duplicates(docs, size)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == brute(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_copies_nulls_and_empty_tables(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 2, False), (4, 2, False), (2, 2, True), (None, None, True), (9, 9, True)], key=str)
    assert near_duplicates(docs.where("false")).count() == 0
    stay = first_of_each(docs.withColumn("lang", F.lit("en")).unionByName(spark.createDataFrame([(2, "A B C D E F", "en")], DOCS)))
    assert stay.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id for r in stay.collect()), key=str) == [2, 9, None]


def test_first_of_each_keeps_columns_of_any_name(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (None, "a"), (8, "p q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["_id", "_rows", "_kept", "_nth", "id", "rows", "first", "nth", "doc", "kept", "a.b"]
    for n, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(n))
    stay = first_of_each(docs)
    assert stay.columns == ["doc_id", "text", *names]
    found = stay.collect()
    assert sorted((r.doc_id for r in found), key=str) == [1, 8, None]
    assert all(list(r)[2:] == list(range(len(names))) for r in found)


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 500), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140))
    assert got[500] == 500 and len(got) == 82
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    names = components(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")).collect()
    assert {r.component for r in names} == {"a"}
