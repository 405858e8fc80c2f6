"""Exact search, URL filters and quotation linking."""

import random

import numpy as np
from pyspark.sql import functions as F

from hallmark.llm import exact_search, quotes, url_filters


def test_exact_search_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = [(int(k), [float(x) for x in r.normal(0, 0.2, 16)]) for k in range(700)]
    vectors += [(k + 700, v) for k, v in vectors[:30]]  # ties
    odd = [(None, vectors[0][1]), (900, None), (901, [float("nan")] * 16), (902, [None] + [0.1] * 15), (903, []), (904, [0.5] * 3), (905, [float("inf")] * 16)]
    table = spark.createDataFrame(vectors + odd + [vectors[0]], "vec_id long, embedding array<float>")
    whole = exact_search.whole_vectors(table)
    got = {}
    for row in exact_search.exact_top_k(whole, whole.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    ints = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in vectors + [vectors[0]]]
    asked = {k: v for k, v in ints if k % 50 == 0}
    assert set(got) == set(asked)
    for q, v in asked.items():
        best = sorted((-int(v @ w), k) for k, w in ints if k != q)[:5]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert exact_search.exact_top_k(whole.where("false"), whole.where("false"), 5).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    data, queries = r.integers(-300, 300, (500, 24)), r.integers(-300, 300, (20, 24)).astype(float)
    low, high = exact_search.ApproximationFile(data).bounds(queries)
    exact = queries @ data.T
    assert (low <= exact).all() and (exact <= high).all()


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def judged(spark, pages):
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return {r.page_id: r for r in url_filters.judged(table, rules).collect()}


def test_rules_and_urls(spark):
    got = judged(spark, [
        (1, "http://A.Example.ORG/es/x?y#z", None), (2, "https://example.org/en/12", ""), (3, "http://notexample.org/en/1", None),
        (4, "ftp://b.com/de/1", None), (5, "http://b.com/fr", None), (6, None, None), (7, "no scheme", None), (8, "http://x.net/de/", None),
        (9, "http://org", None), (10, "http://org/", None), (11, "http://b.com?/de/", None), (12, "://q.com/de/a://c", None), (13, "http://ÄB.org/ES/", None),
    ])
    assert [got[k].rule for k in range(1, 14)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", None, None, None, None, None, "org/", None, "com/de/", "org/"]
    assert [got[k].verdict for k in (1, 2, 3, 4, 5, 6)] == ["block", "block", "allow", "block", "allow", "allow"]
    assert (got[1].host, got[1].path) == ("a.example.org", "/es/x") and (got[6].host, got[7].path) == ("", "")
    assert got[13].host == "Äb.org" and (got[11].host, got[11].path) == ("b.com", "")


def test_aliases_share_decisions(spark):
    link = '<link rel="canonical" href="{}">'.format
    got = judged(spark, [
        (1, "http://x.net/1", link("http://b.com/de/5")),  # alias of a blocked page
        (2, "http://y.net/2#frag", "<META content='0; URL=//x.net/1' http-equiv=refresh><meta http-equiv='refresh' content='0; url=//x.net/1'>"),
        (3, "http://z.net/3", link("/4")), (4, "http://z.net/4", link("http://b.com/de/7")), (5, "http://z.net/5", link("4")),
        (6, "http://z.net/5", link("http://w.org/a")),  # an explicit allow outweighs the block
        (7, "http://w.org/b", link("http://b.com/de/9")), (8, "http://u.net/", link("")), (9, "https://x.net/1", None),
    ])
    assert {k: got[k].verdict for k in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    assert url_filters.judged(
        spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame(RULES, "rule string, verdict string")
    ).count() == 0


def test_quotes_make_threads(spark):
    rows = [
        (1, 0, "user", "How do I sort rows?\nThey are many."),
        (1, 1, "assistant", "Use order by."),
        (1, 2, "user", "On Monday A wrote:\n> how do i  SORT rows?\nI meant columns."),
        (1, 3, "assistant", "> On Monday A wrote:\n> > How do I sort rows?\n> I meant columns.\n\nThen select them."),
        (1, 4, "user", "> never said before\nfine"), (1, 5, "user", "> Use order by.\n> Use order by."),
        (2, 0, "user", "> Use order by.\nelsewhere"), (None, 0, "user", "Use order by."), (1, None, "user", None), (1, 1, "assistant", "Use order by."),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    got = quotes.reply_ordered(table).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 2].reply_to == 0 and by[1, 2].text == "I meant columns." and by[1, 2].n_quoted == 1
    assert by[1, 3].reply_to == 2 and by[1, 3].root == 0 and by[1, 3].depth == 2 and by[1, 3].text == "Then select them."
    assert by[1, 4].reply_to is None and by[1, 5].reply_to == 1 and by[1, 5].text == ""
    assert by[2, 0].reply_to is None and by[1, None].text == ""
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(1, 9))
    assert [r.turn for r in order] == [None, 0, 2, 3, 1, 1, 5, 4]
    assert quotes.reply_ordered(table.where("false")).count() == 0


def test_quotes_of_every_level_and_length_are_linked(spark):
    rows = [
        (1, 0, "user", "How do I sort rows?"), (1, 1, "assistant", "> How do I sort rows?\nBy a key."),
        (1, 2, "user", ">> How do I sort rows?\nSo do I."),  # level 2 alone
        (1, 3, "user", "> not kept here\n>> By a key.\n>>> How do I sort rows?\nWhich?"),  # the nearest known level
        (1, 4, "user", "> By a key.\nAnd\n> How do I sort rows?\n>> How do I sort rows?"),  # several originals
        (2, 0, "user", "Yes"), (2, 1, "user", "好的"), (2, 2, "user", "> Yes\nfine"), (2, 3, "user", "> 好的\n谢谢"),
        (2, 4, "user", "> fine\n> no such line\nok\nno"), (2, 5, "user", "> ok\n\nright"), (2, 6, "user", "> ok\n> no\nwell"),
        (2, 7, "user", "> right\n> ok\n> Yes"), (3, 0, "user", "> Yes\nelsewhere"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(table).collect()}
    assert {k: r.reply_to for k, r in got.items()} == {
        (1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 0, (2, 0): None, (2, 1): None, (2, 2): 0, (2, 3): 1,
        (2, 4): 2, (2, 5): 4, (2, 6): 4, (2, 7): 5, (3, 0): None,
    }
    assert {r.root for k, r in got.items() if k[0] == 1} == {0} and got[1, 3].depth == 2
    links = {k: [(x.passage, x.level, x.original) for x in r.links] for k, r in got.items()}
    assert links[1, 2] == [(1, 2, 0)] and links[1, 3] == [(2, 2, 1), (3, 3, 0)]
    assert links[1, 4] == [(1, 1, 1), (2, 1, 0), (3, 2, 0)] and links[1, 0] == links[3, 0] == []
    order = [r.turn for r in sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 2, 3, 4]


def test_long_reply_chains(spark):
    r = random.Random(1)
    rows = [(1, 0, "user", "start here 0")] + [(1, k, "user", f"> start here {k - 1}\nstart here {k}") for k in range(1, 70)]
    r.shuffle(rows)
    got = {x.turn: x for x in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[k].reply_to == k - 1 and got[k].depth == k and got[k].root == 0 for k in range(1, 70))


def test_passages(spark):
    text = "a\n> b\n>> c\n> > d\n> e\nf"
    got = spark.createDataFrame([(text,)], "t string").select(quotes.passages(F.col("t")).alias("p")).first().p
    assert [tuple(x) for x in got] == [(0, "a"), (1, "b"), (2, "c\nd"), (1, "e"), (0, "f")]
