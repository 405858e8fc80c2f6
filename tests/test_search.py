"""Search by table against brute force, on even and on lopsided hashes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hallmark.operators import search


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def near(rng: random.Random, word: int, bits: int) -> int:
    for bit in rng.sample(range(64), bits):
        word ^= 1 << bit
    return word


def brute(queries, targets, distance):
    return {
        (signed(q), signed(t), (q ^ t).bit_count())
        for q in queries
        for t in targets
        if (q ^ t).bit_count() <= distance
    }


def table(spark, words, name):
    return spark.createDataFrame([(signed(w),) for w in words], f"{name} bigint")


def clustered(seed: int) -> tuple[set[int], set[int]]:
    """A third of the targets share their top 16 bits, a third their lowest."""
    rng = random.Random(seed)
    targets = {rng.getrandbits(64) for _ in range(300)}
    targets |= {rng.getrandbits(48) for _ in range(300)}
    targets |= {rng.getrandbits(48) << 16 for _ in range(300)}
    queries = {near(rng, t, rng.randrange(0, 14)) for t in rng.sample(sorted(targets), 200)}
    return queries | {0, (1 << 64) - 1}, targets | {0}


@pytest.mark.parametrize("distance", [0, 1, 10, 14])
@pytest.mark.parametrize("parts,hot_rows", [(None, None), (4, 50), (3, 50), (8, 100), (5, 10)])
def test_pairs_equal_brute_force(spark, distance, parts, hot_rows):
    queries, targets = clustered(distance)
    got = search.hash_pairs(
        table(spark, queries, "q"), table(spark, targets, "t"), distance,
        parts=parts, hot_rows=hot_rows,
    ).collect()
    rows = [tuple(r) for r in got]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(queries, targets, distance)


def test_wide_radius(spark):
    queries, targets = clustered(99)
    queries = set(sorted(queries)[:30])
    got = search.hash_pairs(table(spark, queries, "q"), table(spark, targets, "t"), 30)
    assert {tuple(r) for r in got.collect()} == brute(queries, targets, 30)


def test_no_probe_of_a_query_is_a_row(spark):
    rng = random.Random(5)
    targets = {rng.getrandbits(64) for _ in range(5000)}
    got = search.hash_pairs(table(spark, sorted(targets)[:50], "q"), table(spark, targets, "t"), 14)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "mapInArrow" in plan.replace("MapInArrow", "mapInArrow")


def test_the_nearest_of_each_query_stay_with_their_ties(spark):
    queries, targets = clustered(31)
    queries = set(sorted(queries)[:60])
    got = search.hash_pairs(table(spark, queries, "q"), table(spark, targets, "t"), 30, top=2)
    found = {tuple(r) for r in search.nearest_of_each(got, 2).collect()}
    want = set()
    for q in queries:
        own = sorted(p for p in brute({q}, targets, 30))
        ranked = sorted(d for *_, d in own)
        want |= {p for p in own if p[2] <= ranked[:2][-1]}
    assert found == want


@pytest.mark.parametrize("top", [1, 3])
def test_queries_with_enough_near_hashes_do_not_look_further(spark, top, monkeypatch):
    """All went to the whole radius, where chance brings more than is kept."""
    queries, targets = clustered(77)
    asked = []
    pairs = search.hash_pairs
    monkeypatch.setattr(search, "hash_pairs", lambda q, t, d, *a, **k: asked.append((q.count(), d)) or pairs(q, t, d, *a, **k))
    got = search.nearest_pairs(table(spark, queries, "q"), table(spark, targets, "t"), 26, top, target_rows=10**7)
    found = [tuple(r) for r in got.collect()]
    want = set()
    for q in queries:
        own = brute({q}, targets, 26)
        ranked = sorted(d for *_, d in own)
        want |= {p for p in own if p[2] <= ranked[:top][-1]}
    assert len(found) == len(set(found)) and set(found) == want
    narrow = search.chance_radius(10**7, 2 * top)
    assert [d for _, d in asked] == [narrow, 26] and narrow < 16
    assert asked[1][0] < asked[0][0] == len(queries)


def test_pairs_that_look_unlike_leave_no_kernel(spark):
    from functools import partial

    from hallmark.functions import i64_to_hex, trigram_similarity
    from hallmark.operators import cells

    rng = random.Random(13)
    words = [rng.choice([0, 1 << 63, 0x1111222211112222, rng.getrandbits(64)]) ^ rng.getrandbits(rng.choice([1, 8, 60])) for _ in range(300)]
    both = [(signed(w), signed(near(rng, w, rng.randrange(20)))) for w in words]
    rows = spark.createDataFrame(both, "q bigint, t bigint")
    for threshold in (0.1, 0.3, 0.5, 1.0):
        wanted = rows.select((trigram_similarity(i64_to_hex("q"), i64_to_hex("t")) >= threshold - 1e-9).alias("x")).collect()
        q, t = (np.array(x, np.int64).view(np.uint64) for x in zip(*both))
        assert cells.alike(q, t, threshold).tolist() == [r.x for r in wanted]
    queries, targets = clustered(41)
    met = search.hash_pairs(
        table(spark, queries, "q"), table(spark, targets, "t"), 20, keep=partial(cells.alike, threshold=0.3)
    )
    assert 0 < met.count() == met.filter(trigram_similarity(i64_to_hex("q"), i64_to_hex("t")) >= 0.3 - 1e-9).count() < len(brute(queries, targets, 20))


def test_part_choice_grows_with_the_table():
    few, many = search.choose_parts(10_000, 10), search.choose_parts(10**10, 10)
    assert few > many
    for d in range(65):
        for n in (3, 4, 5, 8, 16):
            cut = search._slices(search._cut(0, 64, n), d)
            assert sum(s.tolerance + 1 for s in cut) == d + 1


def test_copies_meet_once_and_all_come_back(spark):
    ledger = spark.createDataFrame(
        [(f"a{i:03d}", "acct-1" if i % 2 else "acct-2", 7) for i in range(60)]
        + [("b", "acct-1", 8), ("c", "acct-1", -1)],
        "asset_id string, account_id string, phash64 bigint",
    )
    queries = spark.createDataFrame(
        [(f"q{i}", None if i else "acct-1", 7) for i in range(40)],
        "query_id string, account_id string, phash64 bigint",
    )
    got = search.radius_join(queries, ledger, max_distance=3)
    assert got.filter("query_id = 'q1'").count() == 60 + 0
    assert got.filter("query_id = 'q0'").count() == 30
    wide = search.radius_join(queries, ledger, max_distance=4)
    assert wide.filter("query_id = 'q1' AND asset_id = 'b'").first().distance == 4
    top = search.search_batch(queries, ledger, limit=5, max_distance=4)
    assert [r.asset_id for r in top.filter("query_id = 'q0'").orderBy("rank").collect()] == [
        "a001", "a003", "a005", "a007", "a009",
    ]


def test_nearest_match(spark):
    candidates = spark.createDataFrame(
        [(5, 0b1111), (3, 0b1111), (9, 1 << 40)], "idx bigint, phash64 bigint"
    )
    queries = spark.createDataFrame(
        [("tie", 0b0111), ("far", -1), ("none", None)], "query_id string, phash64 bigint"
    )
    got = {r.query_id: (r.match_idx, r.distance) for r in search.nearest_match(queries, candidates).collect()}
    assert got == {"tie": (3, 1), "far": (None, 60), "none": (None, search.NO_DISTANCE)}
    empty = search.nearest_match(queries, candidates.limit(0)).collect()
    assert {(r.match_idx, r.distance) for r in empty} == {(None, search.NO_DISTANCE)}


def nearest(queries, targets):
    return {signed(q): min(((q ^ t).bit_count(), n) for n, t in enumerate(targets)) for q in queries}


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_nearest_match_equals_brute_force_on_lopsided_hashes(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(search, "hot_limit", lambda rows, hot=None: hot or 4096)
    queries, targets = clustered(21)
    queries = sorted(queries)[:60] + [random.Random(4).getrandbits(64) for _ in range(20)]
    targets = sorted(targets)
    candidates = spark.createDataFrame([(n, signed(t)) for n, t in enumerate(targets + targets[:9])], "idx bigint, phash64 bigint")
    asked = spark.createDataFrame([(n, signed(q)) for n, q in enumerate(queries)], "query_id bigint, phash64 bigint")
    got = search.nearest_match(asked, candidates, threshold=64, hot_rows=hot_rows).collect()
    want = nearest(queries, targets)
    assert {r.query_id: (r.distance, r.match_idx) for r in got} == {n: want[signed(q)] for n, q in enumerate(queries)}


def test_nearest_match_meets_few_candidates(spark):
    rng = random.Random(12)
    targets = [rng.getrandbits(64) for _ in range(6000)]
    queries = [near(rng, rng.choice(targets), rng.randrange(0, 11)) for _ in range(300)]
    candidates = spark.createDataFrame([(n, signed(t)) for n, t in enumerate(targets)], "idx bigint, phash64 bigint")
    asked = spark.createDataFrame([(n, signed(q)) for n, q in enumerate(queries)], "query_id bigint, phash64 bigint")
    met: list[int] = []
    got = search.nearest_match(asked, candidates, met=met).collect()
    want = nearest(queries, targets)
    assert {r.query_id: r.distance for r in got} == {n: want[signed(q)][0] for n, q in enumerate(queries)}
    assert len(met) > 1 and sum(met) < 0.02 * len(queries) * len(targets)


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.75, 1.0])
def test_trigram_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(17)
    grams = lambda h: {f"  {h} "[k : k + 3] for k in range(len(h) + 1)}
    texts = {f"{rng.getrandbits(64):016x}" for _ in range(60)} | {"0" * 16, "0" * 15 + "1", "ab", "abc", "a", "0" * 8}
    asked = {t[:k] + "7" + t[k + 1 :] for t in sorted(texts) for k in (0, 9, 13) if len(t) == 16} | texts
    q = spark.createDataFrame([(t,) for t in sorted(asked)], "q string")
    t = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    got = [tuple(r) for r in search.trigram_pairs(q, t, threshold).collect()]
    want = {
        (a, b) for a in asked for b in texts
        if len(grams(a) & grams(b)) >= threshold * len(grams(a) | grams(b))
    }
    assert len(got) == len(set(got)) and set(got) == want


def test_trigram_batch_equals_single_searches(spark):
    rng = random.Random(18)
    words = [rng.getrandbits(64) for _ in range(50)]
    rows = [(f"a{n}", f"acct{n % 2}", f"{w:016x}") for n, w in enumerate(words + words[:5])] + [("odd", "acct0", "nohex"), ("short", "acct1", "abcd")]
    ledger = spark.createDataFrame(rows, "asset_id string, account_id string, perceptual_hash_phash string")
    asked = [(n, None if n % 3 else "acct0", f"{near(rng, w, 5):016X}") for n, w in enumerate(words[:6])] + [(90, None, "zz"), (91, None, None)]
    queries = spark.createDataFrame(asked, "query_id int, account_id string, phash string")
    got = search.search_trigram_batch(queries, ledger, limit=2, max_distance=40).collect()
    for n, account, text in asked[:6]:
        want = search.search_trigram(ledger, "phash", text, account, limit=2, max_distance=40).collect()
        assert [(r.asset_id, r.distance) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == n] == [(r.asset_id, r.distance) for r in want]
    assert not [r for r in got if r.query_id >= 90]


def test_trigram_batch_within_a_word_meets_near_words_first(spark, monkeypatch):
    rng = random.Random(19)
    words = [rng.getrandbits(64) for _ in range(40)]
    rows = [(f"a{n}", f"{w:016x}") for n, w in enumerate(words)] + [("short", "abcd"), ("other", "abce")]
    ledger = spark.createDataFrame(rows, "asset_id string, perceptual_hash_phash string")
    asked = [(n, f"{near(rng, w, n % 12):016X}") for n, w in enumerate(words[:12])] + [(90, "ABCD")]
    queries = spark.createDataFrame(asked, "query_id int, phash string")
    sent, whole = [], search.trigram_pairs
    monkeypatch.setattr(search, "trigram_pairs", lambda q, t, *a: sent.append((q, t)) or whole(q, t, *a))
    got = search.search_trigram_batch(queries, ledger, limit=3, max_distance=14).collect()
    for n, text in asked:
        want = search.search_trigram(ledger, "phash", text, limit=3, max_distance=14).collect()
        assert [(r.asset_id, r.distance) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == n] == [(r.asset_id, r.distance) for r in want]
    assert all(r[0] in ("abcd", "abce") for frame in sent[0] for r in frame.collect())


def test_the_filter_is_generated_code(small_ledger):
    for limit in (10, None):
        found = search.search_hash(small_ledger, "phash", "abcdef0123456789", max_distance=limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        first = plan[: plan.index("Union")] if "Union" in plan else plan
        assert all("*(" in line for line in first.split("\n") if "Filter" in line)


@pytest.fixture(scope="module")
def small_ledger(spark):
    rows = [
        ("id-1", "acct-1", "abcdef0123456789", "0123456789abcdef"),
        ("id-2", "acct-2", "abcdef0123456788", "ffff456789abcdef"),
        ("id-3", "acct-1", "0000000000000000", "0123456789abcdee"),
    ]
    return spark.createDataFrame(
        rows, "asset_id string, account_id string, perceptual_hash_phash string, perceptual_hash_dhash string"
    )


def test_single_searches(small_ledger):
    def hits(*args, **kw):
        return [(r.asset_id, r.distance) for r in search.search_hash(small_ledger, *args, **kw).collect()]

    assert hits("phash", "ABCDEF0123456789") == [("id-1", 0), ("id-2", 1)]
    assert hits("phash", "abcdef0123456789", account="acct-2") == [("id-2", 1)]
    assert hits("phash", "abcdef0123456789", limit=1) == [("id-1", 0)]
    assert len(hits("phash", "abcdef0123456789", max_distance=None)) == 3
    assert hits("phash", "zzzznotahexhash!@#") == []
    assert hits("phash", "") == []
    assert hits("phash", "abcdef01") == []  # another length is as far as can be
    assert hits("phash", "abcdef01", max_distance=64)[0][1] == 64


def test_combined_keeps_phash_order_and_stubs(small_ledger):
    got = search.search_combined(small_ledger, "abcdef0123456788", "0123456789abcdef").collect()
    assert [(r.asset_id, r.perceptual_distance.phash, r.perceptual_distance.dhash) for r in got] == [
        ("id-2", 0, 0), ("id-1", 1, 0), ("id-3", 0, 1),
    ]
    assert not any(r.payload_match for r in got)
    open_ended = search.search_combined(small_ledger, "abcdef0123456788", None, stub_zeros=False)
    assert open_ended.first().perceptual_distance.dhash is None
    with pytest.raises(ValueError):
        search.search_combined(small_ledger, None, None)


def test_top_k_needs_no_shuffle(small_ledger):
    plan = search.search_hash(small_ledger, "phash", "abcdef0123456789")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
