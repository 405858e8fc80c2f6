"""The stored match index against searches of the whole ledger."""

from __future__ import annotations

import random

import pytest
from conftest import MASTER
from pyspark.sql import functions as F
from test_search import clustered, signed, table

from hallmark.operators import codewords, match, search
from hallmark.plans.derived import damaged_codeword
from hallmark.sources import build_index, compact, open_index, read_ledger, register

ROWS = "asset_id string, account_id string, payload_hex string, phash64 bigint, dhash64 bigint"


def rows(spark, words, seed=0):
    r = random.Random(seed)
    return spark.createDataFrame(
        [(f"a{n:05d}", f"acct{n % 3}", f"{r.getrandbits(128):032x}", signed(w), signed(r.getrandbits(64))) for n, w in enumerate(words)], ROWS
    )


def exchanges_over(frame, table_name):
    """Does any exchange lie above the scan of a stored table in the executed plan?"""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = [k for k, line in enumerate(lines) if "FileScan" in line and table_name in line]
    assert at, plan
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for k in at:
        level = depth(lines[k])
        for line in reversed(lines[:k]):
            if depth(line) < level:
                level = depth(line)
                if "Join" in line:
                    break
                if "Exchange" in line:
                    return True
    return False


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    queries, targets = clustered(3)
    targets = sorted(targets)
    ledger = rows(spark, targets + targets[:40])  # copies as well
    path = str(tmp_path_factory.mktemp("ledger"))
    build_index(ledger.filter("asset_id < 'a00500'"), path)
    open_index(spark, path).append(ledger)
    asked = spark.createDataFrame(
        [(n, signed(q), f"acct{n % 4}" if n % 2 else None) for n, q in enumerate(sorted(queries))],
        "query_id bigint, phash64 bigint, account_id string",
    )
    return path, ledger, asked


@pytest.mark.parametrize("distance", [0, 1, 9, 14])
def test_radius_join_equals_the_ledgers(spark, made, distance):
    path, ledger, asked = made
    want = sorted(map(tuple, search.radius_join(asked, ledger, max_distance=distance).collect()))
    got = search.radius_join_indexed(asked, open_index(spark, path), max_distance=distance)
    assert sorted(map(tuple, got.collect())) == want and want


def test_searches_read_neither_ledger_nor_shuffle_the_index(spark, made):
    path, _, asked = made
    index = open_index(spark, path)
    found = search.radius_join_indexed(asked, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("hallmark_" in line for line in scans)
    assert not exchanges_over(found, index._words("phash"))
    assert not exchanges_over(found, index._assets("phash"))


def test_appending_again_adds_nothing_and_compacting_keeps_all(spark, made):
    path, ledger, asked = made
    index = open_index(spark, path)
    before = [index.words().count(), index.assets().count(), index.bands(7).count(), index.bands(16).count()]
    index.append(ledger)
    assert [index.words().count(), index.assets().count(), index.bands(7).count(), index.bands(16).count()] == before
    assert before[1] == ledger.count() and before[2] == 8 * ledger.count() and before[3] == 17 * ledger.count()
    want = sorted(map(tuple, search.radius_join_indexed(asked, index).collect()))
    newer = compact(spark, path)
    assert newer.generation == index.generation + 1 and open_index(spark, path) == newer
    assert sorted(map(tuple, search.radius_join_indexed(asked, newer).collect())) == want
    assert sorted(map(tuple, search.radius_join_indexed(asked, index).collect())) == want


def test_hot_keys_are_looked_up_by_a_second_part(spark, monkeypatch, tmp_path):
    from hallmark.sources import index as module

    monkeypatch.setattr(module, "hot_limit", lambda rows: 50)
    queries, targets = clustered(8)
    made = build_index(rows(spark, sorted(targets)), str(tmp_path))
    assert made.hot().count()
    got = search.indexed_pairs(table(spark, queries, "q"), made, "phash", 12).collect()
    want = search.hash_pairs(table(spark, queries, "q"), table(spark, targets, "t"), 12).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("errors", [3, 7, 12, 16])
def test_codewords_are_matched_from_the_index(spark, made, errors):
    path, ledger, _ = made
    counts = F.explode(F.sequence(F.lit(0), F.lit(18))).alias("k")
    some = ledger.filter("asset_id < 'a00060'").select("payload_hex", counts)
    suspects = some.select(
        F.col("payload_hex").alias("right"), F.col("k").cast("bigint"),
        damaged_codeword(codewords.codeword_of(F.col("payload_hex")), F.col("k").cast("bigint")).alias("codeword"),
    ).unionByName(spark.createDataFrame([("none", 0, None)], "right string, k bigint, codeword binary"))
    got = codewords.match_codeword(suspects, None, errors, open_index(spark, path)).collect()
    assert len(got) == suspects.count()
    for r in got:
        fits = r.k <= errors and r.right != "none"
        assert (r.payload_hex, r.byte_errors) == ((r.right, r.k) if fits else (None, None))


def test_best_look_from_the_index(spark, made):
    path, ledger, asked = made
    full = ledger.withColumn("created_at", F.lit(0).cast("timestamp"))
    for table_ in (full, full.withColumn("ahash64", F.col("phash64")).withColumn("whash64", F.col("phash64"))):
        if "whash64" not in table_.columns:
            continue
        for suspects in (asked, asked.drop("account_id")):
            named = suspects.withColumnRenamed("query_id", "image_id")
            want = match.best_by_look(named, table_).select("image_id", "seen.asset_id").collect()
            got = match.best_by_look(named, table_, index=open_index(spark, path)).select("image_id", "seen.asset_id").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_registration_feeds_the_index(spark, tmp_path):
    path = str(tmp_path)
    claims = spark.createDataFrame(
        [(f"acct{n}", "dev", f"{n:016x}", f"{n + 1:016x}", "0" * 16, "f" * 16, f"c{n}") for n in range(6)],
        "account_id string, device_signature string, perceptual_hash_phash string, perceptual_hash_dhash string, "
        "perceptual_hash_ahash string, perceptual_hash_whash string, zkp_commitment_hex string",
    ).withColumn("creation_timestamp", F.lit("2024-01-02").cast("timestamp"))
    register(claims.limit(0), path, MASTER)
    index = build_index(read_ledger(spark, path), path)
    for _ in range(2):
        register(claims, path, MASTER, index=index)
    ledger = read_ledger(spark, path)
    assert ledger.count() == index.assets().count() == 6
    asked = spark.createDataFrame([(1, 3)], "query_id int, phash64 bigint")
    want = sorted(map(tuple, search.radius_join(asked, ledger, max_distance=1).collect()))
    assert sorted(map(tuple, search.radius_join_indexed(asked, index, max_distance=1).collect())) == want


def test_no_index(spark, tmp_path):
    assert open_index(spark, str(tmp_path)) is None
    with pytest.raises(ValueError):
        compact(spark, str(tmp_path))
