from __future__ import annotations

import hashlib

import pytest
from conftest import MASTER, SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hallmark.functions import chain_hash, hex_to_i64
from hallmark.operators import audit, match, views
from hallmark.plans import derived
from hallmark.sources import ledger as source
from hallmark.sources import manifests


def claim_rows(spark, count):
    return spark.range(count).select(
        F.concat(F.lit("acct-"), F.col("id") % 3).alias("account_id"),
        F.lit("dev").alias("device_signature"),
        source.claim_time(F.lit(1.7e9) + F.col("id") * 864000, F.current_timestamp()).alias("creation_timestamp"),
        *[F.substring(F.sha2(F.concat(F.lit(h), F.col("id").cast("string")), 256), 1, 16).alias(f"perceptual_hash_{h}")
          for h in ("phash", "dhash", "ahash", "whash")],
        F.when(F.col("id") % 2 == 0, F.encode(F.lit("png"), "utf-8")).alias("watermarked_image"),
    )


def test_register_adds_each_claim_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = claim_rows(spark, 10)
    source.register(first.unionByName(first), path, MASTER)
    source.register(claim_rows(spark, 14), path, MASTER)
    ledger = source.read_ledger(spark, path)
    rows = ledger.collect()
    assert len(rows) == len({r.asset_id for r in rows}) == 14
    images = source.read_ledger_images(spark, path)
    assert images.count() == 7
    for r in rows:
        text = "|".join([
            r.payload_hex, r.zkp_commitment_hex, r.perceptual_hash_phash, r.perceptual_hash_dhash,
            r.perceptual_hash_ahash, r.perceptual_hash_whash,
            r.creation_timestamp.strftime("%Y-%m-%dT%H:%M:%S.%f"), r.account_id])
        assert r.chain_of_custody_hash == hashlib.sha256(text.encode()).hexdigest()
        assert r.account_public_key.startswith("04") and len(r.account_public_key) == 66
    public = views.public_view(ledger, images)
    assert public.filter("image_available").count() == 7
    assert not {"zkp_opening_value", "zkp_opening_randomness"} & set(public.columns)
    one = rows[0]
    assert views.get_by_payload(ledger, one.payload_hex).first().asset_id == one.asset_id
    plan = views.get_by_payload(ledger, one.payload_hex)._jdf.queryExecution().toString()
    assert f"EqualTo(payload_hex,{one.payload_hex})" in plan
    source.register(claim_rows(spark, 0), path, MASTER)
    assert source.read_ledger(spark, path).count() == 14


def test_missing_or_zero_time_is_arrival(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (1.5,)], "t double")
    got = [r[0] for r in rows.select(F.unix_micros(source.claim_time(F.col("t"), F.timestamp_seconds(F.lit(99))))).collect()]
    assert got == [99_000_000, 99_000_000, 1_500_000]


def test_commitment_lookup_refuses_two_rows(spark):
    ledger = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("d", "c2")], "asset_id string, zkp_commitment_hex string")
    assert views.get_by_commitment(ledger, "c1").first().asset_id == "a"
    assert views.get_by_commitment(ledger, "none").count() == 0
    with pytest.raises(PySparkException):
        views.get_by_commitment(ledger, "c2").collect()


def test_old_files_read_null(spark, tmp_path):
    ledger = derived.ledger(spark, SMALL).drop("ok")
    path = str(tmp_path / "mixed")
    ledger.limit(5).write.parquet(path)
    ledger.limit(7).withColumn("watermarked_image", F.encode(F.lit("x"), "utf-8")).write.mode("append").parquet(path)
    got = source.read_ledger_evolved(spark, path)
    assert got.count() == 12 and got.filter("watermarked_image IS NULL").count() == 5


def test_manifest_files(spark, tmp_path):
    folder = tmp_path / "manifests"
    folder.mkdir()
    (folder / "u1.c2pa").write_bytes(b"signed")
    rows = spark.createDataFrame(
        [(1, "manifests/u1.c2pa"), (2, "manifests/gone.c2pa"), (3, "hallmark://manifest/u1.c2pa"), (4, None), (5, "")],
        "n int, c2pa_manifest_reference string")
    got = manifests.manifest_lookup(rows, manifests.read_manifests(spark, str(folder)))
    found = {r.n: r.c2pa_manifest for r in got.collect()}
    assert bytes(found.pop(1).raw_bytes) == b"signed"
    assert found == {2: None, 3: None, 4: None, 5: None}


def test_tampering_with_any_bound_column_shows(spark):
    ledger = derived.ledger(spark, SMALL)
    assert audit.chain_mismatches(ledger).count() == 0
    victim = F.col("ok") == 17
    for column in ("payload_hex", "zkp_commitment_hex", "perceptual_hash_whash", "account_id"):
        changed = ledger.withColumn(column, F.when(victim, F.lit("0")).otherwise(F.col(column)))
        assert audit.chain_mismatches(changed).count() == 1
    later = F.when(victim, F.col("creation_timestamp") + F.expr("INTERVAL 1 MICROSECOND"))
    changed = ledger.withColumn("creation_timestamp", F.coalesce(later, "creation_timestamp"))
    assert audit.chain_mismatches(changed).count() == 1
    blank = ledger.withColumn("chain_of_custody_hash", F.lit(None).cast("string"))
    assert audit.chain_mismatches(blank).count() == ledger.count()


def test_newest_version_wins_over_many(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("asset_id"),
        F.timestamp_seconds("id").alias("created_at"),
        F.timestamp_seconds("id").alias("updated_at"),
        F.col("id").alias("n"))
    latest = views.current_version(rows)
    assert latest.count() == 1001
    assert latest.filter("asset_id = 'hot'").first().n == 1999


def test_own_account_wins_then_newest(spark):
    ledger = spark.createDataFrame(
        [("old", "me", "p1", 1), ("new", "you", "p1", 2), ("tie-b", "x", "p2", 5), ("tie-a", "y", "p2", 5)],
        "asset_id string, account_id string, payload_hex string, t bigint",
    ).select("asset_id", "account_id", "payload_hex", F.timestamp_seconds("t").alias("created_at"),
             *[F.lit(0).cast("bigint").alias(f"{h}64") for h in ("phash", "dhash", "ahash", "whash")])
    asked = spark.createDataFrame(
        [(1, "p1", "me"), (2, "p1", "nobody"), (3, "p1", None), (4, "p2", None), (5, "p9", "me"), (6, None, "me")],
        "n int, payload_hex string, account_id string")
    got = {r.n: r.found and r.found.asset_id for r in match.match_payload(asked, ledger).collect()}
    assert got == {1: "old", 2: "new", 3: "new", 4: "tie-a", 5: None, 6: None}


def test_busy_key_is_marked_from_the_fourth_request(spark):
    log = spark.range(5000).select(
        F.when(F.col("id") % 3 != 0, "busy").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.lit("embed").alias("route"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 100)).alias("ts"),
        F.col("id").alias("event_id"))
    marked = audit.rate_limit_audit(log, 3)
    assert marked.count() == 5000
    over = {(r.key, r.route, r.window_start): r.n for r in marked.groupBy("key", "route", "window_start").agg(
        F.sum((~F.col("over_limit")).cast("int")).alias("n")).collect()}
    assert max(over.values()) == 3
    plan = marked._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_challenge_outcomes(spark):
    def token(nonce, iat, exp, mac):
        return audit.challenge_token(F.lit(nonce), F.lit(iat), F.lit(exp), mac)

    def mac(account, nonce, iat, exp):
        return audit.challenge_mac(F.lit(account), F.lit(nonce), F.lit(iat), F.lit(exp), MASTER)

    good = token("n1", 100, 400, mac("acct", "n1", 100, 400))
    rows = [
        (1, "acct", good, 150), (2, "acct", good, 160), (3, "other", good, 150),
        (4, "acct", token("n2", 100, 400, mac("acct", "n2", 100, 400)), 401),
        (5, "acct", token("n3", 100, 400, F.upper(mac("acct", "n3", 100, 400))), 400),
        (6, "acct", token("n4", 100, 400, F.lit("00")), 150), (7, "acct", F.lit("no dot"), 150),
        (8, "acct", F.lit("!!.ff"), 150)]
    log = None
    for number, account, text, seen in rows:
        one = spark.range(1).select(F.lit(number).cast("bigint").alias("event_id"), F.lit(account).alias("account_id"),
                                    text.alias("token"), F.timestamp_seconds(F.lit(seen)).alias("seen_at"))
        log = one if log is None else log.unionByName(one)
    got = {r.event_id: r.outcome for r in audit.challenge_audit(log, MASTER).collect()}
    assert got == {1: "OK", 2: "REPLAYED", 3: "BAD_MAC", 4: "EXPIRED", 5: "OK", 6: "BAD_MAC",
                   7: "MALFORMED", 8: "MALFORMED"}


def test_whole_rows_are_not_shuffled_to_find_new_ids(spark, tmp_path):
    claims = derived.claims(spark, SMALL).drop("ok")
    path = str(tmp_path / "ledger")
    some = claims.filter("created_at < '1993-01-01'")
    source.register(some.unionByName(some.limit(7)), path, MASTER)
    assert source.read_ledger(spark, path).count() == some.count()
    bound = source.bind_claims(claims, MASTER)
    for batch, new in ((claims, claims.count() - some.count()), (some, 0), (claims.unionByName(claims.limit(9)), claims.count() - some.count())):
        rows = source._fresh(source.bind_claims(batch, MASTER), source.read_ledger(spark, path))
        assert rows.count() == new == rows.select("asset_id").distinct().count()
    fresh = source._fresh(bound, source.read_ledger(spark, path))
    assert "hashpartitioning" not in fresh._jdf.queryExecution().executedPlan().toString()
    source.register(claims, path, MASTER)
    stored = source.read_ledger(spark, path)
    assert stored.count() == claims.count()
    wrong = stored.filter(~(F.col("chain_of_custody_hash") == chain_hash()) | (F.col("phash64") != hex_to_i64("perceptual_hash_phash")))
    assert wrong.isEmpty()


def test_the_public_view_sends_no_text_that_follows_from_other_columns(spark):
    ledger, images = derived.ledger(spark, SMALL).drop("ok"), derived.ledger_images(spark, SMALL)
    view = views.public_view(ledger.hint("merge"), images)
    plan = view._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin") :]
    assert "/api/v1/asset/" in plan and "/api/v1/asset/" not in below
    assert view.columns[0] == "asset_id" and view.columns[-1] == "image_available"
    assert view.filter("image_available").count() == images.filter("image_bytes > 0").count()
