"""Streams give what the batch gives; late rows and used nonces drop."""

from __future__ import annotations

from conftest import MASTER, SMALL
from pyspark.sql import functions as F

from hallmark import streaming
from hallmark.plans import derived
from hallmark.sources import ledger as source


def arrivals(spark, folder, frames):
    """A file stream that sees one frame per batch."""
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")
    return (
        spark.readStream.schema(frames[0].schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(folder)
    )


def drained(stream, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_claims_register_once_across_batches_and_reruns(spark, tmp_path):
    claims = derived.claims(spark, SMALL).drop("ok")
    half = claims.filter("created_at < '1998-01-01'")
    frames = [half, claims.filter("created_at >= '1998-01-01'"), half]
    stream = arrivals(spark, str(tmp_path / "in"), frames)
    path = str(tmp_path / "ledger")
    for checkpoint in ("a", "b"):  # a lost checkpoint replays everything
        streaming.register_stream(stream, path, str(tmp_path / checkpoint), MASTER).awaitTermination()
        assert source.read_ledger(spark, path).count() == claims.count()


def test_late_requests_drop(spark, tmp_path):
    def log(*seconds):
        return spark.createDataFrame([("k", "read", s) for s in seconds], "key string, route string, s bigint").select(
            "key", "route", F.timestamp_seconds("s").alias("ts"))

    # lateness is judged by the watermark of the batch before the last
    frames = [log(0, 1, 2, 61), log(600), log(605), log(3, 601), log(1200)]
    got = drained(streaming.rate_limit_stream(arrivals(spark, str(tmp_path / "in"), frames), 2), "windows")
    seen = {r.window_start.timestamp(): (r.requests, r.over_limit) for r in got.collect()}
    assert {round(k) % 3600: v for k, v in seen.items()} == {0: (3, 1), 60: (1, 0), 600: (3, 1)}


def test_nonces_pass_once(spark, tmp_path):
    def seen(*rows):
        return spark.createDataFrame(rows, "account_id string, nonce string, s bigint").select(
            "account_id", "nonce", F.timestamp_seconds("s").alias("seen_at"))

    frames = [seen(("a", "n1", 10), ("b", "n1", 11)), seen(("a", "n1", 200), ("a", "n2", 300)),
              seen(("a", "n2", 700))]
    got = drained(streaming.replay_stream(arrivals(spark, str(tmp_path / "in"), frames)), "nonces")
    assert sorted((r.account_id, r.nonce) for r in got.collect()) == [("a", "n1"), ("a", "n2"), ("b", "n1")]


def test_the_ttl_decides_whatever_the_batches(spark, tmp_path):
    times = [(1000, "a"), (1500, "a"), (1599, "a"), (1600, "a"), (9000, "a"), (9100, "b"), (9300, "a"), (9301, None), (9700, "a")]
    rows = spark.createDataFrame([(a, "n", s, None) for s, a in times], "account_id string, nonce string, s bigint, empty bigint")
    rows = rows.withColumn("seen_at", F.timestamp_seconds("s"))
    for name, step in (("whole", 100), ("pairs", 2), ("single", 1)):
        frames = [rows.filter(F.col("s").isin([s for s, _ in times[k : k + step]])) for k in range(0, len(times), step)]
        got = drained(streaming.replay_stream(arrivals(spark, str(tmp_path / name), frames)), f"ttl_{name}")
        assert sorted(r.s for r in got.collect()) == [1000, 1600, 9000, 9100, 9301, 9700]
        assert got.schema.names == rows.schema.names and got.filter("empty IS NOT NULL").isEmpty()


def test_nonces_share_the_calls_of_their_bucket(spark, tmp_path):
    def seen(*rows):
        return spark.createDataFrame(rows, "account_id string, nonce string, s bigint").withColumn("seen_at", F.timestamp_seconds("s"))

    frames = [
        seen(*[(f"a{n % 7}", f"n{n}", 10 + n % 50) for n in range(300)], (None, "n1", 10), ("n1", None, 10)),
        seen(*[(f"a{n % 7}", f"n{n}", 500) for n in range(300)], ("a0", "new", 501), (None, "n1", 610)),
        seen(("a1", "n1", 5000), ("a0", "new", 5001), ("a2", "n2", 5000), ("a2", "n2", 5599)),
    ]
    for buckets in (1, 3):
        stream = arrivals(spark, str(tmp_path / f"in{buckets}"), frames)
        got = drained(streaming.replay_stream(stream, buckets=buckets), f"shared_{buckets}").collect()
        assert len(got) == len({(r.account_id, r.nonce, r.s) for r in got}) == 302 + 2 + 3
        assert {r.s for r in got if r.s > 60} == {501, 610, 5000, 5001}


def test_stream_matches_like_the_batch(spark, tmp_path):
    from hallmark.operators.match import lookup

    ledger = derived.reregistered(spark, SMALL)
    suspects = derived.mixed_suspects(spark, SMALL)
    frames = [suspects.filter(F.col("ok") % 2 == n) for n in (0, 1)]
    out = str(tmp_path / "out")
    stream = arrivals(spark, str(tmp_path / "in"), frames)
    for _ in range(2):  # the second run finds nothing new
        streaming.match_stream(stream, ledger, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out).select("image_id", "status", "asset_id")
    want = lookup(suspects, ledger).select("image_id", "status", "asset_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
