"""Claims, images and hashes at the edges: each gives a row, and the right one."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from conftest import MASTER
from pyspark.sql import functions as F
from test_blocks import claims, image_table, noise

from hallmark import functions as fn
from hallmark import session
from hallmark.operators import blocks, codewords, embed, fingerprints, match, reading, search
from hallmark.settings import HASHES
from hallmark.sources import ledger as source

UTC = datetime.timezone.utc


def timed(spark, times, arrived="2024-05-01 10:00:00"):
    rows = [(f"acct-{n}", "dev", t, f"{n:02x}") for n, t in enumerate(times)]
    table = spark.createDataFrame(rows, "account_id string, device_signature string, t string, b string")
    return table.select(
        "account_id", "device_signature", F.col("t").cast("timestamp").alias("creation_timestamp"),
        F.lit(arrived).cast("timestamp").alias("created_at"), F.encode("b", "utf-8").alias("watermarked_image"),
        *[F.repeat("b", F.lit(8)).alias(f"perceptual_hash_{h}") for h in HASHES],
    )


def test_claims_without_a_time_are_of_their_arrival(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = timed(spark, [None, "1970-01-01 00:00:00", "2023-01-02 03:04:05"])
    source.register(batch.filter("creation_timestamp IS NULL"), path, MASTER)
    for _ in range(2):
        source.register(batch, path, MASTER)
    rows = source.read_ledger(spark, path).select("account_id", F.unix_seconds("creation_timestamp").alias("s")).collect()
    arrived = int(datetime.datetime(2024, 5, 1, 10, tzinfo=UTC).timestamp())
    given = int(datetime.datetime(2023, 1, 2, 3, 4, 5, tzinfo=UTC).timestamp())
    assert sorted(tuple(r) for r in rows) == [("acct-0", arrived), ("acct-1", arrived), ("acct-2", given)]
    assert source.read_ledger_images(spark, path).count() == 3


def test_a_batch_without_arrival_is_of_one_time(spark, tmp_path):
    path = str(tmp_path / "ledger")
    source.register(timed(spark, [None, None]).drop("created_at"), path, MASTER)
    ledger, images = source.read_ledger(spark, path), source.read_ledger_images(spark, path)
    assert ledger.join(images, "asset_id").count() == 2
    assert ledger.select("created_at").distinct().count() == 1


def test_left_over_images_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = timed(spark, ["2023-01-02 03:04:05"])
    ids = source.bind_claims(batch, MASTER).select("asset_id", "watermarked_image", F.lit(2).cast("bigint").alias("image_bytes"))
    ids.write.parquet(f"{path}/images")
    source.register(batch, path, MASTER)
    assert source.read_ledger_images(spark, path).count() == source.read_ledger(spark, path).count() == 1


def test_payloads_of_missing_fields_differ(spark):
    rows = spark.createDataFrame([("a", None, "d"), ("a", "d", None), ("a", "d", "")], "a string, b string, c string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    made = rows.select(fn.payload_hex("a", F.when(F.col("b").isNotNull(), at), "c", MASTER).alias("p"))
    got = [r.p for r in made.collect()]
    assert None not in got and got[0] != got[1] == got[2]


def odd_images(spark):
    good = image_table(spark, [noise(3, 128, 136)])
    rows = [("gone", -1, -1, bytearray()), ("none", None, None, None), ("small", 96, 96, bytearray(96 * 96 * 3)), ("long", 8, 8000, bytearray(8 * 8000 * 3))]
    return good.unionByName(spark.createDataFrame(rows, good.schema)).withColumn("asset_id", F.concat(F.lit("of-"), "image_id"))


def test_each_image_gives_a_row(spark):
    images = odd_images(spark)
    ledger = spark.createDataFrame(
        [], "asset_id string, account_id string, payload_hex string, creation_timestamp timestamp, created_at timestamp, "
        "c2pa_manifest_reference string, " + ", ".join(f"perceptual_hash_{h} string" for h in HASHES),
    )
    bad = {"gone", "none", "small", "long"}
    looked = {r.image_id: r.status for r in match.extract_and_lookup(images, ledger).collect()}
    assert set(looked) == bad | {"0"} and {k for k, v in looked.items() if v == "INVALID_IMAGE"} == bad
    checked = {r.image_id: r for r in match.verify(images, ledger).collect()}
    assert {k for k, r in checked.items() if r.status == "INVALID_IMAGE"} == bad
    assert checked["0"].status == "ASSET_NOT_FOUND" and checked["gone"].asset_id == "of-gone"
    rejects = {r.image_id: r.status for r in embed.embed_rejects(images, images.filter("image_id = 'small'")).collect()}
    assert rejects == dict.fromkeys(bad, "INVALID_IMAGE") | {"0": "NO_CLAIM"}


def test_fused_reading_equals_the_block_operators(spark):
    arrays = [noise(n, 128 + 8 * n, 128 + 9 * n) for n in range(4)] + [noise(9, 130, 131)[:, :, :1]]
    plain, words = image_table(spark, arrays), claims(spark, 5)
    marked = blocks.embed_bits(blocks.block_dct(blocks.image_blocks(plain)), words.select("image_id", "codeword"))
    changed = blocks.write_luminance(plain, blocks.to_pixels(blocks.block_idct(marked)))
    for images in (plain, changed):
        step_by_step = fingerprints.hash_images(images).join(
            blocks.extract_codewords(blocks.image_blocks(images)).select("image_id", "codeword"), "image_id"
        )
        fused = reading.read_all(images).select(step_by_step.columns)
        assert sorted(map(str, fused.collect())) == sorted(map(str, step_by_step.collect()))


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_images_of_any_channels_are_marked(spark, depth):
    pixels = np.random.default_rng(depth).integers(40, 200, (128, 128, depth), dtype=np.uint8)
    images = image_table(spark, [pixels])
    claim = spark.createDataFrame([("0", "acct", "dev", 1.7e9)], "image_id string, account_id string, device_signature string, t double")
    claim = claim.withColumn("creation_timestamp", F.timestamp_seconds("t"))
    row = embed.embed_images(images, claim, MASTER).first()
    assert len(row.watermarked_image) == 128 * 128 * 3 and row.psnr_db > 25


def test_a_lone_tile_goes_where_it_belongs(spark):
    images = image_table(spark, [np.full((128, 128, 3), 90, np.uint8)])
    tile = spark.createDataFrame([("0", 5, [200.0] * 64)], "image_id string, block_idx int, y array<double>")
    far = tile.withColumn("block_idx", F.lit(120)).unionByName(tile)
    data = blocks.write_luminance(images, far).first().data
    out = np.frombuffer(bytes(data), np.uint8).reshape(128, 128, 3)
    assert (out[:8, 40:48] == 200).all() and (out[56:64, 64:72] == 200).all() and (out[:8, :40] == 90).all()


def test_long_and_broken_hashes(spark):
    rows = [("a", "f" * 16), ("b", "f" * 18), ("c", "zz"), ("d", None), ("e", "f" * 14 + "fe")]
    ledger = spark.createDataFrame(rows, "asset_id string, perceptual_hash_phash string")
    got = {r.asset_id: r.distance for r in search.search_hash(ledger, "phash", "f" * 16, max_distance=None).filter("distance IS NOT NULL").collect()}
    assert got["a"] == 0 and got["e"] == 1 and got["b"] == 72
    nearest = search.nearest_match(
        ledger.select(F.col("asset_id").alias("query_id"), "perceptual_hash_phash"),
        ledger.select(F.monotonically_increasing_id().alias("idx"), "perceptual_hash_phash"),
    )
    assert nearest.count() == len(rows)


def test_each_hash_has_its_default_distance(spark):
    rows = [(str(k), f"{(1 << k) - 1:016x}") for k in range(13)]
    ledger = spark.createDataFrame(rows, "asset_id string, h string").select("asset_id", *[F.col("h").alias(f"perceptual_hash_{h}") for h in HASHES])
    zero = "0" * 16
    assert search.search_hash(ledger, "phash", zero).count() == 11
    assert search.search_hash(ledger, "dhash", zero).count() == 9


def test_intact_words_need_no_ledger_codewords(spark, monkeypatch):
    ledger = spark.createDataFrame([("ab" * 16,), (None,), ("CD" * 16,)], "payload_hex string")
    words = codewords.encode_codewords(spark.createDataFrame([("1", "ab" * 16), ("2", "ef" * 16), ("3", "cd" * 16), ("4", None)], "id string, payload_hex string"))
    monkeypatch.setattr(codewords, "codeword_pairs", lambda *_: pytest.fail("no word is damaged"))
    got = {r.id: r for r in codewords.match_codeword(words.drop("payload_hex"), ledger).collect()}
    assert (got["1"].payload_hex, got["1"].byte_errors) == ("ab" * 16, 0) and got["3"].payload_hex == "cd" * 16
    assert got["2"].payload_hex is None and got["4"].payload_hex is None


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802
        return self.folder


class _Session:
    def __init__(self, master, named=None, folder=None):
        self.sparkContext, self.conf = _Context(master, folder), {"spark.checkpoint.dir": named} if named else {}


def test_shared_folder_or_an_error():
    assert session.shared_dir(_Session("yarn", "hdfs:///x")) == "hdfs:///x"
    assert session.shared_dir(_Session("spark://h:1", None, "s3://y")) == "s3://y"
    assert session.shared_dir(_Session("local[8]"))
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(_Session(master))
