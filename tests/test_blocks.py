"""Watermark round trips and image sources, on images the tests write themselves."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from conftest import MASTER
from pyspark.sql import functions as F

from hallmark.functions import hex_to_i64
from hallmark.operators import blocks, codewords, fingerprints, match
from hallmark.operators.arrays import dct_basis
from hallmark.settings import HASHES
from hallmark.sources import images as image_source


def png(pixels: np.ndarray) -> bytes:
    """RGB or grey PNG of an array."""
    height, width = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def noise(seed: int, height: int, width: int, low: int = 0, high: int = 255) -> np.ndarray:
    return np.random.default_rng(seed).integers(low, high, (height, width, 3), dtype=np.uint8)


def gradient(seed: int, side: int = 256) -> np.ndarray:
    ramp = np.linspace(60, 190, side)[None, :, None]
    grain = np.random.default_rng(seed).normal(0, 12, (side, side, 3))
    return np.clip(ramp + grain, 0, 255).astype(np.uint8)


def image_table(spark, arrays):
    return spark.createDataFrame(
        [(str(n), a.shape[0], a.shape[1], bytearray(a.tobytes())) for n, a in enumerate(arrays)],
        "image_id string, height int, width int, data binary",
    )


def claims(spark, count):
    rows = spark.createDataFrame(
        [(str(n), f"{n + 1:02x}" * 16) for n in range(count)], "image_id string, payload_hex string"
    )
    return codewords.encode_codewords(rows)


def test_basis_is_orthonormal():
    for n in (8, 32):
        assert np.allclose(dct_basis(n) @ dct_basis(n).T, np.eye(n))


def test_blocks_follow_raster_order(spark):
    array = noise(1, 130, 141)
    got = blocks.image_blocks(image_table(spark, [array])).orderBy("block_idx").collect()
    b, g, r = (array[:, :, n].astype(int) for n in range(3))
    y = (299 * r + 587 * g + 114 * b + 500) // 1000
    assert [row.block_idx for row in got] == list(range(100))
    for row in got:
        top, left = row.block_idx // 17 * 8, row.block_idx % 17 * 8
        assert row.y == y[top : top + 8, left : left + 8].reshape(-1).astype(float).tolist()


def test_round_trip_on_pixels(spark):
    arrays = [noise(n, 128, 128 + 8 * n) for n in range(3)] + [gradient(42)]
    plain, words = image_table(spark, arrays), claims(spark, len(arrays))
    coefs = blocks.block_dct(blocks.image_blocks(plain))
    marked = blocks.embed_bits(coefs, words.select("image_id", "codeword"))
    changed = blocks.write_luminance(plain, blocks.to_pixels(blocks.block_idct(marked)))
    quality = {r.image_id: r.psnr_db for r in blocks.image_psnr(plain, changed).collect()}
    assert all(q > 25 for q in quality.values()) and quality["3"] > 30
    read = blocks.extract_codewords(blocks.image_blocks(changed))
    got = codewords.match_codeword(read, words).collect()
    right = {r.image_id: r.payload_hex for r in words.collect()}
    assert {r.image_id: r.payload_hex for r in got} == right
    shaken = changed.withColumn("data", _shaken("data"))  # noise of sigma 3
    again = codewords.match_codeword(
        blocks.extract_codewords(blocks.image_blocks(shaken)), words
    ).collect()
    assert {r.image_id: r.payload_hex for r in again} == right


def _shaken(column):
    @F.pandas_udf("binary")
    def shake(series):
        rng = np.random.default_rng(5)
        return series.map(
            lambda d: np.clip(
                np.frombuffer(d, np.uint8) + rng.normal(0, 3, len(d)), 0, 255
            ).astype(np.uint8).tobytes()
        )

    return shake(column)


def test_extraction_shuffles_narrow_rows_once(spark):
    table = spark.range(3).select(
        F.col("id").cast("string").alias("image_id"), F.lit(1).alias("block_idx"),
        F.array([F.lit(1.0)] * 64).alias("y"),
    )
    plan = blocks.extract_codewords(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2
    assert all("coef" not in line for line in plan.splitlines() if "Exchange hash" in line)


def test_missing_blocks_are_reported(spark):
    rows = spark.createDataFrame(
        [("a", b, 5) for b in range(4, 100)] + [("b", b, 5) for b in range(4, 99)],
        "image_id string, block_idx int, nibble int",
    )
    got = {r.image_id: (r.codeword, r.status) for r in blocks.pack_codeword(rows).collect()}
    assert bytes(got["a"][0]) == b"\x55" * 48
    assert got["b"] == (None, "DECODE_FAILED:insufficient_bits")


def test_flat_sync_blocks_have_gain_one(spark):
    rows = spark.createDataFrame(
        [("a", b, 0.0) for b in range(4)] + [("b", b, 57.0 if b else 60.0) for b in range(4)],
        "image_id string, block_idx int, sync double",
    )
    got = {r.image_id: r.gain for r in blocks.sync_gain(rows).collect()}
    assert got["a"] == 1.0 and abs(got["b"] - 57 / 60) < 1e-12


def test_equal_images_have_the_ceiling(spark):
    table = image_table(spark, [noise(3, 128, 128)])
    assert blocks.image_psnr(table, table).first().psnr_db == 99.0
    b = blocks.image_blocks(table)
    assert blocks.psnr(b, b).first().psnr_db == 99.0


def py_hashes(grid8, grid9, grid32):
    def pack(bits):
        return np.packbits(np.asarray(bits).reshape(-1)).tobytes().hex()

    d = dct_basis(32)
    low = (d @ grid32 @ d.T)[:8, :8]
    cells = grid32.reshape(8, 4, 8, 4).mean(axis=(1, 3))
    return {
        "ahash": pack(grid8 > grid8.mean()),
        "dhash": pack(grid9[:, 1:] > grid9[:, :-1]),
        "whash": pack(cells > np.median(cells)),
        "phash": pack(low > np.median(low[1:, 1:])),
    }


def test_hashes_of_images(spark):
    array = noise(11, 144, 160)
    b, g, r = (array[:, :, n].astype(int) for n in range(3))
    y = ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(float)
    area = blocks._area_weights

    def grid(rows, cols):
        return area(rows, 144) @ y @ area(cols, 160).T

    assert np.allclose(grid(8, 8), y.reshape(8, 18, 8, 20).mean(axis=(1, 3)))
    got = fingerprints.hash_images(image_table(spark, [array, array])).collect()
    want = py_hashes(grid(8, 8), grid(8, 9), grid(32, 32))
    for row in got:
        assert {h: row[h] for h in HASHES} == want
    mirrored = fingerprints.hash_images(image_table(spark, [array[:, ::-1]])).first()
    assert mirrored.phash != want["phash"]


def test_read_and_reject_images(spark, tmp_path):
    good, grey = noise(1, 130, 129), noise(2, 128, 128)[:, :, 0]
    (tmp_path / "good.png").write_bytes(png(good[:, :, ::-1]))
    (tmp_path / "grey.png").write_bytes(png(np.ascontiguousarray(grey)))
    (tmp_path / "small.png").write_bytes(png(noise(3, 64, 64)))
    (tmp_path / "broken.png").write_bytes(b"not an image at all")
    read = image_source.validate_images(image_source.read_images(spark, str(tmp_path)))
    usable, rejects = image_source.split_rejects(read)
    names = {r.image_id.rsplit("/", 1)[-1]: r for r in usable.collect()}
    assert set(names) == {"good.png", "grey.png"}
    assert bytes(names["good.png"].data) == good.tobytes()  # B, G, R
    assert names["grey.png"].channels == 1
    codes = {r.image_id.rsplit("/", 1)[-1]: r.error_detail for r in rejects.collect()}
    assert codes == {"small.png": "too small", "broken.png": "undecodable"}
    assert blocks.image_blocks(usable).count() == 200
    assert fingerprints.hash_images(usable).count() == 2
    small = blocks.preview(usable).collect()
    assert all(len(r.data) == 128 * 128 * 3 for r in small)


@pytest.fixture(scope="module")
def cascade(spark):
    """Four registered images, marked; and a ledger that knows three of them."""
    arrays = [noise(n + 50, 128, 136) for n in range(4)]
    plain, words = image_table(spark, arrays), claims(spark, 4)
    coefs = blocks.block_dct(blocks.image_blocks(plain))
    marked = blocks.embed_bits(coefs, words.select("image_id", "codeword"))
    changed = blocks.write_luminance(plain, blocks.to_pixels(blocks.block_idct(marked)))
    hashes = fingerprints.hash_images(plain)
    ledger = (
        hashes.join(words, "image_id")
        .filter("image_id <> '3'")
        .select(
            F.concat(F.lit("asset-"), "image_id").alias("asset_id"),
            F.concat(F.lit("acct-"), "image_id").alias("account_id"),
            "payload_hex",
            F.lit("x://none").alias("c2pa_manifest_reference"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("creation_timestamp"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
            *[F.col(h).alias(f"perceptual_hash_{h}") for h in HASHES],
            *[hex_to_i64(h).alias(f"{h}64") for h in HASHES],
        )
    )
    return changed, ledger


def test_cascade_from_pixels(spark, cascade):
    changed, ledger = cascade
    tiny = image_table(spark, [noise(9, 64, 64)]).withColumn("image_id", F.lit("tiny"))
    tiny = tiny.unionByName(tiny.withColumns({"image_id": F.lit("null"), "height": F.lit(None).cast("int"), "width": F.lit(None).cast("int"), "data": F.lit(None).cast("binary")}))
    got = {r.image_id: r for r in match.extract_and_lookup(changed.unionByName(tiny), ledger).collect()}
    for n in "012":
        assert got[n].status == "MATCH_FOUND" and got[n].asset_id == f"asset-{n}"
        assert got[n].ledger_match.payload_match
    # its payload is read whole or, where damaged, not at all: nobody registered it
    assert got["3"].status in ("PAYLOAD_EXTRACTED", "NO_PAYLOAD")
    assert got["tiny"].status == got["null"].status == "INVALID_IMAGE"


def test_verify_from_pixels(cascade):
    changed, ledger = cascade
    claimed = F.when(F.col("image_id") == "1", "asset-0").otherwise(F.concat(F.lit("asset-"), "image_id"))
    got = {r.image_id: r for r in match.verify(changed.withColumn("asset_id", claimed), ledger).collect()}
    assert got["0"].verified and got["2"].verified
    assert not got["1"].verified and got["1"].status != "ASSET_NOT_FOUND"
    assert got["3"].status == "ASSET_NOT_FOUND"


def test_no_blocks_or_images_are_broadcast(spark):
    """The planner takes exploded blocks and images for as small as the ids they come from."""
    ids = spark.range(3).select(F.col("id").cast("string").alias("image_id"))
    plain = ids.select("image_id", F.lit(128).alias("height"), F.lit(128).alias("width"), F.unhex(F.repeat(F.lit("00"), 49152)).alias("data"))
    tiles = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("block_idx"))
    tiles = tiles.withColumn("y", F.array([F.lit(1.0)] * 64))
    words = ids.select("image_id", F.unhex(F.repeat(F.lit("00"), 48)).alias("codeword"))
    marked = blocks.embed_bits(blocks.block_dct(tiles), words)
    changed = blocks.write_luminance(plain, blocks.to_pixels(blocks.block_idct(marked)))
    for made in (blocks.psnr(tiles, tiles), marked, changed, blocks.image_psnr(plain, changed), blocks.extract_codewords(tiles)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_kernels_hold_few_images_at_a_time():
    import pyarrow as pa

    from hallmark.operators.arrays import HELD_IMAGES, pieces

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (0, 1, 10_000)]
    cut = list(pieces(iter(batches)))
    assert max(b.num_rows for b in cut) == HELD_IMAGES
    assert [x for b in cut for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
