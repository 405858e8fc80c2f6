"""Ledger, suspects, logs and images derived from the given tables.

Every table here covers the whole table that it comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    account_public_key,
    chain_hash,
    hex_to_i64,
    i64_to_hex,
    payload_hex,
    uuid_text,
)
from ..operators.arrays import byte_matrix, lists
from ..operators.audit import challenge_mac, challenge_token
from ..operators.codewords import codeword_of
from ..schema import LEDGER_COLUMNS
from ..settings import CODEWORD_BYTES, HASHES

MASTER = b"fixture_only_master_key_32_bytes"
#: Openings (value, randomness) that commitments are made of, small and large.
OPENINGS = tuple((3 ** (31 * k) - 1, 5 ** (21 * k + 1)) for k in range(37))
FLIPPED_BITS = 13
DAMAGED_BYTES = 20
BLOCKS_PER_IMAGE = 128
IMAGE_HEIGHT = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings`, spread over the cores: each row grows into a whole image."""
    tasks = spark.sparkContext.defaultParallelism
    return table(spark, sf_dir, "embeddings").repartition(tasks)


def _seconds(count: Column) -> Column:
    return F.make_dt_interval(secs=count)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients send: one claim per order."""
    ok = F.col("o_orderkey")
    digest = F.sha2(F.concat(F.lit("hash|"), ok.cast("string")), 256)
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        ok.alias("ok"),
        F.concat(F.lit("acct-"), F.col("o_custkey")).alias("account_id"),
        F.concat(F.lit("dev-"), ok % 7).alias("device_signature"),
        (day + _seconds(ok)).alias("creation_timestamp"),
        (day + _seconds(ok + ok % 3600)).alias("created_at"),
        *[
            F.substring(digest, 16 * n + 1, 16).alias(f"perceptual_hash_{h}")
            for n, h in enumerate(HASHES)
        ],
        F.sha2(F.concat(F.lit("c|"), ok.cast("string")), 256).alias(
            "zkp_commitment_hex"
        ),
        F.concat(F.lit("img_"), ok, F.lit(".png")).alias("original_filename"),
        F.when(ok % 10 == 0, F.concat(F.lit("note "), ok)).alias("notes"),
        (ok % 5 == 0).alias("c2pa_embedded"),
        (1000 + ok % 9000).cast("bigint").alias("file_size_bytes"),
        (128 + ok % 64).cast("int").alias("image_width"),
        (128 + ok % 32).cast("int").alias("image_height"),
        F.when(ok % 11 != 0, 38 + (ok % 70) / 8.0).alias("psnr_db"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full ledger rows plus `ok`, the order key."""
    ok = F.col("ok")
    asset = uuid_text(F.md5(F.concat(F.lit("asset|"), ok.cast("string")).cast("binary")))
    manifest = F.substring(F.md5(F.concat(F.lit("m|"), ok.cast("string")).cast("binary")), 1, 32)
    return (
        claims(spark, sf_dir)
        .withColumns(
            {
                "asset_id": asset,
                "payload_hex": payload_hex(
                    "account_id", "creation_timestamp", "device_signature", MASTER
                ),
                "account_public_key": account_public_key("account_id", MASTER),
                "zkp_opening_value": F.lit(None).cast("string"),
                "zkp_opening_randomness": F.lit(None).cast("string"),
                "c2pa_manifest_uuid": manifest,
                "generator_model_id": F.lit("hallmark engine/1.0.0"),
                "content_type": F.lit("image/png"),
                "updated_at": F.col("created_at"),
            }
        )
        .withColumns(
            {
                "c2pa_manifest_reference": F.when(
                    F.col("c2pa_embedded"),
                    F.concat(F.lit("manifests/"), "c2pa_manifest_uuid", F.lit(".c2pa")),
                ).otherwise(
                    F.concat(F.lit("hallmark://manifest/"), "c2pa_manifest_uuid")
                ),
                "chain_of_custody_hash": chain_hash(),
                **{f"{h}64": hex_to_i64(f"perceptual_hash_{h}") for h in HASHES},
            }
        )
        .select("ok", *LEDGER_COLUMNS)
    )


def ledger_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table: every third asset has lost its bytes."""
    return ledger(spark, sf_dir).select(
        "asset_id",
        F.when(F.col("ok") % 3 != 0, F.col("file_size_bytes"))
        .otherwise(0)
        .cast("bigint")
        .alias("image_bytes"),
    )


def _flipped(column: str, bits: Column) -> Column:
    return F.col(column).bitwiseXOR(F.expr("shiftleft(1L, flips) - 1"))


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ledger row with its low `flips` pHash bits inverted."""
    flips = (F.col("ok") % FLIPPED_BITS).cast("int")
    return (
        ledger(spark, sf_dir)
        .withColumn("flips", flips)
        .withColumn("phash64", _flipped("phash64", F.col("flips")))
        .select(
            F.col("ok").alias("query_id"),
            "flips",
            i64_to_hex("phash64").alias("phash"),
            "phash64",
            F.when(F.col("ok") % 2 == 0, F.col("account_id")).alias("account_id"),
        )
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ledger(spark, sf_dir).drop("ok")
    second = (
        ledger(spark, sf_dir)
        .filter(F.col("ok") % 50 == 0)
        .drop("ok")
        .withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY"))
        .withColumn("notes", F.lit("v2"))
    )
    return first.unionByName(second)


def reregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, with some payloads registered again by another account."""
    first = ledger(spark, sf_dir)
    again = first.filter(F.col("ok") % 50 == 0).withColumns(
        {
            "asset_id": F.md5(F.concat(F.lit("re|"), F.col("ok").cast("string")).cast("binary")),
            "account_id": F.lit("acct-x"),
            "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    return first.unionByName(again)


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(
        F.col("ok") % 97 == 0, F.concat("account_id", F.lit("-t"))
    ).otherwise(F.col("account_id"))
    return ledger(spark, sf_dir).withColumn("account_id", changed)


def damaged_codeword(codeword: Column, count: Column) -> Column:
    """First `count` bytes inverted."""
    text = F.hex(codeword)
    digits = (2 * count).cast("int")
    damaged = F.translate(
        F.substring(text, F.lit(1), digits), "0123456789ABCDEF", "FEDCBA9876543210"
    )
    whole = F.substring(text, digits + 1, F.lit(2 * CODEWORD_BYTES))
    return F.unhex(F.concat(damaged, whole))


def codeword_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered codeword with 0..19 bytes inverted."""
    return ledger(spark, sf_dir).select(
        F.col("ok").alias("query_id"),
        damaged_codeword(
            codeword_of(F.col("payload_hex")), F.col("ok") % DAMAGED_BYTES
        ).alias("codeword"),
    )


def mixed_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects for the whole cascade, by `ok % 4`.

    0: registered payload, damaged; 1: a payload nobody registered, with a known
    look; 2: no readable payload; 3: registered, intact, account given.
    """
    ok, kind = F.col("ok"), F.col("ok") % 4
    stray = F.substring(F.sha2(F.concat(F.lit("stray|"), ok.cast("string")).cast("binary"), 256), 1, 32)
    carried = F.when(kind == 1, stray).otherwise(F.col("payload_hex"))
    count = F.when(kind == 0, ok % DAMAGED_BYTES).otherwise(0)
    return (
        ledger(spark, sf_dir)
        .withColumn("flips", (ok % FLIPPED_BITS).cast("int"))
        .withColumn("phash64", _flipped("phash64", F.col("flips")))
        .withColumn("_word", codeword_of(carried))
        .select(
            ok.cast("string").alias("image_id"),
            "ok",
            F.when(kind != 2, damaged_codeword(F.col("_word"), count)).alias("codeword"),
            F.when(kind == 3, F.col("account_id")).alias("account_id"),
            *[F.col(f"{h}64") for h in HASHES],
        )
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"),
        F.lit("read").alias("route"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def challenge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    issued = F.unix_seconds(F.col("ts").cast("timestamp"))
    nonce = F.substring(
        F.md5(
            F.concat_ws("|", F.lit("n"), "user_id", F.floor(event / 50)).cast("binary")
        ),
        1,
        22,
    )
    named = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("acct-"), F.col("user_id")).alias("account_id"),
        nonce.alias("nonce"),
        issued.alias("iat"),
        (issued + 300).alias("exp"),
        (F.col("ts").cast("timestamp") + _seconds(event % 400)).alias("seen_at"),
    )
    right = challenge_mac(
        F.col("account_id"), F.col("nonce"), F.col("iat"), F.col("exp"), MASTER
    )
    mac = F.when(event % 11 == 0, F.reverse(right)).otherwise(right)
    token = challenge_token(F.col("nonce"), F.col("iat"), F.col("exp"), mac)
    token = F.when(event % 101 == 0, F.substring(token, 1, 20)).otherwise(token)
    return named.select("event_id", "account_id", "seen_at", token.alias("token"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _byte_values(cells: pa.Array) -> pa.Array:
    return lists(byte_matrix(cells, 64).astype(np.float64))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise blocks: 128 per vector, values from two digests each."""
    numbered = vectors(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.explode(F.sequence(F.lit(0), F.lit(BLOCKS_PER_IMAGE - 1))).alias("block_idx"),
    )
    halves = [
        F.sha2(
            F.concat_ws("|", F.lit("b"), "image_id", "block_idx", F.lit(n)).cast("binary"),
            256,
        )
        for n in "01"
    ]
    return numbered.withColumn("_h", F.concat(*halves)).select(
        "image_id", "block_idx", _byte_values(F.unhex("_h")).alias("y")
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise images in BGR bytes, one per vector, of three widths."""
    sized = vectors(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.lit(IMAGE_HEIGHT).alias("height"),
        (128 + 8 * (F.col("vec_id") % 3)).cast("int").alias("width"),
    )
    digests = F.col("width") * IMAGE_HEIGHT * 3 / 32
    noise = F.transform(
        F.sequence(F.lit(0), digests.cast("int") - 1),
        lambda i: F.sha2(
            F.concat_ws("|", F.lit("px"), F.col("image_id"), i).cast("binary"), 256
        ),
    )
    return sized.withColumn("data", F.unhex(F.array_join(noise, "")))


def image_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, asset_id, payload_hex, codeword): image n carries order n's payload."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ok"))
    return (
        ledger(spark, sf_dir)
        .select("ok", "asset_id", "payload_hex")
        .join(ids, "ok")
        .select(
            F.col("ok").cast("string").alias("image_id"),
            "asset_id",
            "payload_hex",
            codeword_of(F.col("payload_hex")).alias("codeword"),
        )
    )


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three hash grids, spread out from the 64 numbers of each vector."""
    e = F.col("embedding").cast("array<double>")

    def spread(count: int, source) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(e, source(i))
        )

    return vectors(spark, sf_dir).select(
        "vec_id",
        e.alias("grid8"),
        spread(72, lambda i: i % 64).alias("grid9"),
        spread(
            1024,
            lambda i: F.floor(i / 128).cast("int") * 8
            + F.floor((i % 32) / 4).cast("int"),
        ).alias("grid32"),
    )
