"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("payload_hex", T.StringType(), False),
        T.StructField("zkp_commitment_hex", T.StringType(), False),
        T.StructField("zkp_opening_value", T.StringType()),
        T.StructField("zkp_opening_randomness", T.StringType()),
        T.StructField("perceptual_hash_phash", T.StringType(), False),
        T.StructField("perceptual_hash_dhash", T.StringType(), False),
        T.StructField("perceptual_hash_ahash", T.StringType(), False),
        T.StructField("perceptual_hash_whash", T.StringType(), False),
        T.StructField("c2pa_manifest_reference", T.StringType()),
        T.StructField("c2pa_manifest_uuid", T.StringType()),
        T.StructField("c2pa_embedded", T.BooleanType(), False),
        T.StructField("creation_timestamp", T.TimestampType(), False),
        T.StructField("account_id", T.StringType(), False),
        T.StructField("account_public_key", T.StringType(), False),
        T.StructField("device_signature", T.StringType(), False),
        T.StructField("generator_model_id", T.StringType(), False),
        T.StructField("original_filename", T.StringType()),
        T.StructField("content_type", T.StringType(), False),
        T.StructField("file_size_bytes", T.LongType(), False),
        T.StructField("image_width", T.IntegerType(), False),
        T.StructField("image_height", T.IntegerType(), False),
        T.StructField("psnr_db", T.DoubleType()),
        T.StructField("chain_of_custody_hash", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        # bigint twins of the hex hashes: search reads 8 bytes per row, no parsing
        T.StructField("phash64", T.LongType(), False),
        T.StructField("dhash64", T.LongType(), False),
        T.StructField("ahash64", T.LongType(), False),
        T.StructField("whash64", T.LongType(), False),
    ]
)
LEDGER_COLUMNS = LEDGER.fieldNames()

# Image bytes live in a side table, so that a full-row ledger read stays small.
LEDGER_IMAGES = T.StructType(
    [
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("watermarked_image", T.BinaryType()),
    ]
)

# Raw images: BGR bytes row by row, the layout of Spark's own image source.
IMAGES = T.StructType(
    [
        T.StructField("image_id", T.StringType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("data", T.BinaryType()),
    ]
)

CLAIM_COLUMNS = (
    "account_id",
    "account_public_key",
    "device_signature",
    "creation_timestamp",
    "original_filename",
    "notes",
)
