"""Ledger reads: shapes, point lookups, pages, versions, query checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_hex, iso_utc
from ..settings import (
    DISTANCE_RANGE,
    HASH_LENGTH_RANGE,
    HASHES,
    SEARCH_LIMIT_RANGE,
)


def _hash_struct() -> Column:
    return F.struct(
        *[F.col(f"perceptual_hash_{h}").alias(h) for h in HASHES]
    ).alias("perceptual_hashes")


def _manifest_struct() -> Column:
    return F.struct(
        F.col("c2pa_manifest_reference").alias("manifest_reference"),
        F.col("c2pa_manifest_uuid").alias("manifest_uuid"),
        F.col("c2pa_embedded").alias("embedded"),
    ).alias("c2pa")


def entry_view(ledger: DataFrame) -> DataFrame:
    """Ledger rows in the nested shape that readers get."""
    return ledger.select(
        "asset_id",
        "payload_hex",
        "zkp_commitment_hex",
        _hash_struct(),
        _manifest_struct(),
        iso_utc("creation_timestamp").alias("creation_timestamp"),
        "account_id",
        "device_signature",
        "generator_model_id",
        "image_width",
        "image_height",
        "file_size_bytes",
        "psnr_db",
        iso_utc("created_at").alias("created_at"),
    )


def public_view(ledger: DataFrame, images: DataFrame) -> DataFrame:
    """Entry shape without openings, with addresses and an image flag.

    `images` is the side table; its length column is read, its bytes are not.
    """
    held = (
        images.filter(F.col("image_bytes") > 0)
        .select("asset_id")
        .distinct()
        .withColumn("image_available", F.lit(True))
    )
    address = F.concat(F.lit("/api/v1/asset/"), F.col("asset_id"))
    # shaped after the join, so that it sends no text that follows from other columns
    return ledger.join(held, "asset_id", "left").select(
        *entry_view(ledger).columns[:3],
        _hash_struct(),
        _manifest_struct(),
        iso_utc("creation_timestamp").alias("creation_timestamp"),
        iso_utc("created_at").alias("created_at"),
        "account_id",
        "device_signature",
        "generator_model_id",
        "original_filename",
        "content_type",
        "file_size_bytes",
        "image_width",
        "image_height",
        "psnr_db",
        F.lit(True).alias("public_endpoint"),
        F.concat(address, F.lit("/image")).alias("image_url"),
        F.concat(address, F.lit("/thumb")).alias("thumb_url"),
        F.coalesce("image_available", F.lit(False)).alias("image_available"),
    )


def get_by_id(ledger: DataFrame, asset_id: str) -> DataFrame:
    return ledger.filter(F.col("asset_id") == asset_id)


def get_by_commitment(ledger: DataFrame, commitment_hex: str) -> DataFrame:
    """The one row with this commitment; two of them fail the query."""
    # two rows are enough to tell, so the window never sees more
    found = ledger.filter(F.col("zkp_commitment_hex") == commitment_hex).limit(2)
    count = F.count(F.lit(1)).over(Window.partitionBy("zkp_commitment_hex"))
    return (
        found.withColumn("_n", count)
        .filter(
            F.when(F.col("_n") == 1, True).otherwise(
                F.raise_error(F.lit("more than one row has this commitment"))
            )
        )
        .drop("_n")
    )


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("asset_id").asc()]


def get_by_payload(ledger: DataFrame, payload: str) -> DataFrame:
    return ledger.filter(F.col("payload_hex") == payload).orderBy(*_newest_first())


def list_for_account(
    ledger: DataFrame, account_id: str, limit: int = 100, offset: int = 0
) -> DataFrame:
    mine = ledger.filter(F.col("account_id") == account_id)
    return list_all(mine, limit, offset)


def list_all(ledger: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return ledger.orderBy(*_newest_first()).offset(offset).limit(limit)


def list_after(
    ledger: DataFrame, created_at: Column, asset_id: str, limit: int = 100
) -> DataFrame:
    """The page that follows a row, newest first: each task hands on `limit` rows at most.

    For one account, filter the ledger by it. The time bound reaches the scan.
    """
    at = F.col("created_at")
    later = (at < created_at) | ((at == created_at) & (F.col("asset_id") > asset_id))
    return ledger.filter((at <= created_at) & later).orderBy(*_newest_first()).limit(limit)


def validate_queries(queries: DataFrame) -> DataFrame:
    """Add `error_code` (null when fine) and `searchable` to a query table.

    Reads `asset_id, phash, dhash, row_limit, max_distance`. Text that is no hex
    is no error: such a query finds nothing, which `searchable` says.
    """

    def bad_length(name: str) -> Column:
        size = F.length(name)
        return F.col(name).isNotNull() & ~size.between(*HASH_LENGTH_RANGE)

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    bare = F.regexp_replace(F.col("asset_id"), "urn:|uuid:|[{}-]", "")
    code = (
        F.when(
            F.col("asset_id").isNotNull() & ~bare.rlike("^[0-9a-fA-F]{32}$"),
            "BAD_ASSET_ID",
        )
        .when(
            F.col("asset_id").isNull() & ~given("phash") & ~given("dhash"), "NO_HASH"
        )
        .when(bad_length("phash") | bad_length("dhash"), "BAD_HASH_LENGTH")
        .when(~F.col("row_limit").between(*SEARCH_LIMIT_RANGE), "BAD_LIMIT")
        .when(~F.col("max_distance").between(*DISTANCE_RANGE), "BAD_DISTANCE")
    )
    hex_given = F.coalesce(is_hex("phash"), F.lit(False)) | F.coalesce(
        is_hex("dhash"), F.lit(False)
    )
    return queries.withColumn("error_code", code).withColumn(
        "searchable", F.col("error_code").isNull() & hex_given
    )


def current_version(versions: DataFrame) -> DataFrame:
    """Last write per asset.

    An aggregation, not a window: mappers keep one row per asset, so an asset
    with very many versions costs no single task more than its share.
    """
    rest = [c for c in versions.columns if c != "updated_at"]
    row = F.struct("updated_at", *rest)
    latest = versions.groupBy("asset_id").agg(F.max(row).alias("_row"))
    return latest.select(*[F.col(f"_row.{c}").alias(c) for c in versions.columns])


def restamp(changed: DataFrame, now: Column | None = None) -> DataFrame:
    """Stamp changed rows before they are appended as new versions."""
    return changed.withColumn("updated_at", now if now is not None else F.current_timestamp())
