"""Digests and documents that bind a ledger row together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import GENERATOR_NAME, GENERATOR_VERSION, HASHES
from .encoding import account_hash16, iso_utc


def _joined(*parts: Column) -> Column:
    # concat_ws leaves nulls out, which would let two different rows agree
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def _hash_columns() -> list[Column]:
    return [F.col(f"perceptual_hash_{h}") for h in HASHES]


def chain_hash() -> Column:
    """Chain-of-custody hash over the binding columns of a ledger row."""
    text = _joined(
        F.col("payload_hex"),
        F.col("zkp_commitment_hex"),
        *_hash_columns(),
        iso_utc("creation_timestamp"),
        F.col("account_id"),
    )
    return F.sha2(text.cast("binary"), 256)


def commitment_digest() -> Column:
    """Digest that a commitment is made to, as 64 hex digits."""
    text = _joined(F.col("payload_hex"), *_hash_columns(), F.col("account_id"))
    return F.sha2(text.cast("binary"), 256)


def manifest_assertion(
    name: str = GENERATOR_NAME, version: str = GENERATOR_VERSION
) -> Column:
    """Provenance assertion of a ledger row as JSON."""
    return F.to_json(
        F.struct(
            F.col("asset_id"),
            account_hash16("account_id").alias("account_id_hash"),
            F.col("payload_hex"),
            F.struct(
                *[F.col(f"perceptual_hash_{h}").alias(h) for h in HASHES]
            ).alias("perceptual_hashes"),
            F.col("device_signature"),
            F.concat(iso_utc("creation_timestamp"), F.lit("+00:00")).alias(
                "creation_timestamp"
            ),
            F.struct(
                F.lit(name).alias("name"),
                F.lit(version).alias("version"),
                F.lit("watermarker").alias("agent_type"),
            ).alias("generator"),
        )
    )
