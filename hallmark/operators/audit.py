"""Audits of the ledger, the request log and the challenge log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import b64url_decode, b64url_encode, chain_hash, derive_subkey, hmac_sha256
from ..settings import KEY_NAMESPACE


def has_mismatch() -> Column:
    """Whether the stored chain hash is not the hash of the row's own columns."""
    return ~F.col("chain_of_custody_hash").eqNullSafe(chain_hash())


def chain_mismatches(ledger: DataFrame) -> DataFrame:
    """Rows whose stored chain hash is not the hash of their own columns."""
    return (
        ledger.withColumn("recomputed_hash", chain_hash())
        .filter(~F.col("chain_of_custody_hash").eqNullSafe(F.col("recomputed_hash")))
        .select("asset_id", "account_id", "chain_of_custody_hash", "recomputed_hash")
    )


def audit_chain(ledger: DataFrame) -> DataFrame:
    """(account_id, mismatches) of accounts with rows that were changed."""
    return (
        chain_mismatches(ledger)
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("mismatches"))
    )


def rate_limit_audit(
    log: DataFrame, limit: int, period: str = "1 minute", order: str = "event_id"
) -> DataFrame:
    """Mark requests over the fixed-window limit of their (key, route).

    The last request within the limit is found per window: the rank filter turns
    into a group limit, so each task hands on `limit` rows per window at most,
    however busy a key is. Everything after it is over the limit.
    """
    groups = ["key", "route", "window_start"]
    windowed = log.withColumn("window_start", F.window("ts", period).start)
    rank = F.row_number().over(
        Window.partitionBy(*groups).orderBy("ts", order)
    )
    last = (
        windowed.select(*groups, "ts", order)
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == limit)
        .select(*groups, F.struct("ts", order).alias("_last"))
    )
    over = F.struct("ts", order) > F.col("_last")
    return (
        windowed.join(last, groups, "left")
        .withColumn("over_limit", F.coalesce(over, F.lit(False)))
        .drop("_last")
    )


def challenge_token(nonce: Column, iat: Column, exp: Column, mac: Column) -> Column:
    """Token text: URL-safe base64 of a small JSON object, a dot, and the MAC."""
    body = F.to_json(
        F.struct(nonce.alias("nonce"), iat.alias("iat"), exp.alias("exp"))
    )
    return F.concat(b64url_encode(body), F.lit("."), mac)


def challenge_mac(
    account: Column,
    nonce: Column,
    iat: Column,
    exp: Column,
    master: bytes,
    namespace: str = KEY_NAMESPACE,
) -> Column:
    key = derive_subkey(master, "challenge", namespace=namespace)
    message = F.concat_ws(
        "|", account, nonce, iat.cast("string"), (exp - iat).cast("string")
    )
    return hmac_sha256(message, key)


def parse_challenges(log: DataFrame) -> DataFrame:
    """Add `nonce, iat, exp, mac` from `token`; all null when malformed."""
    mac = F.substring_index("token", ".", -1)
    body = F.substring(
        F.col("token"), F.lit(1), F.length("token") - F.length(mac) - 1
    )
    # json_tuple makes its columns once; a parsed struct would be built again for
    # each use of a field, and for each filter that moves below it
    fields = F.json_tuple(b64url_decode(body).cast("string"), "nonce", "iat", "exp")
    parsed = log.select("*", fields.alias("nonce", "_iat", "_exp")).withColumns(
        {n: F.col(f"_{n}").try_cast("bigint") for n in ("iat", "exp")}
    )
    whole = (
        F.col("nonce").isNotNull() & F.col("iat").isNotNull() & F.col("exp").isNotNull()
    )
    return parsed.withColumns(
        {
            "mac": F.when(whole, mac),
            **{n: F.when(whole, F.col(n)) for n in ("nonce", "iat", "exp")},
        }
    ).drop("_iat", "_exp")


def challenge_audit(
    log: DataFrame, master: bytes, namespace: str = KEY_NAMESPACE
) -> DataFrame:
    """Check tokens at the time they were seen, and find nonces used again.

    Log columns: `event_id, account_id, token, seen_at`. The first use of a nonce
    is an aggregate that is joined back; no window over a nonce's uses.
    """
    parsed = parse_challenges(log)
    expected = challenge_mac(
        F.col("account_id"), F.col("nonce"), F.col("iat"), F.col("exp"), master, namespace
    )
    seen = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    uses = (
        parsed.groupBy("account_id", "nonce")
        .agg(
            F.count(F.lit(1)).alias("uses"),
            F.min(F.struct("seen_at", "event_id")).alias("_first"),
        )
    )
    checked = (
        parsed.join(uses, ["account_id", "nonce"], "left")
        .withColumns(
            {
                "malformed": F.col("nonce").isNull(),
                "expired": F.coalesce(seen > F.col("exp"), F.lit(False)),
                "mac_valid": F.coalesce(
                    F.lower("mac") == expected, F.lit(False)
                ),
                "replayed": F.coalesce(
                    F.struct("seen_at", "event_id") > F.col("_first"), F.lit(False)
                ),
            }
        )
        .drop("_first")
    )
    outcome = (
        F.when(F.col("malformed"), "MALFORMED")
        .when(F.col("expired"), "EXPIRED")
        .when(~F.col("mac_valid"), "BAD_MAC")
        .when(F.col("replayed"), "REPLAYED")
        .otherwise("OK")
    )
    return checked.withColumn("outcome", outcome)
