"""Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from ..operators.match import lookup
from ..settings import KEY_NAMESPACE, NONCE_TTL_SECONDS
from ..sources.index import open_index
from ..sources.ledger import register

#: Groups of nonces that a replay check keeps.
REPLAY_BUCKETS = 1024


def register_stream(
    claims: DataFrame,
    path: str,
    checkpoint: str,
    master: bytes,
    namespace: str = KEY_NAMESPACE,
    **trigger,
) -> StreamingQuery:
    """Register claims as they arrive.

    A batch that is run again after a failure finds its own ids in the ledger
    and adds nothing, so each claim is registered once.
    """

    def append(batch: DataFrame, _: int) -> None:
        register(batch, path, master, namespace)

    return (
        claims.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def match_stream(
    suspects: DataFrame,
    ledger: DataFrame,
    path: str,
    checkpoint: str,
    match: Callable[..., DataFrame] = lookup,
    index_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Match a stream of suspects against the ledger, one Parquet folder per batch.

    `match` is `lookup` for suspects that are read already, `extract_and_lookup`
    for raw images. A repeated batch replaces its own folder. `index_path` is the ledger's
    path whose stored index is opened for each batch, so that no batch reads all hashes.
    """

    def report(batch: DataFrame, batch_id: int) -> None:
        options = {}
        if index_path is not None:
            options["index"] = open_index(batch.sparkSession, index_path)
        match(batch, ledger, **options).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return (
        suspects.writeStream.foreachBatch(report)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def rate_limit_stream(
    log: DataFrame,
    limit: int,
    period: str = "1 minute",
    late: str = "1 minute",
) -> DataFrame:
    """(key, route, window_start, requests, over_limit) once a window is closed."""
    return (
        log.withWatermark("ts", late)
        .groupBy("key", "route", F.window("ts", period))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "key",
            "route",
            F.col("window.start").alias("window_start"),
            "requests",
            F.greatest(F.col("requests") - limit, F.lit(0)).alias("over_limit"),
        )
    )


def replay_stream(
    challenges: DataFrame, ttl_seconds: int = NONCE_TTL_SECONDS, buckets: int = REPLAY_BUCKETS
) -> DataFrame:
    """Uses of each (account, nonce) that no use within the TTL before them forbids.

    The time of the last use that passed decides, not the batch that a use comes in: a
    use passes once the TTL is over. A nonce is forgotten when the watermark, one TTL late,
    is past that time. Uses that arrive out of order are compared with it both ways.

    Nonces are kept by bucket of their digest, so a batch costs one call of Python for each
    bucket and not for each nonce. `buckets` belongs to the checkpoint: a stream keeps its number.
    """
    ttl = ttl_seconds * 1_000_000
    columns = challenges.columns
    whole = StructType([StructField("use", challenges.schema)])

    def passing(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        over = state.getCurrentWatermarkMs() * 1000
        held = zip(*state.get) if state.exists else ()
        last = {owner: at for owner, at in held if at + ttl > over}
        uses = pd.concat(list(frames)).sort_values("at", kind="stable")
        fine = []
        for owner, at in zip(uses["owner"], uses["at"].tolist()):
            before = last.get(owner)
            fine.append(before is None or abs(at - before) >= ttl)
            if fine[-1]:
                last[owner] = at if before is None else max(at, before)
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(
            max((max(last.values()) + ttl) // 1000, state.getCurrentWatermarkMs()) + 1
        )
        yield uses.loc[fine, ["use"]]

    # fields of null are left out of the text, so no two pairs give the same
    owner = F.to_json(F.struct("account_id", "nonce"))
    return (
        challenges.withWatermark("seen_at", f"{ttl_seconds} seconds")
        .select(
            "seen_at",
            owner.alias("owner"),
            F.pmod(F.xxhash64("account_id", "nonce"), F.lit(buckets)).alias("bucket"),
            F.unix_micros(F.col("seen_at").cast("timestamp")).alias("at"),
            F.struct(*columns).alias("use"),
        )
        .filter("at IS NOT NULL")
        .groupBy("bucket")
        .applyInPandasWithState(
            passing, whole, "owners array<string>, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
        )
        .select("use.*")
    )
