"""Seals: keyed digests of the ledger's files, so that an audit reads only what changed.

    <path>/seals/   one row for each range of rows of a file

A row's tag is an HMAC of its place in the file and of all its columns. A range's digest
is the sum of its tags, limb by limb, so it is an aggregation with map-side combine: no
row is shuffled, and only who knows the key can make rows of the same sum. Months and the
whole ledger are summed up from ranges in the same way (`month_digests`).

Ledger files are written once. `audit_sealed` lists the files, and those of the size and
time that their seals name are not opened; others are read, and compared range by range.
Each seal carries an HMAC of its own row, so one that was edited counts as none. Files
changed behind the file system's back are found by naming their months in `reread`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hmac_sha256
from ..schema import LEDGER
from .ledger import STORED, stored

RANGE_ROWS = 1 << 16
LIMBS = 8

_SEALS = T.StructType(
    [
        T.StructField("created_month", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("range", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("mismatches", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("sealed_at", T.TimestampType()),
        T.StructField("mac", T.StringType()),
    ]
)


def _text(field: T.StructField) -> Column:
    """A value so that no two lists of values give the same text."""
    value = F.unix_micros(field.name) if isinstance(field.dataType, T.TimestampType) else F.col(field.name)
    value = value.cast("string")
    return F.coalesce(F.concat(F.length(value), F.lit(":"), value), F.lit("-"))


def file_name(path: Column) -> Column:
    """A data file's place below the ledger's rows."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def _summed(tag: str) -> Column:
    """Digest of a multiset of 64-digit tags."""
    limbs = [F.sum(F.conv(F.substring(tag, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(LIMBS)]
    return F.sha2(F.concat_ws("|", *limbs), 256)


def sealed_ranges(rows: DataFrame, key: bytes) -> DataFrame:
    """Digests and chain mismatches of each range of rows of each file read."""
    from ..operators.audit import has_mismatch

    place = F.col("_metadata.row_index")
    tagged = rows.select(
        "created_month",
        file_name(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.floor(place / RANGE_ROWS).alias("range"),
        has_mismatch().cast("long").alias("mismatch"),
        hmac_sha256(F.concat_ws("|", place.cast("string"), *[_text(f) for f in LEDGER.fields]), key).alias("tag"),
    )
    return tagged.groupBy("created_month", "file", "bytes", "modified", "range").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("mismatch").alias("mismatches"), _summed("tag").alias("digest")
    )


def _mac(key: bytes) -> Column:
    return hmac_sha256(F.concat_ws("|", *[_text(f) for f in _SEALS.fields if f.name != "mac"]), key)


def read_seals(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """The last seals of each file; seals that were not made with this key are left out."""
    found = stored(lambda s, p: s.read.schema(_SEALS).parquet(p), spark, f"{path}/seals")
    if found is None:
        found = spark.createDataFrame([], _SEALS)
    found = found.where(F.col("mac") == _mac(key))
    last = found.groupBy("file").agg(F.max("sealed_at").alias("sealed_at"))
    # a seal that an interrupted call has put twice is one
    return found.join(last, ["file", "sealed_at"]).dropDuplicates(["file", "range"])


def ledger_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, bytes, modified) of the ledger's data files, none of which is opened."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(f"{path}/rows")
    )
    return listed.select(
        file_name(F.col("path")).alias("file"), "path", F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def _standing(spark: SparkSession, path: str, seals: DataFrame) -> DataFrame:
    """(file, path, standing): `same`, `new`, `changed` or `missing`, by list and seals alone."""
    files = seals.select("file", F.col("bytes").alias("was"), F.col("modified").alias("then"), F.lit(True).alias("sealed")).distinct()
    same = (F.col("bytes") == F.col("was")) & (F.col("modified") == F.col("then"))
    standing = (
        F.when(F.col("path").isNull(), "missing").when(F.col("sealed").isNull(), "new").when(same, "same").otherwise("changed")
    )
    return ledger_files(spark, path).join(files, "file", "full").select("file", "path", standing.alias("standing"))


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame | None:
    """Ledger rows of `files`. Their names pass the driver, whose list of files holds them anyway."""
    names = [r.path for r in files.select("path").distinct().toLocalIterator()]
    if not names:
        return None
    return spark.read.schema(STORED).option("basePath", f"{path}/rows").parquet(*names)


def seal(spark: SparkSession, path: str, key: bytes, accept_changes: bool = False) -> None:
    """Seal the files that have no seals yet; with `accept_changes` changed ones anew as well."""
    wanted = ["new", "changed"] if accept_changes else ["new"]
    standing = _standing(spark, path, read_seals(spark, path, key))
    rows = read_files(spark, path, standing.where(F.col("standing").isin(wanted)))
    if rows is not None:
        made = sealed_ranges(rows, key).withColumn("sealed_at", F.current_timestamp())
        made.withColumn("mac", _mac(key)).select(_SEALS.fieldNames()).coalesce(1).write.mode("append").parquet(f"{path}/seals")


def audit_sealed(spark: SparkSession, path: str, key: bytes, reread: list[str] | None = None) -> DataFrame:
    """(created_month, file, range, status, n_rows, mismatches) of what differs from the seals.

    `status` is `new` (no seal), `changed` (another digest) or `missing`; `mismatches` are
    rows whose chain hash is wrong, null for what is missing. Only new and changed files
    are read, and all of the months in `reread`. A file that was rewritten with the same
    rows is read and not reported. The order of rows counts.
    """
    seals = read_seals(spark, path, key)
    month = F.regexp_extract("file", "created_month=([^/]*)/", 1)
    standing = _standing(spark, path, seals).where(
        (F.col("standing") != "same") | (month.isin(reread or []) & F.col("path").isNotNull())
    )
    old = seals.join(standing.select("file"), "file", "left_semi").select(
        "created_month", "file", "range", F.col("digest").alias("was"), F.col("n_rows").alias("had")
    )
    rows = read_files(spark, path, standing.where("path is not null"))
    now = spark.createDataFrame([], _SEALS) if rows is None else sealed_ranges(rows, key)
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("digest") != F.col("was"), "changed")
    found = now.select("created_month", "file", "range", "digest", "n_rows", "mismatches").join(
        old, ["created_month", "file", "range"], "full"
    )
    return found.withColumn("status", status).where("status is not null").select(
        "created_month", "file", "range", "status", F.coalesce("n_rows", "had").alias("n_rows"), "mismatches"
    )


def month_digests(seals: DataFrame) -> DataFrame:
    """(created_month, n_files, n_rows, digest); the row without a month is the whole ledger.

    Kept away from the ledger, the last row shows whether seals were taken away.
    """
    tag = F.sha2(F.concat_ws("|", "file", F.col("range").cast("string"), F.col("n_rows").cast("string"), "digest"), 256)
    return (
        seals.withColumn("tag", tag)
        .rollup("created_month")
        .agg(F.count_distinct("file").alias("n_files"), F.sum("n_rows").alias("n_rows"), _summed("tag").alias("digest"))
    )
