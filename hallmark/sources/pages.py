"""Page directory: how many rows of which time each ledger file holds.

    <path>/pages/   one row for each file and slice of arrival time

A page deep in the list is found by adding up counts, newest slice first: only the slices
that the page lies in are read, from the files that have them, and only they are sorted.
Files that the directory does not know yet are counted by their arrival column alone, and
entries of files that are gone are left out, so pages are right whatever its age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.views import list_all
from ..schema import LEDGER_COLUMNS
from .ledger import STORED, stored
from .seals import file_name, ledger_files, read_files

SLICE_SECONDS = 3600
_ENTRIES = "file string, slice long, n_rows long"


def _slice() -> Column:
    return F.floor(F.unix_micros("created_at") / (SLICE_SECONDS * 1_000_000))


def _entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Entries of standing files, and those of files that the directory lacks."""
    kept = stored(lambda s, p: s.read.schema(_ENTRIES).parquet(p), spark, f"{path}/pages")
    if kept is None:
        kept = spark.createDataFrame([], _ENTRIES)
    files = ledger_files(spark, path)
    known = kept.join(files.select("file"), "file", "left_semi").dropDuplicates(["file", "slice"])
    rows = read_files(spark, path, files.join(kept, "file", "left_anti"))
    if rows is None:
        return known, None
    counted = rows.groupBy(file_name(F.col("_metadata.file_path")).alias("file"), _slice().alias("slice"))
    return known, counted.agg(F.count(F.lit(1)).alias("n_rows"))


def update_pages(spark: SparkSession, path: str) -> None:
    """Add the files that the directory lacks. Counting one twice does no harm."""
    _, new = _entries(spark, path)
    if new is not None:
        new.coalesce(1).write.mode("append").parquet(f"{path}/pages")


def list_page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """The rows that `list_all` gives for the whole ledger, newest first, ties by id.

    A page beyond the end is empty. Rows of one slice are sorted together, so an offset
    costs no more than the slices that the page touches.
    """
    known, new = _entries(spark, path)
    entries = known if new is None else known.union(new)
    # One row for each hour in which the ledger grew, however many rows there are.
    slices = entries.groupBy("slice").agg(F.sum("n_rows").alias("n_rows"))
    before = F.sum("n_rows").over(Window.orderBy(F.desc("slice"))) - F.col("n_rows")
    touched = (
        slices.withColumn("before", before)
        .where((F.col("before") < offset + limit) & (F.col("before") + F.col("n_rows") > offset))
        .agg(F.min("slice").alias("oldest"), F.max("slice").alias("newest"), F.min("before").alias("skipped"))
        .first()
    )
    if touched.skipped is None:
        return spark.createDataFrame([], STORED).select(LEDGER_COLUMNS)
    holding = entries.where(F.col("slice").between(touched.oldest, touched.newest)).select("file")
    rows = read_files(spark, path, ledger_files(spark, path).join(holding, "file", "left_semi"))
    if rows is None:  # they went since they were listed
        return spark.createDataFrame([], STORED).select(LEDGER_COLUMNS)
    ends = [F.timestamp_seconds(F.lit(n * SLICE_SECONDS)) for n in (touched.oldest, touched.newest + 1)]
    inside = (F.col("created_at") >= ends[0]) & (F.col("created_at") < ends[1])
    return list_all(rows.select(LEDGER_COLUMNS).where(inside), limit, offset - touched.skipped)
