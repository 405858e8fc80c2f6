"""Pages by directory and by key against offset paging over all rows."""

import os

from conftest import SMALL
from pyspark.sql import functions as F

from hallmark.operators import views
from hallmark.plans import derived
from hallmark.sources import pages, read_ledger


def test_pages_equal_offset_paging(spark, tmp_path):
    path = str(tmp_path)
    rows = derived.ledger(spark, SMALL).drop("ok").withColumn("created_month", F.lit("2000-01"))
    # many rows of one time, and files of narrow ranges of time
    rows = rows.withColumn("created_at", F.when(F.col("created_at") < "1996-01-01", F.timestamp_seconds(F.lit(0))).otherwise(F.col("created_at")))
    old, new = rows.where("created_at < '1999-01-01'"), rows.where("created_at >= '1999-01-01'")
    old.repartitionByRange(6, "created_at").write.partitionBy("created_month").parquet(f"{path}/rows")
    pages.update_pages(spark, path)
    new.coalesce(1).write.mode("append").partitionBy("created_month").parquet(f"{path}/rows")
    ordered = [r.asset_id for r in views.list_all(rows, 10_000).collect()]
    assert len(ordered) == 1500
    for offset in (0, 700, 1470, 1500):
        assert [r.asset_id for r in pages.list_page(spark, path, 40, offset).collect()] == ordered[offset : offset + 40]
    pages.update_pages(spark, path)
    page = pages.list_page(spark, path, 40, 1100)
    assert [r.asset_id for r in page.collect()] == ordered[1100:1140]
    assert page.columns == views.list_all(read_ledger(spark, path)).drop("created_month").columns
    assert len(page.inputFiles()) < len(read_ledger(spark, path).inputFiles())
    files = [f for f in os.listdir(f"{path}/rows/created_month=2000-01") if f.endswith(".parquet")]
    counted = spark.read.parquet(f"{path}/pages").agg(F.count_distinct("file"), F.sum("n_rows")).first()
    assert tuple(counted) == (len(files), 1500)


def test_keyset_pages_follow_one_another(spark):
    rows = derived.ledger(spark, SMALL).withColumn("created_at", F.date_trunc("month", "created_at")).cache()
    ordered = [r.asset_id for r in views.list_all(rows, 10_000).collect()]
    last, seen = views.list_all(rows, 30).collect()[-1], 30
    for _ in range(3):
        page = views.list_after(rows, F.lit(last.created_at), last.asset_id, 30).collect()
        assert [r.asset_id for r in page] == ordered[seen : seen + 30]
        last, seen = page[-1], seen + 30
    rows.unpersist()


def test_an_empty_ledger_has_no_pages(spark, tmp_path):
    os.makedirs(tmp_path / "rows")
    pages.update_pages(spark, str(tmp_path))
    assert pages.list_page(spark, str(tmp_path)).count() == 0
