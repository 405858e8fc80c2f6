"""Sealed ledger files: what changed is found, what did not is not read."""

import glob
import os
import shutil

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hallmark.plans import derived
from hallmark.sources import seals

KEY = b"a key that only the auditor knows"


def written(spark, path, rows):
    month = F.date_format("creation_timestamp", "yyyy-MM")
    rows.withColumn("created_month", month).drop("ok").coalesce(2).write.mode("append").partitionBy("created_month").parquet(path)


@pytest.fixture(scope="module")
def sealed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sealed"))
    rows = derived.ledger(spark, SMALL).where("creation_timestamp < '1995-06-01'")
    written(spark, f"{path}/rows", rows)
    assert {r.status for r in seals.audit_sealed(spark, path, KEY).collect()} == {"new"}
    seals.seal(spark, path, KEY)
    return path


@pytest.fixture
def ledger(sealed, tmp_path):
    path = str(tmp_path / "ledger")
    shutil.copytree(sealed, path)  # keeps the files' times
    return path


def test_an_unchanged_ledger_is_listed_only(spark, ledger):
    found = seals.audit_sealed(spark, ledger, KEY)
    assert found.count() == 0
    assert ledger + "/rows" not in found._jdf.queryExecution().executedPlan().toString()
    seals.seal(spark, ledger, KEY)
    assert len(glob.glob(f"{ledger}/seals/*.parquet")) == 1
    totals = {r.created_month: r for r in seals.month_digests(seals.read_seals(spark, ledger, KEY)).collect()}
    assert totals[None].n_rows == sum(r.n_rows for m, r in totals.items() if m)
    assert len({r.digest for r in totals.values()}) == len(totals)


def tamper(spark, ledger, month, change):
    """Rewrite one file of a month in place; returns its name."""
    name = sorted(glob.glob(f"{ledger}/rows/created_month={month}/*.parquet"))[0]
    rows = change(spark.read.parquet(name))
    rows.coalesce(1).write.parquet(f"{ledger}/new")
    shutil.copy(glob.glob(f"{ledger}/new/*.parquet")[0], name)
    shutil.rmtree(f"{ledger}/new")
    # the reader's checksum file is of the old content
    crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    return f"created_month={month}/{os.path.basename(name)}"


def first_only(column, value):
    def change(rows):
        victim = rows.agg(F.min("asset_id")).first()[0]
        return rows.withColumn(column, F.when(F.col("asset_id") == victim, value).otherwise(F.col(column)))

    return change


def test_one_changed_row_is_found_and_other_months_are_not_read(spark, ledger):
    name = tamper(spark, ledger, "1995-03", first_only("account_id", F.lit("someone")))
    found = seals.audit_sealed(spark, ledger, KEY)
    rows = found.collect()
    assert [(r.created_month, r.file, r.range, r.status, r.mismatches) for r in rows] == [("1995-03", name, 0, "changed", 1)]
    read = {p for p in found.inputFiles() if "/rows/" in p}
    assert {p.split("/rows/")[1] for p in read if "created_month" in p} >= {name}
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line and "chain_of" in line]
    assert scans and all("1 paths" in s for s in scans)


def test_a_column_outside_the_chain_hash_is_sealed_too(spark, ledger):
    tamper(spark, ledger, "1995-02", first_only("notes", F.lit("other words")))
    rows = seals.audit_sealed(spark, ledger, KEY).collect()
    assert [(r.status, r.mismatches) for r in rows] == [("changed", 0)]
    seals.seal(spark, ledger, KEY)
    assert seals.audit_sealed(spark, ledger, KEY).count() == 1
    seals.seal(spark, ledger, KEY, accept_changes=True)
    assert seals.audit_sealed(spark, ledger, KEY).count() == 0


def test_same_rows_rewritten_are_no_finding(spark, ledger):
    tamper(spark, ledger, "1995-02", lambda rows: rows)
    assert seals.audit_sealed(spark, ledger, KEY).count() == 0


def test_missing_files_rows_and_hidden_changes(spark, ledger):
    gone = sorted(glob.glob(f"{ledger}/rows/created_month=1995-04/*.parquet"))[0]
    had = spark.read.parquet(gone).count()
    os.remove(gone)
    rows = seals.audit_sealed(spark, ledger, KEY).collect()
    assert [(r.status, r.n_rows, r.mismatches) for r in rows] == [("missing", had, None)]
    # a change that keeps size and time only shows to who reads the month again
    name = sorted(glob.glob(f"{ledger}/rows/created_month=1995-01/*.parquet"))[0]
    size, time = os.stat(name).st_size, os.stat(name).st_mtime_ns
    raw = spark.read.parquet(name)
    tamper(spark, ledger, "1995-01", first_only("file_size_bytes", F.lit(5).cast("bigint")))
    grown = os.stat(name).st_size
    os.utime(name, ns=(time, time))
    assert raw is not None
    status = [r.status for r in seals.audit_sealed(spark, ledger, KEY, reread=["1995-01"]).collect()]
    assert sorted(status) == ["changed", "missing"]
    if grown == size:
        assert [r.status for r in seals.audit_sealed(spark, ledger, KEY).collect()] == ["missing"]


def test_edited_seals_count_as_none(spark, ledger):
    part = glob.glob(f"{ledger}/seals/*.parquet")[0]
    rows = spark.read.parquet(part).withColumn("n_rows", F.col("n_rows") + (F.col("created_month") == "1995-02").cast("int"))
    rows.coalesce(1).write.parquet(f"{ledger}/edited")
    shutil.rmtree(f"{ledger}/seals")
    shutil.move(f"{ledger}/edited", f"{ledger}/seals")
    found = seals.audit_sealed(spark, ledger, KEY).collect()
    assert {(r.created_month, r.status) for r in found} == {("1995-02", "new")}
    assert seals.read_seals(spark, ledger, b"another key").count() == 0


def test_an_empty_ledger(spark, tmp_path):
    os.makedirs(tmp_path / "rows")
    assert seals.audit_sealed(spark, str(tmp_path), KEY).count() == 0
    seals.seal(spark, str(tmp_path), KEY)
    assert seals.read_seals(spark, str(tmp_path), KEY).count() == 0
