"""Session helpers: local session for tests, reliable lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", app: str = "hallmark") -> SparkSession:
    """Local session; on a cluster use the session that the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers and pin the time zone.

    Batch functions are looked up by name in the workers, wherever those run.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    application = spark.sparkContext.applicationId
    if application not in _prepared:
        spark.sparkContext.addPyFile(_package_archive())
        _prepared.add(application)


_prepared: set[str] = set()


def _package_archive() -> str:
    package = os.path.dirname(os.path.abspath(__file__))
    return shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="run-"), "hallmark"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as `spark.checkpoint.dir` or the context names it.

    In local mode, where driver and executors are one process, a fresh folder is
    enough; anywhere else a missing setting is an error, as each machine would write
    to a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    folder = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and read on from there.

    Used where a result feeds several later steps: they then survive the loss of
    executors without running the whole chain again, and the planner knows the
    size of what it reads. The folder is the cluster's to clean.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Tasks for steps whose work does not show in the size of their input."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


def dealt(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt out evenly over `tasks`.

    For rows that cost milliseconds each, or that grow into hundreds: a scan or a
    coalesced shuffle sizes its tasks by bytes and would leave all to a few.
    """
    return rows.repartition(tasks or task_count(rows.sparkSession))
