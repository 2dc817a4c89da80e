"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "fraudloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is only ever picked where the setting is missing and the
    master is a single local process; ``local-cluster`` counts as a cluster.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="fraudloom-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_OWNED: list[str] = []


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[str]:
    """Tables that ``cut_lineage`` writes inside are deleted at the end.

    Frames made inside read those tables, so write or collect them before leaving.
    """
    folder = f"{shared_folder(spark)}/tables/job-{uuid.uuid4().hex}"
    _OWNED.append(folder)
    try:
        yield folder
    finally:
        _OWNED.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files of an execution go when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _table_path(spark: SparkSession) -> str:
    return f"{_OWNED[-1] if _OWNED else f'{shared_folder(spark)}/tables'}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, prunes columns on later reads and
    tells the planner its true size. The shuffles that made it are deleted.
    """
    return _write(df, _table_path(df.sparkSession))


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``cut_lineage`` of what ``make`` returns; tables that it wrote on the way are deleted."""
    path = _table_path(spark)
    with owned_tables(spark):
        return _write(make(), path)


@contextmanager
def a_task_per_file(spark: SparkSession) -> Iterator[None]:
    """Actions inside read each file in a task of its own, as files that are dealt evenly should be; large ones are still split."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)
