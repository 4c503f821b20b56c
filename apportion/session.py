"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "apportion", cores: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. A machine-local
    folder is used only by a local master that has no such setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="apportion-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(table: DataFrame, purpose: str) -> DataFrame:
    """Compute ``table`` once into the shared folder and continue from there.

    For small intermediate tables that several later steps read: they then
    depend neither on the plan that made them nor on any executor staying up.
    """
    path = scratch_dir(table.sparkSession, purpose)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside lets go of its shuffle files at once, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no plan still to run reads."""
    context = table.sparkSession.sparkContext
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
