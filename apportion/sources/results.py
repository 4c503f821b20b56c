"""Result files: JSON documents, CSV tables, text reports, incremental runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from apportion.schemas import EXPERIMENT


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(results: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """Write with a header; with ``skip_empty`` an empty table leaves no file."""
    if skip_empty and results.isEmpty():
        return False
    results.write.mode("overwrite").option("header", True).csv(path)
    return True


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a result table; a path that does not exist is an empty table."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_text(lines: DataFrame, path: str) -> None:
    """Write report lines in ``line_no`` order.

    A report has a fixed number of lines per approach, so one file holds it.
    """
    ordered = lines.repartitionByRange(1, "line_no").sortWithinPartitions("line_no")
    ordered.select("line").write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def append_experiments(experiments: DataFrame, path: str) -> None:
    """Store experiments one partition per configuration.

    Storing a configuration again replaces only its own partition, so finished
    work survives a crash and a retry never duplicates it.
    """
    (
        experiments.repartition("strategy", "num_workers", "stream_rate")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("strategy", "num_workers", "stream_rate")
        .json(path)
    )


def stored_experiments(spark: SparkSession, path: str) -> DataFrame:
    """What is stored so far, which may be nothing."""
    try:
        return read_experiments(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], EXPERIMENT)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.createDataFrame([], EXPERIMENT).columns
    return spark.read.schema(EXPERIMENT).json(path).select(*columns)
