"""Fixed-width text reports as a table of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.guards import or_zero
from apportion.operators.assign import APPROACHES
from apportion.operators.statistics import METRICS

# The headings and column layout of the report.
REPORT_TITLE = "DATA PARTITIONING BENCHMARK REPORT"
TITLE_RULE = "=" * 80
UNKNOWN_ERROR = "Unknown error"
SUMMARY_TITLE = "PERFORMANCE SUMMARY"
DETAILS_TITLE = " PARTITIONING DETAILS"
ERROR_PREFIX = "Error: "
ERROR_CELL = "ERROR"
SUMMARY_COLUMNS = ("Approach", "Throughput", "Latency", "CPU %", "Memory MB")
SUMMARY_WIDTHS = (15, 15, 15, 10, 12)
SUMMARY_DECIMALS = (2, 2, 1, 1)
SUMMARY_METRICS = ("throughput", "latency_ms", "avg_cpu_percent", "avg_memory_mb")
RULE_WIDTH = 80
DETAIL_RULE_WIDTH = 40
DETAIL_LABELS = (("Mean: ", "mean"), ("Std:  ", "std"), ("Min:  ", "min"), ("Max:  ", "max"),
                 ("Median: ", "median"))


def _text_format() -> str:
    return " ".join(f"%-{width}s" for width in SUMMARY_WIDTHS)


def _value_format() -> str:
    numbers = [f"%-{w}.{d}f" for w, d in zip(SUMMARY_WIDTHS[1:], SUMMARY_DECIMALS)]
    return " ".join([f"%-{SUMMARY_WIDTHS[0]}s", *numbers])


def title_block(timestamp: str, platform: str, cpus: int, memory_gb: float) -> list[str]:
    """When and where the reported runs took place."""
    about = [f"Timestamp: {timestamp}", f"System: {platform} with {cpus} CPUs", f"Memory: {memory_gb:.1f} GB"]
    return [TITLE_RULE, REPORT_TITLE, TITLE_RULE, *about, ""]


def report_lines(
    statistics: DataFrame, approaches: Sequence[str] = APPROACHES, title: Sequence[str] = ()
) -> DataFrame:
    """``line_no, line`` of a report on :func:`gated_statistics` output, below the lines of ``title``.

    A metric that was never measured prints as zero, a failed approach prints
    ``ERROR`` in the summary and its message in the details. Approaches that are not listed follow the
    listed ones by name.
    """
    spark = statistics.sparkSession
    rule = "-" * RULE_WIDTH
    head = [*title, SUMMARY_TITLE, rule, _text_format() % SUMMARY_COLUMNS, rule]
    header = spark.createDataFrame(list(enumerate(head)), "line_no int, line string")

    def of(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    cells = [of(m, c).alias(f"{m}_{c}") for m in METRICS for _, c in DETAIL_LABELS]
    wide = statistics.groupBy("approach").agg(F.max("error").alias("error"), *cells)
    listed = F.array_position(F.array(*[F.lit(a) for a in approaches]), F.col("approach"))
    # One row per approach: the windows rank and count those that are not listed.
    by_name = Window.partitionBy(listed == 0).orderBy("approach")
    others = F.sum(F.when(listed == 0, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    wide = wide.withColumns({
        "place": F.when(listed > 0, listed).otherwise(F.lit(len(approaches)) + F.row_number().over(by_name)).cast("int"),
        "others": others.cast("int"),
    })
    failed = F.col("error").isNotNull()

    values = [or_zero(F.col(f"{m}_mean")) for m in SUMMARY_METRICS]
    summary = F.when(
        failed, F.format_string(_text_format(), "approach", *[F.lit(ERROR_CELL)] * len(values))
    ).otherwise(F.format_string(_value_format(), "approach", *values))

    title = F.concat(F.upper("approach"), F.lit(DETAILS_TITLE))
    details = [F.array(title, F.lit("-" * DETAIL_RULE_WIDTH))]
    for metric in METRICS:
        lines = [F.lit(f"{metric}:")] + [
            F.format_string(f"  {label}%.2f", f"{metric}_{column}")
            for label, column in DETAIL_LABELS
        ] + [F.lit("")]
        measured = ~failed & F.col(f"{metric}_mean").isNotNull()
        details.append(F.when(measured, F.array(*lines)).otherwise(F.array().cast("array<string>")))
    told = F.when(F.trim("error") == "", F.lit(UNKNOWN_ERROR)).otherwise(F.col("error"))
    message = F.array(F.concat(F.lit(ERROR_PREFIX), told), F.lit(""))
    details.append(F.when(failed, message).otherwise(F.array().cast("array<string>")))

    per_approach = wide.select(
        "place",
        "others",
        summary.alias("summary"),
        F.concat(*details).alias("details"),
    )
    # After the summary of all approaches comes a blank line.
    blank = F.lit(len(head) + len(approaches)) + F.col("others")
    first_detail = blank + 1
    # Every approach has room for all its detail lines, so numbers never clash.
    room = 2 + len(METRICS) * (2 + len(DETAIL_LABELS)) + 2
    rows = per_approach.select(
        F.inline(
            F.concat(
                F.array(
                    F.struct(
                        (F.lit(len(head) - 1) + F.col("place")).alias("line_no"),
                        F.col("summary").alias("line"),
                    )
                ),
                F.transform(
                    "details",
                    lambda line, i: F.struct(
                        (first_detail + (F.col("place") - 1) * room + i).alias("line_no"),
                        line.alias("line"),
                    ),
                ),
            )
        )
    )
    gap = wide.select(blank.alias("line_no"), F.lit("").alias("line")).distinct()
    return header.unionByName(rows).unionByName(gap)
