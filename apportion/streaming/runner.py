"""Running a bounded stream to its end, into tables other jobs can read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apportion.operators.ordinal import number_rows
from apportion.session import scratch_dir


def run_to_table(stream: DataFrame, purpose: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Append everything available to a table, exactly once, and read it.

    Called again with the same paths it continues where the last run stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, purpose)
    checkpoint = checkpoint or scratch_dir(spark, f"{purpose}-checkpoint")
    finish(
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    return spark.read.schema(stream.schema).parquet(path)


def run_each_batch(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Run ``step`` on every micro-batch. It may see a batch twice after a
    failure, so what it writes has to depend on the batch id alone."""
    finish(
        stream.writeStream.foreachBatch(step)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Positions:
    """Counts the samples of a stream over its micro-batches.

    Position and round robin must not depend on what the ids happen to be. A
    micro-batch is numbered in the order of ``seq`` from where the one before ended;
    that place is kept by batch id, so a repeated batch gets the same numbers.
    Micro-batches have to follow one another in that order.
    """

    schema = "seen bigint, last bigint"

    def __init__(self, path: str):
        self.path = path

    def number(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows with ``seq`` replaced by the position in the stream."""
        session = batch.sparkSession
        seen, last = 0, None
        if batch_id > 0:
            seen, last = session.read.schema(self.schema).parquet(f"{self.path}/{batch_id - 1}").first()
        low, high = batch.agg(F.min("seq"), F.max("seq")).first()
        if low is not None and last is not None and low < last:
            raise ValueError(f"sample {low} arrives after sample {last}")
        numbered, count = number_rows(batch, "seq", name="__position")
        after = seen + count, last if high is None else high
        session.createDataFrame([after], self.schema).write.mode("overwrite").parquet(
            f"{self.path}/{batch_id}"
        )
        return numbered.withColumn("seq", F.col("__position") + seen).drop("__position")


def run_numbered(
    stream: DataFrame,
    purpose: str,
    transform: Callable[[DataFrame], DataFrame],
    base: str | None = None,
) -> DataFrame:
    """Apply ``transform`` to micro-batches whose ``seq`` is the position in the stream.

    Each micro-batch is written under its id, exactly once. Called again with the same folder it
    continues where the last run stopped.
    """
    spark = stream.sparkSession
    base = base or scratch_dir(spark, purpose)
    positions = Positions(f"{base}/positions")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = transform(positions.number(batch, batch_id))
        rows.write.mode("overwrite").parquet(f"{base}/rows/micro_batch={batch_id}")

    run_each_batch(stream, step, f"{base}/checkpoint")
    empty = spark.createDataFrame([], stream.schema)
    schema = transform(empty).schema
    try:
        found = spark.read.schema(schema).parquet(f"{base}/rows")
    except AnalysisException:  # a stream that never had a micro-batch
        return spark.createDataFrame([], schema)
    return found


def run_aggregate(stream: DataFrame, purpose: str) -> DataFrame:
    """The final state of a streaming aggregate, one version per micro-batch."""
    spark = stream.sparkSession
    path = scratch_dir(spark, purpose)
    empty = spark.createDataFrame([], stream.schema)
    empty.write.parquet(f"{path}/version=-1")  # a stream may never have a micro-batch

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    run_each_batch(stream, store, scratch_dir(spark, f"{purpose}-checkpoint"), "complete")
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == (-1 if last is None else last)).drop("version")


def run_scoring(
    stream: DataFrame,
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    score: Callable[[DataFrame], DataFrame],
    base: str,
) -> tuple[DataFrame, DataFrame]:
    """Score a stream into one table, and keep what can't be scored in another.

    ``split`` parts a micro-batch into rows to score and faulty rows. Both tables are written under the batch's
    id, so a micro-batch that runs twice replaces what it wrote, and scored and faulty rows add up to the
    input. Called again with the same folder it continues where the last run stopped.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        good, faulty = split(batch)
        score(good).write.mode("overwrite").parquet(f"{base}/scored/micro_batch={batch_id}")
        faulty.write.mode("overwrite").parquet(f"{base}/faulty/micro_batch={batch_id}")

    run_each_batch(stream, step, f"{base}/checkpoint")
    good, faulty = split(spark.createDataFrame([], stream.schema))
    found = []
    for name, schema in (("scored", score(good).schema), ("faulty", faulty.schema)):
        try:
            found.append(spark.read.schema(schema).parquet(f"{base}/{name}"))
        except AnalysisException:  # a stream that never had a micro-batch
            found.append(spark.createDataFrame([], schema))
    return found[0], found[1]


def run_windows(counts: Callable[[DataFrame], DataFrame], stream: DataFrame, time: str, delay: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Windowed counts in append mode: all windows, and the rows that came too late for theirs.

    ``counts`` groups by a ``window`` of the time column first. A window is written once, when the
    watermark has passed its end, and leaves the state; so the state holds open windows only. The windows
    still open at the end are read from the state and come last, with ``closed`` false: a later run on the same
    folder goes on with them. Late rows are kept beside, by micro-batch.
    """
    spark = stream.sparkSession
    marks, late = f"{base}/marks", f"{base}/late"
    marked, span = "batch bigint, latest timestamp", F.expr(f"INTERVAL {delay}")

    def note(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        latest = None
        if batch_id > 0:
            latest = session.read.schema(marked).parquet(f"{marks}/{batch_id - 1}").first()["latest"]
        passed = F.lit(latest).cast("timestamp") - span
        batch.filter(F.col(time) < passed).write.mode("overwrite").parquet(f"{late}/micro_batch={batch_id}")
        highest = batch.agg(F.greatest(F.max(time), F.lit(latest).cast("timestamp")).alias("latest"))
        highest.select(F.lit(batch_id).cast("bigint").alias("batch"), "latest").write.mode("overwrite").parquet(f"{marks}/{batch_id}")

    grouped = counts(stream.withWatermark(time, delay))
    checkpoint = f"{base}/checkpoint"
    done = run_to_table(grouped, "windows", checkpoint, f"{base}/windows")
    run_each_batch(stream, note, f"{base}/late-checkpoint")
    columns = [c for c in grouped.columns if c != "window"]
    out = done.select("window", *columns, F.lit(True).alias("closed"))
    try:
        state = spark.read.format("statestore").load(checkpoint)
        kept = {f.name: f"key.{f.name}" for f in state.schema["key"].dataType.fields}
        kept |= {f.name: f"value.{f.name}" for f in state.schema["value"].dataType.fields}
    except PySparkException as error:  # no micro-batch, so no state
        if not str(error.getCondition() or "").startswith(("PATH_NOT_FOUND", "STDS_")):
            raise
        kept = {}
    if kept:
        values = [c for c in columns if c not in kept]
        held = [c for c in kept if c not in grouped.columns]
        names = dict(zip(held, values, strict=True))
        rows = state.select(*[F.col(path).alias(names.get(name, name)) for name, path in kept.items()])
        out = out.unionByName(rows.select("window", *columns, F.lit(False).alias("closed")))
    try:
        late_rows = spark.read.schema(stream.schema).parquet(late)
    except AnalysisException:
        late_rows = spark.createDataFrame([], stream.schema)
    return out, late_rows


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded query; an interrupt stops it and is passed on.

    The checkpoint keeps what was committed, so a restart goes on from there.
    """
    try:
        query.awaitTermination()
    finally:
        if query.isActive:
            query.stop()
