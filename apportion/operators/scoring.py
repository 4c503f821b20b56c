"""Scoring samples with a model, natively or through Arrow batches."""

from __future__ import annotations

import resource
import sys
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from apportion.functions.constants import constant
from apportion.functions.guards import whole
from apportion.functions.vectors import predict
from apportion.operators.ordinal import number_rows
from apportion.session import written

# The functions below run in Python workers. They travel whole, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A model is shipped with every task, so its size is checked first.
MAX_LITERAL_WEIGHTS = 1 << 16
MAX_SHIPPED_WEIGHTS = 1 << 24
# Beyond that, samples and weights that meet in one task.
BLOCK_SAMPLES = 1 << 14
BLOCK_WEIGHTS = 1 << 22

Model = Callable[[np.ndarray], np.ndarray]


def feature_width(samples: DataFrame) -> int:
    """The length that most vectors have, the greater of equally frequent ones; 0 without vectors."""
    sizes = samples.where(F.col("features").isNotNull()).groupBy(F.size("features").alias("width"))
    found = sizes.agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return 0 if found is None else found.width


def prototype_model(samples: DataFrame, dimensions: int | None = None) -> DataFrame:
    """One class per label, weighted by the mean features of its samples.

    Vectors of another length than ``dimensions``, by default that of most, and
    vectors with missing or non-finite elements take no part. All means of a label are
    one vector that is combined before the shuffle; features are never exploded.
    """
    width = feature_width(samples) if dimensions is None else dimensions
    vector = array_to_vector(F.transform("features", lambda x: x.cast("double")))
    mean = Summarizer.mean(vector)
    return (
        samples.where(is_scorable(width))
        .groupBy(F.col("label").alias("class_id"))
        .agg(vector_to_array(mean).alias("weights"))
    )


def load_weights(model: DataFrame, limit: int = MAX_SHIPPED_WEIGHTS) -> tuple[list[int], np.ndarray]:
    """Class ids in ascending order and their weight matrix, if within ``limit``."""
    size = model.agg(F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"a model of {size} weights exceeds the limit of {limit}")
    rows = sorted(model.select("class_id", "weights").collect())
    return [row["class_id"] for row in rows], np.array([row["weights"] for row in rows])


def linear_model(weights: np.ndarray) -> Callable[[], Model]:
    """A loader for the callable ``features -> logits``."""

    def load() -> Model:
        transposed = np.ascontiguousarray(weights.T)
        return lambda features: features.astype(np.float64) @ transposed

    return load


def score_native(samples: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``logit`` with column expressions only.

    The model becomes a constant array, so there is no join; this suits models
    of few weights. Works on streams too.
    """
    class_ids, weights = load_weights(model, MAX_LITERAL_WEIGHTS)
    rows = [{"class_id": c, "weights": w.tolist()} for c, w in zip(class_ids, weights)]
    classes = constant(rows, "array<struct<class_id:int,weights:array<double>>>")
    best = predict(F.col("features"), classes)
    return samples.withColumn("__best", best).select(
        *samples.columns,
        (-F.col("__best.rank")).alias("prediction"),
        F.col("__best.logit").alias("logit"),
    )


def score(samples: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``logit`` with a model of any size.

    Small models become a constant, larger ones are shipped with the tasks, and those beyond
    ``MAX_SHIPPED_WEIGHTS`` are multiplied in blocks. The answers are the same.
    """
    size = model.agg(F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()[0]
    if size <= MAX_LITERAL_WEIGHTS:
        return score_native(samples, model).select("sample_id", "prediction", "logit")
    if size <= MAX_SHIPPED_WEIGHTS:
        class_ids, weights = load_weights(model)
        return score_batches(samples, linear_model(weights), class_ids)
    return score_blocks(samples, model)


def score_blocks(
    samples: DataFrame, model: DataFrame, rows: int = BLOCK_SAMPLES, weights: int = BLOCK_WEIGHTS
) -> DataFrame:
    """Score with a model that no task could hold: row blocks times class blocks.

    Classes are cut into blocks of at most ``weights`` weights, or one class, and samples into blocks of about
    ``rows``. Every pair of blocks meets in one group, which gives each of its samples the best class of
    that block; the best of these is the answer. So samples are sent once per class block and the model once per sample
    block. Sample ids may repeat: rows are told apart by a number of their own, which is written
    with them first. Ties go to the lowest class.
    """
    width, classes = model.agg(F.max(F.size("weights")), F.count("*")).first()
    if not classes:
        raise ValueError("a model needs at least one class")
    per_block = max(1, weights // max(1, width))
    class_blocks = -(-classes // per_block)
    numbered = written(
        samples.select(F.monotonically_increasing_id().alias("row"), "sample_id", "features"), "scored-rows"
    )
    row_blocks = max(1, -(-numbered.count() // rows))
    block = F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("row_block")
    left = numbered.select(
        "row", "sample_id", "features", block, F.explode(F.sequence(F.lit(0), F.lit(class_blocks - 1))).alias("class_block")
    )
    placed = number_rows(model.select("class_id", "weights"), "class_id")[0]
    right = placed.select(
        "class_id", F.transform("weights", lambda x: x.cast("double")).alias("weights"),
        whole(F.col("ordinal"), per_block).cast("int").alias("class_block"),
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"),
    )
    schema = pa.schema([("row", pa.int64()), ("sample_id", pa.int64()), ("logit", pa.float64()), ("rank", pa.int32())])

    def product(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return schema.empty_table()
        theirs = theirs.sort_by("class_id")
        logits = _matrix(mine["features"].combine_chunks()).astype(np.float64) @ _matrix(theirs["weights"].combine_chunks()).T
        best = logits.argmax(axis=1)
        ids = theirs["class_id"].to_numpy()[best]
        columns = [mine["row"].combine_chunks(), mine["sample_id"].combine_chunks(),
                   pa.array(logits[np.arange(len(best)), best]), pa.array(-ids.astype(np.int32))]
        return pa.Table.from_arrays(columns, schema=schema)

    keys = ["class_block", "row_block"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        product, "row bigint, sample_id bigint, logit double, rank int"
    )
    best = partial.groupBy("row", "sample_id").agg(F.max(F.struct("logit", "rank")).alias("best"))
    return best.select("sample_id", (-F.col("best.rank")).alias("prediction"), F.col("best.logit").alias("logit"))


def score_batches(
    samples: DataFrame, load_model: Callable[[], Model], class_ids: list[int] | None = None
) -> DataFrame:
    """Score ``sample_id, features`` with any ``features -> logits`` callable.

    ``load_model`` runs once per task. Ties go to the lowest class position.
    """
    names = None if class_ids is None else np.array(class_ids, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            logits = model(_matrix(batch.column("features")))
            best = logits.argmax(axis=1)
            labels = best.astype(np.int32) if names is None else names[best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("sample_id"),
                    pa.array(labels),
                    pa.array(logits[np.arange(len(best)), best].astype(np.float64)),
                ],
                names=["sample_id", "prediction", "logit"],
            )

    return samples.select("sample_id", "features").mapInArrow(
        run, "sample_id bigint, prediction int, logit double"
    )


def score_tasks(
    batched: DataFrame, load_model: Callable[[], Model], class_ids: list[int] | None = None
) -> DataFrame:
    """Score mini-batches one by one; a batch that the model fails on is reported and the others go on.

    ``batched`` has batch_id, sample_id and features. Each sample comes out with its prediction and
    logit, or with the ``error`` that its batch ended with; so samples in and rows out add up. A model that can't
    be loaded fails every batch of its task. Batches are gathered by one shuffle and scored in order;
    a task holds one batch, however many it has.
    """
    names = None if class_ids is None else np.array(class_ids, dtype=np.int32)
    schema = pa.schema([("batch_id", pa.int64()), ("sample_id", pa.int64()), ("prediction", pa.int32()),
                        ("logit", pa.float64()), ("error", pa.string())])

    def scored(model: Model, batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        logits = np.asarray(model(_matrix(batch["features"].combine_chunks())))
        if logits.ndim != 2 or len(logits) != batch.num_rows:
            raise ValueError(f"the model gave logits of shape {logits.shape} for {batch.num_rows} samples")
        best = logits.argmax(axis=1)
        return (best.astype(np.int32) if names is None else names[best]), logits[np.arange(len(best)), best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broken = None
        for batch in _groups(batches, "batch_id"):
            rows, error = batch.num_rows, broken
            labels = logits = None
            try:
                if model is None and broken is None:
                    model = load_model()
            except Exception as failure:
                error = broken = _text(failure)
            if error is None:
                try:
                    labels, logits = scored(model, batch)
                except Exception as failure:
                    error = _text(failure)
            columns = [
                batch["batch_id"].combine_chunks(), batch["sample_id"].combine_chunks(),
                pa.nulls(rows, pa.int32()) if error else pa.array(labels, pa.int32()),
                pa.nulls(rows, pa.float64()) if error else pa.array(logits.astype(np.float64)),
                pa.array([error] * rows, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ordered = batched.select("batch_id", "sample_id", "features").repartition("batch_id").sortWithinPartitions("batch_id", "sample_id")
    return ordered.mapInArrow(run, "batch_id bigint, sample_id bigint, prediction int, logit double, error string")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted Arrow batches, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _text(error: Exception) -> str:
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return f"{type(error).__name__}: {lines[-1] if lines else ''}"


def forward_counts(batched: DataFrame, load_model: Callable[[], Model]) -> DataFrame:
    """Run the model over mini-batches and count what was scored per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scored = len(model(_matrix(batch.column("features"))))
            ids, counts = np.unique(
                batch.column("batch_id").to_numpy(zero_copy_only=False)[:scored],
                return_counts=True,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(counts.astype(np.int64))], names=["batch_id", "scored"]
            )

    parts = batched.select("batch_id", "features").mapInArrow(
        run, "batch_id bigint, scored bigint"
    )
    return parts.groupBy("batch_id").agg(F.sum("scored").alias("scored"))


def measured_tasks(assigned: DataFrame, load_model: Callable[[], Model]) -> DataFrame:
    """Score tasks and measure each: rows, wall time, CPU share and memory.

    ``assigned`` has ``approach``, ``workers``, ``worker``, ``task_id`` and
    ``features``. A task may be spread over several Spark tasks and arrives in
    Arrow batches; its pieces are timed one by one and added up. The result
    goes into the same metrics as tasks with known costs. A task that the model fails on has the
    ``error`` and counts no rows; the other tasks go on.
    """
    keys = ["approach", "workers", "worker", "task_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broken = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if model is None and broken is None:
                try:
                    model = load_model()
                except Exception as failure:
                    broken = _text(failure)
            table = pa.Table.from_batches([batch])
            pieces = []
            table = table.sort_by([(k, "ascending") for k in keys])
            runs = table.group_by(keys, use_threads=False).aggregate([([], "count_all")]).to_pylist()
            first = 0
            for key in runs:
                count = key.pop("count_all")
                column = table["features"].slice(first, count).combine_chunks()
                first += count
                wall, cpu, scored, error = time.perf_counter(), time.process_time(), 0, broken
                if error is None:
                    try:
                        features = _matrix(column)
                        wall, cpu = time.perf_counter(), time.process_time()
                        scored = len(model(features))
                    except Exception as failure:
                        error = _text(failure)
                wall, cpu = time.perf_counter() - wall, time.process_time() - cpu
                memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
                share = 100.0 * cpu / wall if wall > 0 else 0.0
                pieces.append({**key, "rows": scored, "busy_us": wall * 1e6, "cpu": share, "memory": memory, "error": error})
            yield pa.RecordBatch.from_pylist(pieces, schema=piece_schema)

    piece_schema = pa.schema(
        [
            ("approach", pa.string()),
            ("workers", pa.int32()),
            ("worker", pa.int32()),
            ("task_id", pa.int64()),
            ("rows", pa.int64()),
            ("busy_us", pa.float64()),
            ("cpu", pa.float64()),
            ("memory", pa.float64()),
            ("error", pa.string()),
        ]
    )
    pieces = assigned.select(*keys, "features").mapInArrow(
        run,
        "approach string, workers int, worker int, task_id bigint, rows bigint, "
        "busy_us double, cpu double, memory double, error string",
    )
    return pieces.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("busy_us").alias("busy_us"),
        F.avg("cpu").alias("cpu_usage"),
        F.max("memory").alias("memory_usage"),
        F.min("error").alias("error"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as one matrix, without per-row Python."""
    lengths = column.value_lengths()
    if lengths.null_count or pa.compute.count_distinct(lengths).as_py() > 1:
        raise ValueError("vectors of different lengths or missing ones; set them aside with split_faulty")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def stack_batches(batched: DataFrame) -> DataFrame:
    """One row per mini-batch with its features in order; batches are bounded."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "features")))
    return batched.groupBy("batch_id").agg(
        F.transform(rows, lambda row: row["features"]).alias("tensor")
    )


def is_scorable(dimensions: int) -> Column:
    """Present, of the right length, and finite throughout."""
    features = F.col("features")
    finite = F.forall(
        features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce((F.size(features) == dimensions) & finite, F.lit(False))


def fault_of(dimensions: int) -> Column:
    """Why a sample is set aside, or null when it can be scored."""
    features = F.col("features")
    return (
        F.when(is_scorable(dimensions), F.lit(None).cast("string"))
        .when(features.isNull(), F.lit("missing features"))
        .when(F.size(features) != dimensions, F.lit("wrong length"))
        .otherwise(F.lit("not finite"))
    )


def split_faulty(samples: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Samples to score, and samples set aside with their ``fault``."""
    return (
        samples.filter(is_scorable(dimensions)),
        samples.withColumn("fault", fault_of(dimensions)).filter(F.col("fault").isNotNull()),
    )


def observed(scored: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Measure rows and logits in passing, while another action consumes them."""
    observation = Observation(name)
    return (
        scored.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count("prediction").alias("predicted"),
            F.min("prediction").alias("lowest"),
            F.max("prediction").alias("highest"),
        ),
        observation,
    )
