import pytest
from pyspark.sql import functions as F

from apportion import jobs, schemas
from apportion.operators.scoring import linear_model, load_weights, prototype_model
from apportion.session import scratch_dir
from apportion.sources import event_samples, read_csv, read_json, read_text, vector_samples


def test_batch_matrix_leaves_its_tables(spark, sf_dir):
    out = scratch_dir(spark, "batch-matrix")
    jobs.batch_matrix(event_samples(spark, sf_dir), "seq", out, [1, 2], 64, 500)
    combined = read_csv(spark, f"{out}/combined_results", schemas.COMBINED_RESULTS)
    assert combined.filter("scope = 'aggregate'").count() == 6
    # Eight chunks for either size, one rank or shard per worker.
    assert combined.filter("scope = 'node'").count() == 2 * 8 + 2 * (1 + 2)
    speedup = read_csv(spark, f"{out}/speedup_efficiency", schemas.SPEEDUP)
    assert {r["speedup"] for r in speedup.filter("workers = 1").collect()} == {1.0}


def test_streaming_matrix_leaves_its_tables(spark, sf_dir):
    out = scratch_dir(spark, "streaming-matrix")
    jobs.streaming_matrix(
        event_samples(spark, sf_dir), out, worker_counts=[1, 2], rates=[500], max_samples=800
    )
    summary = read_csv(spark, f"{out}/summary", schemas.STREAMING_SUMMARY)
    details = read_csv(spark, f"{out}/worker_details", schemas.WORKER_DETAILS)
    analysis = read_json(spark, f"{out}/analysis", schemas.ANALYSIS).first()
    assert summary.count() == 6 and details.count() == 9
    assert analysis["total_successful_experiments"] == 6
    assert [s["experiment_count"] for s in analysis["strategy_analysis"]] == [2, 2, 2]


def test_failing_matrix_is_recorded(spark, sf_dir):
    out = scratch_dir(spark, "failing-matrix")
    samples = event_samples(spark, sf_dir).drop("content")
    experiments = jobs.streaming_matrix(samples, out, worker_counts=[1], rates=[500])
    assert experiments.filter("error is not null").count() == 3
    assert read_json(spark, f"{out}/analysis", schemas.ANALYSIS).first()[1] == 3


def test_measured_suite_reports_every_approach(spark, sf_dir):
    out = scratch_dir(spark, "suite")
    samples = vector_samples(spark, sf_dir)
    _, weights = load_weights(prototype_model(samples, 64))
    statistics = jobs.measured_suite(samples, linear_model(weights), out, 2, 2)
    assert statistics.count() == 15 and statistics.filter("mean <= 0").filter(
        "metric in ('throughput', 'total_duration')").count() == 0
    report = [r["line"] for r in read_text(spark, f"{out}/report").collect()]
    assert report[1] == "DATA PARTITIONING BENCHMARK REPORT" and report[7] == "PERFORMANCE SUMMARY"
    assert len(report) == 7 + 4 + 3 + 1 + 3 * (2 + 5 * 7)


def test_measured_suite_records_a_broken_model(spark, sf_dir):
    out = scratch_dir(spark, "broken")

    def load():
        raise RuntimeError("no weights")

    statistics = jobs.measured_suite(vector_samples(spark, sf_dir), load, out, 2, 1)
    assert statistics.count() == 3 and statistics.filter("error is null").count() == 0


def test_a_failing_sink_leaves_stored_cells(spark, sf_dir, tmp_path, monkeypatch):
    out = str(tmp_path / "sink")

    def broken(table, path, **options):
        raise OSError("no space left")

    monkeypatch.setattr(jobs, "write_csv", broken)
    with pytest.raises(OSError):
        jobs.streaming_matrix(event_samples(spark, sf_dir), out, worker_counts=[1], rates=[500])
    stored = spark.read.json(f"{out}/experiments")
    assert stored.where("total_processed > 0").count() == stored.count() == 3


def test_a_failing_run_keeps_the_cells_of_an_earlier_one(spark, sf_dir, tmp_path):
    out = str(tmp_path / "kept")
    samples = event_samples(spark, sf_dir)
    jobs.streaming_matrix(samples, out, worker_counts=[1], rates=[500])
    after = jobs.streaming_matrix(samples.drop("content"), out, worker_counts=[1, 2], rates=[500])
    rows = {(r.strategy, r.num_workers): r.error for r in after.collect()}
    assert len(rows) == 6
    assert all((error is None) == (workers == 1) for (_, workers), error in rows.items())


def test_a_stream_of_one_sample_has_no_rate(spark, sf_dir, tmp_path):
    found = jobs.streaming_matrix(
        event_samples(spark, sf_dir), str(tmp_path / "one"), worker_counts=[1], rates=[500], max_samples=1)
    assert [(r.error, r.stream_metrics.actual_rate) for r in found.collect()] == [(None, 0.0)] * 3


@pytest.mark.parametrize("wrong", [{"rates": [0]}, {"worker_counts": [0]}, {"strategies": ["odd"]}, {"time_scale": 0}])
def test_wrong_settings_are_refused_before_any_job(spark, sf_dir, tmp_path, wrong):
    with pytest.raises(ValueError):
        jobs.streaming_matrix(event_samples(spark, sf_dir), str(tmp_path / "wrong"), **wrong)
    assert not (tmp_path / "wrong").exists()


def test_one_bad_row_costs_one_row(spark, sf_dir, tmp_path):
    from apportion.operators.scoring import linear_model, load_weights, prototype_model

    samples = vector_samples(spark, sf_dir).limit(30)
    _, weights = load_weights(prototype_model(samples))
    bad = spark.createDataFrame([(-1, None, 0)], samples.schema)
    out = str(tmp_path / "suite")
    jobs.measured_suite(samples.unionByName(bad), linear_model(weights), out, workers=2, num_runs=1)
    runs = spark.read.json(f"{out}/runs")
    assert "error" not in runs.columns or runs.where("error is not null").count() == 0
    assert [r.sample_id for r in spark.read.json(f"{out}/quarantine").collect()] == [-1]


def test_failing_tasks_are_left_out_and_listed(spark, sf_dir, tmp_path):
    samples = vector_samples(spark, sf_dir).limit(60)
    width = len(samples.first()["features"])
    marked = samples.withColumn(
        "features", F.when(F.col("sample_id") == samples.agg(F.min("sample_id")).first()[0], F.array_repeat(F.lit(99.0).cast("float"), width))
        .otherwise(F.col("features")))

    def load():
        def forward(features):
            if (features > 50).any():
                raise RuntimeError("bad chunk")
            return features

        return forward

    out = str(tmp_path / "suite")
    jobs.measured_suite(marked, load, out, workers=2, num_runs=1, batch_size=10, chunk_size=10)
    lost = spark.read.json(f"{out}/failed_tasks").collect()
    assert {(r.approach, r.error) for r in lost} == {(a, "RuntimeError: bad chunk") for a in ("uniform", "dynamic", "sharded")}
    runs = {r.approach: r.total_inferences for r in spark.read.json(f"{out}/runs").collect()}
    assert runs["dynamic"] == 50 and runs["sharded"] == 30
