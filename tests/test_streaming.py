import os
import time
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from apportion.operators.assign import assign
from apportion.operators.queueing import fifo_schedule
from apportion.operators.scoring import (
    linear_model,
    load_weights,
    prototype_model,
    score_batches,
    score_native,
    split_faulty,
)
import __spark_entry__ as spark_entry
from apportion.session import scratch_dir
from apportion.sources import (
    cyclic_replay,
    event_samples,
    read_table,
    to_event_samples,
    vector_samples,
)
from apportion.schemas import TABLES
from apportion.streaming.keyed import keyed_backlog
from apportion.streaming.operators import backlog, once_per_sample, routed_counts, window_counts
from apportion.streaming.runner import run_aggregate, run_each_batch, run_numbered, run_scoring, run_to_table, run_windows
from apportion.streaming.sources import bounded, rate_stream, replay_delay, table_stream

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """The events in five files, in order of id and of modification time."""
    folder = tmp_path_factory.mktemp("pieces")
    events = read_table(spark, SF, "events")
    for i in range(5):
        part = str(tmp_path_factory.mktemp("part") / "p")
        events.filter(F.col("event_id").between(i * 2000, i * 2000 + 1999)).coalesce(1).write.parquet(part)
        (file,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        target = folder / f"events-{i}.parquet"
        target.write_bytes(open(f"{part}/{file}", "rb").read())
        os.utime(target, (time.time() - 100 + i, time.time() - 100 + i))
    return str(folder)


def stream(spark, folder):
    return to_event_samples(table_stream(spark, folder, "events", "events-*.parquet", 60_000))


def test_rate_stream_is_paced_in_event_time(spark):
    sizes = []
    begun = {}

    def step(batch, batch_id):
        rows = batch.agg(F.count("*"), F.count_distinct("arrival"), F.min("arrival")).first()
        sizes.append((rows[0], rows[1]))
        begun[batch_id] = rows[2]

    query = (
        rate_stream(spark, 500).writeStream.foreachBatch(step)
        .option("checkpointLocation", scratch_dir(spark, "rate")).start()
    )
    deadline = time.time() + 60
    while len(begun) < 3 and time.time() < deadline:
        time.sleep(0.1)
    query.stop()
    assert all(size == (500, 1) for size in sizes)
    assert (begun[1] - begun[0]).total_seconds() == 1.0


def test_rate_must_be_positive(spark):
    with pytest.raises(ValueError):
        rate_stream(spark, 0)


def test_replayed_stream_cycles_through_samples(spark, pieces):
    samples = vector_samples(spark, SF).select(F.col("sample_id").alias("ordinal"), "label")
    table = run_numbered(
        stream(spark, pieces).select("seq"), "replayed",
        lambda rows: cyclic_replay(bounded(rows, 1200), samples, 500))
    assert table.count() == 1200
    assert table.filter(F.col("ordinal") != F.col("seq") % 500).count() == 0


def test_stream_counts_equal_batch_counts(spark, pieces):
    batch = routed_counts(event_samples(spark, SF), "sharded", 4, "6 hours")
    streamed = run_aggregate(routed_counts(stream(spark, pieces), "sharded", 4, "6 hours"), "counts")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.collect()))


@pytest.mark.parametrize("strategy", ["uniform", "sharded"])
def test_backlog_over_micro_batches_equals_batch(spark, pieces, strategy):
    columns = ["seq", "worker", "start_us", "finish_us"]
    routed = assign(event_samples(spark, SF).select("seq", "arrival_us", "service_us", "content"), strategy, 2)
    batch = fifo_schedule(routed, ["worker"]).select(*columns)
    arriving = stream(spark, pieces).select("seq", "arrival_us", "service_us", "content")
    streamed = backlog(arriving, ["worker"], 512, route=lambda rows: assign(rows, strategy, 2)).select(*columns)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, streamed.collect()))


def test_backlog_continues_after_a_restart(spark, tmp_path, pieces):
    base = scratch_dir(spark, "restart")
    folder = tmp_path / "growing"
    folder.mkdir()
    for i in range(5):
        target = folder / f"events-{i}.parquet"
        target.write_bytes(open(f"{pieces}/events-{i}.parquet", "rb").read())
        os.utime(target, (time.time() - 100 + i, time.time() - 100 + i))
        if i in (1, 4):
            arriving = stream(spark, str(folder)).select("seq", "arrival_us", "service_us")
            streamed = backlog(arriving, ["worker"], base=base, route=lambda rows: assign(rows, "uniform", 2))
    routed = assign(event_samples(spark, SF).select("seq", "arrival_us", "service_us"), "uniform", 2)
    batch = fifo_schedule(routed, ["worker"])
    columns = ["seq", "worker", "finish_us"]
    assert sorted(map(tuple, batch.select(*columns).collect())) == sorted(
        map(tuple, streamed.select(*columns).collect()))


def test_copies_are_dropped(spark, pieces):
    copies = assign(stream(spark, pieces).select("seq", "arrival"), "dynamic", 4)
    table = run_to_table(once_per_sample(copies, "40 days"), "once")
    assert table.count() == 10_000 and table.select("seq").distinct().count() == 10_000


def test_stream_scores_equal_batch_scores(spark):
    samples = vector_samples(spark, SF)
    model = prototype_model(samples, 64)
    ids, weights = load_weights(model)
    arriving = table_stream(spark, SF, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").alias("features"))
    by_batch = run_to_table(score_batches(arriving, linear_model(weights), ids), "scores")
    natively = run_to_table(score_native(arriving, model), "native-scores")
    expected = {r[0]: r[1] for r in score_native(samples, model).select("sample_id", "prediction").collect()}
    for table in (by_batch, natively):
        assert {r[0]: r[1] for r in table.select("sample_id", "prediction").collect()} == expected


def test_an_error_stops_the_query_and_a_restart_loses_nothing(spark, pieces):
    checkpoint = scratch_dir(spark, "interrupted")
    seen = {}

    def failing(batch, batch_id):
        if batch_id == 2 and "failed" not in seen:
            seen["failed"] = True
            raise RuntimeError("interrupted")
        seen[batch_id] = batch.count()

    with pytest.raises(Exception):
        run_each_batch(stream(spark, pieces), failing, checkpoint)
    assert not spark.streams.active
    run_each_batch(stream(spark, pieces), failing, checkpoint)
    seen.pop("failed")
    assert seen == {i: 2000 for i in range(5)}


@pytest.fixture(scope="module")
def spaced(spark, tmp_path_factory):
    """The tables as folders of parts, with event ids that are neither dense nor start at 0."""
    folder = str(tmp_path_factory.mktemp("spaced"))
    for name in ("events", "embeddings"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "events":
            table = table.withColumn("event_id", F.col("event_id") * 4 + 7)
        key = table.columns[0]
        table.repartitionByRange(4, key).sortWithinPartitions(key).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [
    "s4_paced_stream", "s6_bounded_stream", "w3_routed_counts_stream", "w4_fifo_finish_stream",
    "w8_once_per_sample", "w9_restarted_stream", "i4_stream_score"])
def test_streams_read_folders_and_number_their_samples(spark, spaced, name):
    query = spark_entry.queries()[name]
    found = query(spark, spaced)
    expected = query(spark, "/root/testdata/sf0.001")
    if name == "w8_once_per_sample":
        expected = expected.select((F.col("seq") * 4 + 7).alias("seq"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_round_robin_and_bounds_count_samples_not_ids(spark, spaced):
    samples = event_samples(spark, spaced)
    assert {r["worker"]: r["count"] for r in assign(samples, "uniform", 4).groupBy("worker").count().collect()} == {
        i: 250 for i in range(4)}
    assert samples.where("seq < 500").count() == 500


def test_micro_batches_out_of_order_are_refused(spark):
    from apportion.streaming.runner import Positions

    positions = Positions(scratch_dir(spark, "positions"))
    later, earlier = spark.range(10, 20).toDF("seq"), spark.range(0, 5).toDF("seq")
    assert positions.number(later, 0).agg(F.max("seq")).first()[0] == 9
    with pytest.raises(ValueError):
        positions.number(earlier, 1)


def test_keyed_workers_equal_the_batch_schedule(spark, pieces):
    routed = assign(event_samples(spark, SF), "sharded", 3)
    columns = ["seq", "worker", "start_us", "finish_us"]
    batch = fifo_schedule(routed.select("seq", "arrival_us", "service_us", "worker"), ["worker"]).select(*columns)
    events = keyed_backlog(assign(stream(spark, pieces), "sharded", 3), ["worker"], "0 seconds").cache()
    samples = events.where("kind = 'sample'")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, samples.select(*columns).collect()))
    # Workers that ran out of work said so, and never lost a sample over it.
    idle = events.where("kind = 'idle'").collect()
    finished = {(r.worker, r.seq): r.finish_us for r in samples.collect()}
    assert all(finished[(r.worker, r.seq)] == r.finish_us for r in idle)


def test_keyed_workers_continue_after_a_restart(spark, tmp_path, pieces):
    base, folder = scratch_dir(spark, "keyed-restart"), tmp_path / "growing"
    folder.mkdir()
    for i in range(5):
        target = folder / f"events-{i}.parquet"
        target.write_bytes(open(f"{pieces}/events-{i}.parquet", "rb").read())
        os.utime(target, (time.time() - 100 + i, time.time() - 100 + i))
        if i in (1, 4):
            events = keyed_backlog(assign(stream(spark, str(folder)), "sharded", 2), ["worker"], "0 seconds", base)
    routed = assign(event_samples(spark, SF), "sharded", 2).select("seq", "arrival_us", "service_us", "worker")
    columns = ["seq", "worker", "start_us", "finish_us"]
    assert sorted(map(tuple, fifo_schedule(routed, ["worker"]).select(*columns).collect())) == sorted(
        map(tuple, events.where("kind = 'sample'").select(*columns).collect()))


def test_idle_workers_report_and_leave_the_state(spark, tmp_path):
    """Three busy periods: the state is removed in between, and starts are as if it had stayed."""
    schema = "worker int, seq long, arrival timestamp, arrival_us long, service_us long"
    folder = tmp_path / "in"
    rows = [(0, 0, 0, 5), (0, 1, 1, 5), (1, 2, 2, 500), (0, 3, 100, 5), (1, 4, 101, 5), (0, 5, 900, 5), (1, 6, 901, 5)]
    for i, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        data = [(w, s, datetime.fromtimestamp(a + 1000, timezone.utc), (a + 1000) * 1_000_000, d * 1_000_000) for w, s, a, d in part]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(folder / f"p{i}"))
        for file in (folder / f"p{i}").iterdir():
            os.utime(file, (time.time() - 100 + i,) * 2)
    arriving = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1")
                .parquet(str(folder)))
    events = keyed_backlog(arriving, ["worker"], "0 seconds").collect()
    starts = {r.seq: r.start_us // 1_000_000 - 1000 for r in events if r.kind == "sample"}
    assert starts == {0: 0, 1: 5, 2: 2, 3: 100, 4: 502, 5: 900, 6: 901}
    idle = {(r.worker, r.seq, r.finish_us // 1_000_000 - 1000, r.samples) for r in events if r.kind == "idle"}
    assert {(0, 1, 10, 2), (0, 3, 105, 1), (1, 4, 507, 2)} <= idle


def test_windows_close_once_and_late_rows_are_kept(spark, pieces, tmp_path):
    counts = window_counts("6 hours", "worker")
    batch = counts(assign(event_samples(spark, SF), "sharded", 4))
    expected = sorted((r.window.start, r.worker, r.samples) for r in batch.collect())
    base = scratch_dir(spark, "windows")
    windows, late = run_windows(counts, assign(stream(spark, pieces), "sharded", 4), "arrival", "0 seconds", base)
    rows = windows.collect()
    assert sorted((r.window.start, r.worker, r.samples) for r in rows) == expected
    assert late.count() == 0 and {r.closed for r in rows} == {True, False}
    # The first file again, after the others: everything in it is too late.
    folder = tmp_path / "disorder"
    folder.mkdir()
    for i, file in enumerate((1, 2, 3, 4, 0)):
        target = folder / f"events-{i}.parquet"
        target.write_bytes(open(f"{pieces}/events-{file}.parquet", "rb").read())
        os.utime(target, (time.time() - 100 + i, time.time() - 100 + i))
    base = scratch_dir(spark, "windows")
    windows, late = run_windows(counts, assign(stream(spark, str(folder)), "sharded", 4), "arrival", "0 seconds", base)
    counted = windows.agg(F.sum("samples")).first()[0]
    assert late.count() == 2000 and {r.seq for r in late.select("seq").collect()} == set(range(2000))
    assert counted == 8000
    delay = replay_delay(spark, str(folder), "events", "ts", "events-*.parquet")
    base = scratch_dir(spark, "windows")
    windows, late = run_windows(counts, assign(stream(spark, str(folder)), "sharded", 4), "arrival", delay, base)
    assert sorted((r.window.start, r.worker, r.samples) for r in windows.collect()) == expected and late.count() == 0


def test_a_long_table_in_shuffled_file_order_loses_nothing(spark, tmp_path):
    folder = tmp_path / "long"
    folder.mkdir()
    events = read_table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts") + F.expr("make_interval(0, 0, 0, event_id % 90)"))
    for i, part in enumerate((3, 0, 4, 1, 2)):
        path = str(tmp_path / f"part{i}")
        events.filter(F.col("event_id") % 5 == part).coalesce(1).write.parquet(path)
        (file,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
        target = folder / f"events-{i}.parquet"
        target.write_bytes(open(f"{path}/{file}", "rb").read())
        os.utime(target, (time.time() - 100 + i, time.time() - 100 + i))
    delay = replay_delay(spark, str(folder), "events", "ts", "events-*.parquet")
    arriving = to_event_samples(table_stream(spark, str(folder), "events", "events-*.parquet", 1))
    copies = assign(arriving.select("seq", "arrival"), "dynamic", 4)
    table = run_to_table(once_per_sample(copies, delay), "long")
    assert table.count() == table.distinct().count() == events.count()


def test_streams_without_files_give_empty_tables(spark, tmp_path):
    folder = tmp_path / "none"
    folder.mkdir()
    arriving = to_event_samples(spark.readStream.schema(TABLES["events"]).parquet(str(folder)))
    routed = assign(arriving, "sharded", 2)
    assert run_aggregate(routed_counts(arriving, "sharded", 2, "6 hours"), "none").count() == 0
    assert backlog(arriving.select("seq", "arrival_us", "service_us"), ["worker"], route=lambda r: assign(r, "uniform", 2)).count() == 0
    assert keyed_backlog(routed, ["worker"], "0 seconds").count() == 0
    windows, late = run_windows(window_counts("6 hours"), arriving, "arrival", "0 seconds", scratch_dir(spark, "none"))
    assert windows.count() == late.count() == 0


def test_dead_letters_add_up_over_restarts(spark, tmp_path):
    folder = tmp_path / "vectors"
    rows = [(i, None if i % 5 == 0 else [1.0] if i % 7 == 0 else [float(i), 1.0]) for i in range(40)]
    base = scratch_dir(spark, "letters")
    schema = "sample_id long, features array<float>"
    for part in (rows[:20], rows[20:], []):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        scored, faulty = run_scoring(
            spark.readStream.schema(schema).parquet(str(folder)), lambda r: split_faulty(r, 2),
            lambda r: score_batches(r, linear_model(np.eye(2)), [3, 4]), base)
    good = {r.sample_id: r.prediction for r in scored.collect()}
    assert len(good) == scored.count() and set(good) | {r.sample_id for r in faulty.collect()} == set(range(40))
    assert {r.sample_id: r.fault for r in faulty.collect()} == {
        i: "missing features" if i % 5 == 0 else "wrong length" for i in range(40) if i % 5 == 0 or i % 7 == 0}
    assert faulty.count() + scored.count() == 40 and good[1] == 3
