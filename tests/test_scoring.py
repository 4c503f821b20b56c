import numpy as np
import pytest
from pyspark.sql import functions as F

from apportion.functions import chw_from_hwc, normalise
from apportion.operators import scoring
from apportion.sources import vector_samples

SF = "/root/testdata/sf0.01"


def test_native_and_batch_scores_agree(spark):
    samples = vector_samples(spark, SF)
    model = scoring.prototype_model(samples, 64)
    ids, weights = scoring.load_weights(model)
    native = scoring.score_native(samples, model)
    batch = scoring.score_batches(samples, scoring.linear_model(weights), ids)
    a = {r["sample_id"]: (r["prediction"], round(r["logit"], 9)) for r in native.collect()}
    b = {r["sample_id"]: (r["prediction"], round(r["logit"], 9)) for r in batch.collect()}
    assert a == b
    assert native.filter("prediction = label").count() == 205


def test_equal_logits_go_to_the_lowest_class(spark):
    samples = spark.createDataFrame([(1, [1.0, 0.0])], "sample_id long, features array<float>")
    model = spark.createDataFrame(
        [(7, [1.0, 5.0]), (3, [1.0, 2.0]), (9, [0.5, 0.0])], "class_id int, weights array<double>"
    )
    ids, weights = scoring.load_weights(model)
    assert scoring.score_native(samples, model).first()["prediction"] == 3
    batch = scoring.score_batches(samples, scoring.linear_model(weights), ids)
    assert batch.first()["prediction"] == 3


def test_model_size_is_checked(spark):
    model = spark.createDataFrame([(0, [1.0] * 10)], "class_id int, weights array<double>")
    with pytest.raises(ValueError):
        scoring.load_weights(model, limit=9)


def test_faulty_samples_are_set_aside(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, float("nan")]),
            (5, [float("inf"), 1.0]), (6, [1.0, None])]
    samples = spark.createDataFrame(rows, "sample_id long, features array<float>")
    good, bad = scoring.split_faulty(samples, 2)
    assert [r["sample_id"] for r in good.collect()] == [1]
    assert {r["sample_id"]: r["fault"] for r in bad.collect()} == {
        2: "missing features", 3: "wrong length", 4: "not finite", 5: "not finite", 6: "not finite"
    }


def test_pixels_are_reordered_and_normalised(spark):
    pixels = spark.createDataFrame([(list(range(12)),)], "p array<int>")
    row = pixels.select(
        chw_from_hwc(F.col("p"), 2, 2, 3).alias("planes"),
        normalise(chw_from_hwc(F.col("p"), 2, 2, 3)).alias("values"),
    ).first()
    planes = [0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11]
    assert row["planes"] == planes
    assert np.allclose(row["values"], (np.array(planes) / 255 - 0.5) / 0.5)


def test_scoring_scan_reads_only_what_it_needs(spark):
    samples = vector_samples(spark, SF)
    scored = scoring.score_batches(samples, lambda: np.asarray)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1]


def test_workers_do_not_need_the_package(tmp_path):
    """Scoring from another folder, where the package cannot be imported."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as entry\n"
        "from apportion.session import build_session\n"
        "spark = build_session(cores=2)\n"
        "for name in ('i3_argmax_score_batches', 'i2_batch_forward', 'a16_measured_scoring'):\n"
        "    assert entry.queries()[name](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=environment, capture_output=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_wide_vectors_score_fully_and_odd_ones_are_set_aside(spark):
    wide = [(i, [float(i % 3 == k) for k in range(128)], i % 3) for i in range(30)]
    odd = [(100, None, 0), (101, [1.0] * 64, 1), (102, [float("nan")] * 128, 2)]
    samples = spark.createDataFrame([*wide, *odd], "sample_id long, features array<float>, label int")
    width = scoring.feature_width(samples)
    good, bad = scoring.split_faulty(samples, width)
    model = scoring.prototype_model(samples)
    assert width == 128 and {len(r.weights) for r in model.collect()} == {128}
    scored = scoring.score_native(good, model).collect()
    assert len(scored) == 30 and all(r.prediction == r.label and r.logit is not None for r in scored)
    assert sorted((r.sample_id, r.fault) for r in bad.collect()) == [
        (100, "missing features"), (101, "wrong length"), (102, "not finite")]


@pytest.fixture(scope="module")
def sized(spark):
    pick = np.random.default_rng(1)
    rows = [(i % 50, [float(x) for x in pick.integers(-5, 5, 6)]) for i in range(200)] + [(7, [0.0] * 6)] * 60
    samples = spark.createDataFrame(rows, "sample_id long, features array<float>").repartition(3)
    model = spark.createDataFrame(
        [(c, [float(x) for x in pick.integers(-3, 3, 6)]) for c in range(-3, 10)] + [(40, [0.0] * 6)],
        "class_id int, weights array<double>")
    return samples, model


def test_models_of_any_size_give_the_same_predictions(spark, sized, monkeypatch):
    samples, model = sized
    expected = sorted(map(tuple, scoring.score(samples, model).collect()))
    monkeypatch.setattr(scoring, "MAX_LITERAL_WEIGHTS", 1)
    assert sorted(map(tuple, scoring.score(samples, model).collect())) == expected
    monkeypatch.setattr(scoring, "MAX_SHIPPED_WEIGHTS", 1)
    assert sorted(map(tuple, scoring.score(samples, model).collect())) == expected
    for rows, weights in ((1000, 1), (7, 12), (64, 1000)):
        found = scoring.score_blocks(samples, model, rows, weights)
        assert sorted(map(tuple, found.collect())) == expected
    assert scoring.score_blocks(samples.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        scoring.score_blocks(samples, model.limit(0))


def test_a_failing_batch_costs_that_batch(spark):
    rows = [(i // 10, i, [float(i), 1.0]) for i in range(95)] + [(20, 100, None), (20, 101, [1.0, 2.0]), (21, 102, [1.0])]
    batched = spark.createDataFrame(rows, "batch_id long, sample_id long, features array<float>").repartition(5)

    def load():
        def forward(features):
            if (features[:, 0] % 40 == 33).any():
                raise RuntimeError("first\n bad batch ")
            return features if len(features) != 5 else features[:-1]

        return forward

    found = {r.sample_id: (r.prediction, r.error) for r in scoring.score_tasks(batched, load, [5, 9]).collect()}
    assert len(found) == len(rows)
    for i in range(95):
        if i // 10 in (3, 7):
            assert found[i] == (None, "RuntimeError: bad batch")
        elif i // 10 == 9:
            assert found[i][1].startswith("ValueError: the model gave logits of shape")
        else:
            assert found[i] == (9 if i < 1 else 5, None)
    assert found[100][1] == found[101][1] and found[100][1].startswith("ValueError: vectors of different lengths")

    def broken():
        raise OSError("no weights")

    assert {r.error for r in scoring.score_tasks(batched, broken).collect()} == {"OSError: no weights"}


def test_ragged_vectors_are_refused_not_cut(spark):
    rows = [(1, [1.0] * 63), (2, [1.0] * 65)]
    samples = spark.createDataFrame(rows, "sample_id long, features array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        scoring.score_batches(samples, lambda: np.asarray).collect()
    samples = spark.createDataFrame([(1, [1.0] * 3), (2, None)], "sample_id long, features array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        scoring.score_batches(samples, lambda: np.asarray).collect()


def test_queries_set_faulty_vectors_aside(spark, tmp_path):
    import __spark_entry__ as entry

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    bad = spark.createDataFrame([(10**6, None, 0), (10**6 + 1, [1.0], 1)], table.schema)
    table.unionByName(bad).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("i6_user_model", "a16_observed_scoring", "a16_measured_scoring", "i3_argmax_blocks", "i5_failing_batches"):
        found = entry.queries()[name](spark, str(tmp_path))
        expected = entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr), name
