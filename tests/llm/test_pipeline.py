"""The stages, each against its operator's own answer on what it was given."""

import corpus_pipeline
from apportion.llm import near_duplicates, quality, suffix_arrays
from apportion.session import written


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = written(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == given[name].columns
    judged = {r.doc_id for r in quality.judge_quality(given["quality"], labels).where("keep").collect()}
    assert {r.doc_id for r in given["near_duplicates"].collect()} == judged
    classes = near_duplicates.duplicate_classes(given["near_duplicates"])
    assert sorted(r.doc_id for r in given["suffix_arrays"].collect()) == sorted(
        {r.class_id for r in classes.collect()}
    )
    kept = suffix_arrays.remove_repeats(given["suffix_arrays"], suffix_arrays.PASSAGES)
    cut = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in kept.collect()}
    assert {r.doc_id: r.text for r in given["packing"].collect()} == cut
    assert {r.doc_id for r in docs.collect()} == set(cut)


def test_run_applies_all_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns[:3] == ["doc_id", "start", "length"]
    assert found.count() > 0
