"""Texts of one id that a short hash would take for one."""

import pytest
from pyspark.sql import functions as F

from apportion.llm import phrases, suffix_arrays

SCHEMA = "doc_id bigint, text string"
SHARED, OWN = (" ".join(f"{w}{i}" for i in range(60)) for w in ("passage", "another"))
FIRST, SECOND = f"{SHARED} 8995", f"{OWN} 142323"


@pytest.fixture(scope="module")
def docs(spark):
    # No id, equal 32-bit hashes, and only the first of the two holds what recurs.
    table = spark.createDataFrame([(1, f"start {SHARED}"), (None, FIRST), (None, SECOND)], SCHEMA)
    assert table.where("doc_id is null").select(F.hash("text")).distinct().count() == 1
    return table


def test_passages_of_texts_without_id(docs):
    found = {(r.doc_id, r.n_removed, r.kept) for r in phrases.remove_passages(docs).collect()}
    assert found == {(1, 0, f"start {SHARED}"), (None, 60, "8995"), (None, 0, SECOND)}


def test_repeats_of_texts_without_id(docs):
    found = {bytes(r.kept).decode() for r in suffix_arrays.remove_repeats(docs).collect()}
    assert found == {"start ", " 8995", SECOND}
    assert {r.text for r in suffix_arrays.cut_texts(docs).collect()} == found
