"""What workers remember of one operator goes when they turn to another."""

import gc
import weakref

import pyarrow as pa

from apportion.llm import bpe, held, near_duplicates, packing, queries


class Encoder:
    """Stands for one that takes much room."""


def test_an_operator_finds_again_what_it_remembered():
    first = packing._encoder(Encoder)
    assert packing._encoder(Encoder) is first


def test_tasks_of_another_operator_let_it_go(spark, monkeypatch):
    packed = weakref.ref(packing._encoder(Encoder))
    assert packed() is not None
    taken = []
    texts = spark.createDataFrame([("a b c d e f",)], "text string")
    monkeypatch.setattr(
        type(texts), "mapInArrow", lambda self, f, *_: taken.append(f) or self.selectExpr("node", "node as sig")
    )
    near_duplicates.signatures(texts)
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array([b"n"]), pa.array(["a b c d e f"])], names=["node", "text"])
    assert [len(b) for b in taken[0](iter([batch]))] == [1]
    gc.collect()
    assert packed() is None


def test_ids_and_words_are_of_one_operator():
    held.held("other")
    words = bpe.words_of(queries.RANKS)
    assert bpe.words_of(queries.RANKS) is words
    held.held("other")
    assert bpe.words_of(queries.RANKS) is not words
