"""Near duplicates that leaders, short texts or repeated lines could hide."""

import itertools
import random

import numpy as np

from apportion.llm import near_duplicates

SCHEMA = "doc_id long, text string"


def edited(pick: random.Random, words: list[str], n: int) -> list[str]:
    """The words with n of them replaced, all more than five apart."""
    out = list(words)
    step = len(words) // n
    for i in range(n):
        out[i * step + pick.randrange(step - 5)] = f"e{pick.randrange(10**9)}"
    return out


def test_original_with_a_thousand_edited_copies_is_one_class(spark):
    pick = random.Random(11)
    words = [f"w{pick.randrange(10**6)}" for _ in range(500)]
    # Each is 0.85 like the original, 0.73 like the others.
    rows = [(0, " ".join(words))] + [(i, " ".join(edited(pick, words, 8))) for i in range(1, 1001)]
    found = near_duplicates.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 1001
    assert {(r.class_id, r.copies) for r in found} == {(0, 1001)}


def test_all_pairs_of_blocks_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    monkeypatch.setattr(near_duplicates, "_COLUMNS", 7)
    pick = np.random.default_rng(2)
    nodes = [bytes([i]) for i in range(40)]
    centres = [pick.choice(500, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([centres[i % 4][: 60 - i % 9], pick.integers(500, 900, 6)])) for i in range(40)]
    # Some are known to belong together; one of the components is larger than a block.
    known = [nodes[0] if i < 28 and i % 4 == 0 else nodes[i] for i in range(40)]
    members = spark.createDataFrame(
        [(5, bytearray(x), bytearray(c)) for x, c in zip(nodes, known, strict=True)],
        "key long, node binary, component binary",
    )
    terms = spark.createDataFrame(
        [(bytearray(x), bytearray(s.astype("<u4").tobytes())) for x, s in zip(nodes, sets, strict=True)],
        "node binary, terms binary",
    )
    links = near_duplicates._exhausted(members, terms, 0.8).collect()

    def parts(pairs):
        top = {x: x for x in nodes}
        for a, b in itertools.chain(zip(nodes, known, strict=True), pairs):
            old, new = top[a], top[b]
            top = {x: new if t == old else t for x, t in top.items()}
        return {frozenset(x for x in nodes if top[x] == t) for t in top.values()}

    near = [
        (a, b) for (a, s), (b, t) in itertools.combinations(zip(nodes, sets, strict=True), 2)
        if len(np.intersect1d(s, t)) / len(np.union1d(s, t)) >= 0.8
    ]
    assert 1 < len(parts(near)) < len(parts([]))
    assert parts([(bytes(r.a), bytes(r.b)) for r in links]) == parts(near)


def windows(text: str) -> set[tuple]:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sets_are_windows_of_five_words():
    texts = ["", "one", "one two three four", "a b c d e", "a b c d e f", "a b c d x " * 9, "é 日本 x y z q"]
    assert [len(near_duplicates.shingle_set(t)) for t in texts] == [len(windows(t)) for t in texts]
    for s, t in itertools.combinations(["one  two", "one two", "one two three", *texts], 2):
        common = np.intersect1d(near_duplicates.shingle_set(s), near_duplicates.shingle_set(t))
        assert len(common) == len(windows(s) & windows(t))


def test_classes_by_windows_of_five_words(spark):
    pick = random.Random(7)
    rows, expected = [], {}
    for i in range(40):
        words = [f"w{pick.randrange(10**6)}" for _ in range(30)]
        # One word before it: 26 of 27 windows in common.
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join(["new", *words]))]
        # The same opening, other last words: 23 of 29 windows, and with the shorter
        # runs that begin a text 27 of 33, which is above the limit.
        tail = [f"t{pick.randrange(10**6)}" for _ in range(3)]
        other = [f"o{i}", *[f"w{pick.randrange(10**6)}" for _ in range(29)]]
        rows += [(4 * i + 2, " ".join(other)), (4 * i + 3, " ".join([*other[:27], *tail]))]
        expected |= {4 * i: 4 * i, 4 * i + 1: 4 * i, 4 * i + 2: 4 * i + 2, 4 * i + 3: 4 * i + 3}
    found = near_duplicates.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in found} == expected


def test_repeated_lines_do_not_hide_a_near_copy(spark):
    pick = random.Random(3)
    rows = []
    for i in range(40):
        shared = [f"w{pick.randrange(10**6)}" for _ in range(404)]
        footer = [f"f{pick.randrange(10**6)}" for _ in range(90)]
        # 400 of 494 shingles in common, the others repeated fifty times.
        rows += [(2 * i, " ".join(shared)), (2 * i + 1, " ".join(shared + footer * 50))]
    found = near_duplicates.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in found} == {d: d // 2 * 2 for d, _ in rows}
