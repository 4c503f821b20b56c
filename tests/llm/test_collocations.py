"""Tries against dictionaries, and phrases against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from apportion.llm import collocations as c

SCHEMA = "doc_id bigint, lang string, text string, phrase string, f int, n int"


def brute(docs, best=2000):
    words, grams = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[lang] += len(w)
            for k in (1, 2, 3):
                grams.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    found = {g: a for g, a in grams.items() if len(g) > 2 and a >= 10}
    for g, a in found.items():
        lang, w = g[0], g[1:]
        if any(100 * grams[h] >= 50 * a for h in found if len(h) == 4 and len(g) == 3 and h[0] == lang and w in (h[1:3], h[2:4])):
            continue
        cuts = [(10**6 * a * a // (grams[(lang, *w[:k])] * grams[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        row = (-score, -a, " ".join(w).encode(), a, grams[(lang, *w[:k])], grams[(lang, *w[k:])])
        out.setdefault(lang, []).append(row)
    return sorted(
        (lang, rank, row[2].decode(), row[3], row[4], row[5], words[lang], -row[0])
        for lang, rows in out.items()
        for rank, row in enumerate(sorted(rows)[:best], 1)
    )


@pytest.fixture(scope="module")
def docs():
    pick = random.Random(4)
    words = ["a", "B", "b", "é", "日本", "x1", "the", "of", "new", "york", "z" * 300, "A-b", " "]
    seps = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "! ", "\x0b", " ; "]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text():
        return "".join(w + pick.choice(seps) for w in pick.choices(words, weights, k=pick.randint(0, 60)))

    rows = [(pick.choice(["en", "de", None, "en", ""]), text()) for _ in range(150)]
    rows += [("en", "new york city of new york " * 12)] * 3 + [("fr", "Un deux trois. " * 9), ("fr", None), ("it", ""), ("it", " \t\n.,")]
    rows += [("en", "the end of a long text " * 2000)]
    return rows


def test_phrases_are_those_of_plain_python(spark, docs, monkeypatch):
    rows = [(i, lang, text, "own", 1, 2) for i, (lang, text) in enumerate(docs)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, c.collocations(table).collect())) == brute(docs)
    assert sorted(map(tuple, c.collocations(table, best=3).collect())) == brute(docs, 3)
    # Several tries; what tasks do has bounds of its own, tested below.
    monkeypatch.setattr(c, "TRIE_BYTES", 200)
    monkeypatch.setattr(c, "COUNT_BLOCK", 16)
    assert sorted(map(tuple, c.collocations(table).collect())) == brute(docs)


def test_no_rows_and_nothing_frequent(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.collocations(empty).collect() == []
    few = spark.createDataFrame([(1, "en", "some words", "", 1, 1)], SCHEMA)
    assert c.collocations(few).collect() == []
    only_words = spark.createDataFrame([(1, "en", "word. " * 20, "", 1, 1)], SCHEMA)
    assert c.collocations(only_words).collect() == []


def test_long_texts_are_cut_between_words():
    raw = ("one two, three  four\tfive. " * 50).encode()
    for size in (1, 7, 40, 5000):
        grams = Counter()
        for part, n in c.cut(raw, size):
            w = c.words_of([(0, part, n)])
            text = bytes(w.text)
            for start in w.starts[w.counted]:
                grams[tuple(text[start:].split(b"\n", 1)[0].split()[:3])] += 1
        assert grams == {
            (b"one", b"two"): 50, (b"two",): 50, (b"three", b"four", b"five"): 50, (b"four", b"five"): 50, (b"five",): 50,
        }, size


def test_tries_find_all_phrases_at_all_words():
    pick = random.Random(6)
    words = ["".join(pick.choice("abcé") for _ in range(pick.randint(1, 4))) for _ in range(60)]
    phrases = sorted({" ".join(pick.choices(words, k=pick.randint(1, 3))) for _ in range(800)})
    known = {(lang, p): i for i, (lang, p) in enumerate((x, p) for x in ("en", "de", "") for p in phrases[::2] if x != "de" or len(p) % 2)}
    trie = c.build_trie([x for x, _ in known], [p.encode() for _, p in known], list(known.values()))
    texts = [(i % 4, " ".join(pick.choices(words, k=200))) for i in range(9)]
    names = ["en", "de", "", "none"]
    w = c.words_of([(n, t.encode(), len(t.encode())) for n, t in texts])
    found = Counter()
    for word, phrase in trie.walk(w, names):
        assert len(word) == len(np.unique(word))
        found.update(phrase.tolist())
    want = Counter()
    for n, t in texts:
        split = t.split()
        for i in range(len(split)):
            want.update(known[(names[n], p)] for k in (1, 2, 3) if i + k <= len(split) and (names[n], p := " ".join(split[i : i + k])) in known)
    assert found == want


def test_tries_are_loaded_once_for_the_text_of_a_task_and_walked_from_words_of_their_range(monkeypatch):
    pick = random.Random(8)
    letters = "ab\x01\x1fé~"
    words = sorted({"".join(pick.choice(letters) for _ in range(pick.randint(1, 9))) for _ in range(80)})
    walk = c.Trie.walk
    monkeypatch.setattr(c.Trie, "walk", lambda self, w, names, some: walked.append(len(some)) or walk(self, w, names, some))
    monkeypatch.setattr(c, "TEXT_BYTES", 500)
    for n in (1, 2, 3):
        phrases = sorted({" ".join(pick.choices(words, k=n)) for _ in range(600)}, key=str.encode)
        known = [(lang, p) for lang in ("de", "en") for p in phrases]
        shards = [range(i, min(i + 90, len(known))) for i in range(0, len(known), 90)]
        made = []
        for numbers in shards:
            langs, own = [known[i][0] for i in numbers], [known[i][1].encode() for i in numbers]
            made.append((c.build_trie(langs, own, list(numbers)), c.ranges_of(langs, own)))
        loads, walked = [], []
        tries = c.Tries("", len(shards), None)
        tries.load = lambda shard: loads.append(shard) or made[shard]
        langs = [pick.choice(["en", "de", "fr"]) for _ in range(60)]
        texts = [pick.choice([" ", ". "]).join(pick.choices(words + phrases, k=50)) for _ in langs]
        batch = c.pa.RecordBatch.from_pydict({"lang": langs, "text": c.pa.array([t.encode() for t in texts], c.pa.binary())})
        languages, found, size = {}, Counter(), 0
        for held in c.held_words(iter([batch]), languages, len(shards)):
            size += len(held.starts)
            for _, hits in tries.walk(held, languages):
                for word, phrase in hits:
                    found.update(phrase[held.counted[word]].tolist())
        want, numbers = Counter(), {x: i for i, x in enumerate(known)}
        for lang, text in zip(langs, texts, strict=True):
            for piece in text.split("."):
                w = piece.split(" ")
                w = [x for x in w if x]
                want.update(numbers[lang, p] for i in range(len(w) - n + 1) if (lang, p := " ".join(w[i : i + n])) in numbers)
        assert found == want and len(want) > 5
        assert loads == list(range(len(shards)))
        assert len(shards) < 6 or 2 * sum(walked) < len(shards) * size


def test_counts_of_a_block_travel_in_proportion_to_what_was_found():
    pick = np.random.default_rng(5)
    total, want = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for n in (0, 1, 30, 818, 819, 820, 1024):
        counts = np.zeros(1024, np.int64)
        counts[pick.permutation(1024)[:n]] = pick.integers(1, 1 << 40, n)
        packed = c.pack_counts(counts)
        assert len(packed) == min(10 * n, 8192)
        c.add_counts(packed, total)
        want += counts
    assert (total == want).all()


def test_sums_pass_on_what_they_hold(monkeypatch):
    monkeypatch.setattr(c, "HELD_KEYS", 50)
    sums, total, pick = c.Sums(), Counter(), np.random.default_rng(1)
    want = Counter()
    for _ in range(60):
        keys = pick.integers(0, 200, 40)
        want.update(keys.tolist())
        for batch in sums.add(keys):
            total.update(dict(zip(batch["key"].to_pylist(), batch["count"].to_pylist(), strict=True)))
    for batch in sums.rows():
        total.update(dict(zip(batch["key"].to_pylist(), batch["count"].to_pylist(), strict=True)))
    assert total == want
