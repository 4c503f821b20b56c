"""Operators on texts against plain Python, with awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from apportion.llm import fingerprints, near_duplicates, phrases, quality, queries, suffix_arrays
from apportion.llm import recurring as R

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, spans string, h int"


def awkward_rows(seed: int) -> list[tuple]:
    """Texts with shared passages, copies, near copies, repeats, nulls and extra columns."""
    pick = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = " ".join(pick.choice(words) for _ in range(120))
    texts: list[str | None] = []
    for i in range(60):
        own = " ".join(pick.choice(words) for _ in range(pick.randint(1, 260)))
        if i % 4 == 0:
            cut = pick.randint(0, len(passage) // 2)
            own = own[: pick.randint(0, len(own))] + " " + passage[cut:] + "\n" + own
        texts.append(own)
    texts += [texts[3], texts[3], texts[8] + " end", None, None, "", " \n\t ", "one", "one two", "x" * 3000]
    texts += ["ab " * 900, "\n".join(["the same line of some words"] * 150), "naïve  日本語  text 😀"]
    ids: list[int | None] = list(range(len(texts)))
    pick.shuffle(ids)
    rows = [(d, t, "en" if i % 3 else None, None, None if t is None else len(t), "x", "y", 1)
            for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    # Repeated rows, and ids that are null.
    return [*rows, rows[0], (None, texts[0], "en", None, 1, "x", "y", 1), (None, "alone " * 60, "en", None, 1, "x", "y", 1)]


@pytest.fixture(scope="module", params=[1])
def rows(request):
    return awkward_rows(request.param)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed_words(rows: list[tuple]) -> list[tuple]:
    order = lambda d: (1 << 63) - 1 if d is None else d
    first: dict[tuple, int] = {}
    for d, text, *_ in rows:
        w = split(text)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, text, *_ in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(d):
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def removed_bytes(rows: list[tuple], length: int = 400) -> list[tuple]:
    raws = [(d, (text or "").encode()) for d, text, *_ in rows]
    count = Counter(b[i : i + length] for _, b in raws for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        gone = set()
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), runs, bytes(x for i, x in enumerate(b) if i not in gone)))
    return out


def same_rows(found, expected) -> None:
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    plain = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found]
    assert sorted(plain, key=key) == sorted(expected, key=key)


def test_passages(docs, rows):
    same_rows(phrases.remove_passages(docs).collect(), removed_words(rows))


def test_passages_with_large_groups_as_windows(docs, rows, monkeypatch):
    monkeypatch.setattr(R, "GROUP", 2)
    same_rows(phrases.remove_passages(docs).collect(), removed_words(rows))


def test_repeated_bytes(docs, rows):
    same_rows(suffix_arrays.remove_repeats(docs).collect(), removed_bytes(rows))


def test_repeated_bytes_with_large_groups_as_windows(docs, rows, monkeypatch):
    monkeypatch.setattr(R, "GROUP", 2)
    same_rows(suffix_arrays.remove_repeats(docs).collect(), removed_bytes(rows))


def edited_copies(n, size=1500):
    """Copies of one text with an edit each, so that most contexts differ, and one without."""
    pick = random.Random(n)
    base = bytes(pick.choice(b"abcdefgh ") for _ in range(size))
    out = [base]
    for _ in range(n):
        at = pick.randrange(size)
        out.append(base[:at] + b"X" + base[at + 1 :])
    return out


def test_digests_and_texts_of_what_is_left(docs, rows):
    found = suffix_arrays.remove_repeats(docs, digest=True).collect()
    expected = [
        (*r[:4], hashlib.sha256(r[4]).hexdigest(), r[4].decode(errors="ignore")) for r in removed_bytes(rows)
    ]
    same_rows(found, expected)


def test_shorter_strings(docs, rows):
    same_rows(suffix_arrays.remove_repeats(docs, suffix_arrays.PASSAGES).collect(), removed_bytes(rows, 240))


def removed_at_both_lengths(rows):
    return [
        (*r[:4], hashlib.sha256(r[4]).hexdigest(), r[4].decode(errors="ignore"), fine[4].decode(errors="ignore"))
        for r, fine in zip(removed_bytes(rows), removed_bytes(rows, 240), strict=True)
    ]


@pytest.mark.parametrize("group", [R.GROUP, 2])
def test_strings_and_shorter_passages_in_one_pass(docs, rows, monkeypatch, group):
    monkeypatch.setattr(R, "GROUP", group)
    monkeypatch.setattr(R, "RUN", 3)
    monkeypatch.setattr(suffix_arrays, "BATCH", 7)
    found = suffix_arrays.remove_repeats(docs, suffix_arrays.BOTH, digest=True).collect()
    same_rows(found, removed_at_both_lengths(rows))


@pytest.mark.parametrize("group", [R.GROUP, 2])
def test_both_lengths_in_groups_of_edited_copies(spark, monkeypatch, group):
    # Copies whose edits are 240 to 400 bytes apart, copies under 400 bytes, and copies of both without an id.
    copies = edited_copies(25, 900) + [t[i : i + 240 + 7 * i] for i, t in enumerate(edited_copies(25, 900))]
    rows = [(i if i % 6 else None, t.decode(), None, None) for i, t in enumerate(copies + copies[:30:4])]
    expected = removed_at_both_lengths(rows)
    assert sum(a[5] != a[6] for a in expected) > 5 and sum(0 < a[2] < a[1] for a in expected) > 5
    monkeypatch.setattr(R, "GROUP", group)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    same_rows(suffix_arrays.remove_repeats(docs, suffix_arrays.BOTH, digest=True).collect(), expected)


def runs_of_short_periods(n, sizes):
    """Texts of their own around runs that repeat a few bytes, whose start and end no other text has."""
    pick = random.Random(n)
    own = lambda size: "".join(pick.choice("abcdefghijklmnop ") for _ in range(size)) + "#"
    periods = ("the ", "=", "ab-cd ", "0123456789" * 3, "0123456789abc" * 3)
    return [own(500) + (periods[i % 5] * 900)[: sizes[i % len(sizes)]] + "#" + own(450) for i in range(n)]


@pytest.mark.parametrize("group", [R.GROUP, 2])
def test_runs_of_short_periods(spark, monkeypatch, group):
    texts = runs_of_short_periods(30, (230, 239, 241, 243, 262, 399, 401, 404, 450, 700, 1500))
    rows = [(i, t, None, None) for i, t in enumerate([*texts, "the " * 70, "==" * 150, "the " * 300, "the " * 70])]
    monkeypatch.setattr(R, "GROUP", group)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    found = suffix_arrays.remove_repeats(docs, suffix_arrays.BOTH, digest=True).collect()
    same_rows(found, removed_at_both_lengths(rows))
    same_rows(suffix_arrays.remove_repeats(docs).collect(), removed_bytes(rows))


def test_contexts_of_an_anchor_in_a_run_do_not_grow_with_the_documents(spark):
    most = []
    for n in (10, 40):
        docs = spark.createDataFrame(list(enumerate(runs_of_short_periods(5 * n, (1500,))[::5])), "doc_id bigint, text string")
        seen = R.occurrences(R.keyed(docs), suffix_arrays.BOTH)
        most.append(seen.groupBy("a").agg(F.countDistinct("ctx").alias("n")).agg(F.max("n")).head()[0])
    assert most[0] == most[1] < 400


def test_places_of_grams_of_a_short_period(monkeypatch):
    pick = random.Random(3)
    for k in range(60):
        parts = [bytes(pick.choices(b"ab ", k=pick.randint(1, 40))) * pick.choice([1, 2, 30]) for _ in range(6)]
        data, gram = b"".join(parts), (48, 64)[k % 2]
        monkeypatch.setattr(R, "_SCAN", (50, 1 << 18)[k % 3 > 0])
        grams = [data[i : i + gram] for i in range(len(data) - gram + 1)]
        expected = [i for i, g in enumerate(grams) if any(g[t:] == g[:-t] for t in range(1, min(gram // 2, gram - 24) + 1))]
        found = R.short_periods(np.frombuffer(data, dtype=np.uint8), gram)
        assert [i for s, e in found for i in range(s, e)] == expected


def test_op7_gives_texts_without_shared_passages_of_over_fifty_words(spark, tmp_path):
    pick = random.Random(7)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(500)]
    own = [" ".join(pick.choice(words) for _ in range(90)) for _ in range(12)]
    passage = " ".join(pick.choice(words) for _ in range(55))
    assert 240 < len(passage) < 400
    texts = [f"{t}\n{passage}\n{t[::-1]}" if i < 6 else t for i, t in enumerate(own)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.op7_suffix_arrays(spark, str(tmp_path)).collect():
        assert row.n_removed == 0 and row.kept == texts[row.doc_id]  # by the length of the contract
        if row.doc_id < 6:
            assert len(row.text) <= len(texts[row.doc_id]) - len(passage) and passage[5:-5] not in row.text
        else:
            assert row.text == texts[row.doc_id]


def test_texts_are_shuffled_once_for_contexts_and_spans(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that aren't small
    try:
        found = queries.op7_suffix_arrays(spark, str(tmp_path))
        found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange [doc_id" in found._jdf.queryExecution().executedPlan().toString()


def test_levels_of_suffix_arrays_find_every_shared_window():
    what = suffix_arrays.BYTES
    anchor, run = b"%" * what.gram, []
    for number, text in enumerate(edited_copies(60)):
        # Contexts of two anchors; some are cut short by an end of their text.
        at = 700 if number % 2 else 300
        text = text[:at] + anchor + text[at:]
        left = min(what.reach, at) if number % 5 else number
        run.append(R.Member(at, text[at - left : at + what.window - number % 3 * 40], left, number))
    seen = {}
    for i, member in enumerate(run):
        for start in range(len(member.segment) - what.window + 1):
            seen.setdefault(member.segment[start : start + what.window], []).append((i, start - member.left))
    expected = [None] * len(run)
    for places in seen.values():
        for i, start in places if len(places) > 1 else ():
            low, high = expected[i] or (start, start + what.window)
            expected[i] = min(low, start), max(high, start + what.window)
    assert sum(e is not None for e in expected) > 20
    assert suffix_arrays.compare(run, what) == expected
    for batch in (1, 7):
        family = suffix_arrays.Family(what.window)
        for i in range(0, len(run), batch):
            family.add(run[i : i + batch])
            assert sum(level is not None for level in family.levels) == bin(i // batch + 1).count("1")
        family.close()
        assert family.reach() == expected


def test_groups_of_edited_copies(spark, monkeypatch):
    rows = [(i, t.decode(), None, None) for i, t in enumerate(edited_copies(40))]
    rows += [(None, rows[0][1], None, None)] * 30
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    bytes_left, words_left = removed_bytes(rows), removed_words(rows)
    monkeypatch.setattr(R, "RUN", 3)
    monkeypatch.setattr(phrases, "SHARD", 2)
    for group in (1 << 16, 2):
        monkeypatch.setattr(R, "GROUP", group)
        same_rows(suffix_arrays.remove_repeats(docs).collect(), bytes_left)
        same_rows(phrases.remove_passages(docs).collect(), words_left)


def test_windows_of_an_earlier_document_only():
    words = [b"w%d" % i for i in range(60)]
    one = b" ".join([b"x", *words])
    two = b" ".join([b"y", *words])
    run = [R.Member(0, one, 11, 1), R.Member(0, two, 11, 2)]
    assert phrases.compare(run, phrases.WORDS) == [None, (-10, 50)]
    assert phrases.compare(run[:1], phrases.WORDS) == [None]


def test_automata_hold_only_windows_that_bound_a_reach(monkeypatch):
    words = [b"w%d" % i for i in range(88)]
    run = [R.Member(1, b" ".join(words), 38, order) for order in (3, 9)]
    run.append(R.Member(1, b" ".join(words[10:70] + [b"x"] * 28), 28, 5))
    located, sizes = phrases._located, []

    def counted(*args):
        sizes.append(len(args[-1]))
        return located(*args)

    monkeypatch.setattr(phrases, "_located", counted)
    assert phrases.compare(run, phrases.WORDS) == [None, (-38, 50), (-28, 32)]
    assert sizes == [4]  # of 39 windows


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    words = [b"w%d" % i for i in range(60)]
    run = [
        R.Member(1, b" ".join(words[:55] + [b"x"] * 5), 10, 1),
        R.Member(1, b" ".join(words), 10, 2),
    ]
    windows = phrases._windows

    def clashing(segments, what):
        each, place, hashes = windows(segments, what)
        hashes[each == 1] = hashes[each == 0]
        return each, place, hashes

    monkeypatch.setattr(phrases, "_windows", clashing)
    assert phrases.compare(run, phrases.WORDS) == [None, (-10, 45)]


def test_more_words_than_characters():
    tail = [b"t%d" % i for i in range(50)]
    run = [
        R.Member(i // 2, b" ".join([b"%d" % (38 * i + k) for k in range(38)] + tail), 38, i)
        for i in range(32_000)
    ]
    assert phrases.compare(run, phrases.WORDS) == [None] + [(0, 50)] * 31_999


def test_long_texts_are_taken_in_runs(docs, rows, monkeypatch):
    whole = {tuple(x) for f in R._anchored(b"abc def " * 400 + b"xyz" * 500, suffix_arrays.BYTES) for x in zip(*(c.tolist() for c in f), strict=True)}
    monkeypatch.setattr(R, "_CHUNK", 97)
    parts = {tuple(x) for f in R._anchored(b"abc def " * 400 + b"xyz" * 500, suffix_arrays.BYTES) for x in zip(*(c.tolist() for c in f), strict=True)}
    assert whole == parts


def test_cut_texts_keeps_columns(docs, rows):
    found = suffix_arrays.cut_texts(docs)
    assert found.columns == docs.columns
    expected = [
        (d, None if t is None else kept.decode(errors="ignore"))
        for (d, t, *_), (_, _, _, _, kept) in zip(rows, removed_bytes(rows), strict=True)
    ]
    same_rows([(r.doc_id, r.text) for r in found.collect()], expected)
    assert all(r.n_chars == len(r.text) for r in found.where("n_chars > 1 and text is not null").collect())


def shingle_sets(rows):
    for d, text, *_ in rows:
        w = split(text)
        yield d, text or "", {tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))}


def brute_classes(rows):
    items = list(shingle_sets(rows))
    parent = list(range(len(items)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, (_, s, a)), (j, (_, t, b)) in itertools.combinations(enumerate(items), 2):
        if s == t or (a and b and len(a & b) / len(a | b) >= 0.8):
            parent[top(i)] = top(j)
    lows: dict[int, int] = {}
    sizes = Counter(top(i) for i in range(len(items)))
    for i, (d, _, _) in enumerate(items):
        if d is not None:
            lows[top(i)] = min(lows.get(top(i), d), d)
    return [(d, lows.get(top(i)), sizes[top(i)]) for i, (d, _, _) in enumerate(items)]


def test_near_duplicate_classes(docs, rows):
    same_rows(near_duplicates.duplicate_classes(docs).collect(), brute_classes(rows))


def test_keep_one_of_each_class(docs, rows):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {c if c is not None else None for _, c, _ in brute_classes(rows)}
    found = [r.doc_id for r in kept.collect()]
    assert len(found) == len({c for c in found}) and set(found) == expected


def test_chain_of_near_copies_is_one_class(spark):
    pick = random.Random(5)
    text = [f"v{pick.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[pick.randrange(300)] = f"n{i}"
        text[pick.randrange(300)] = f"m{i}"
    found = near_duplicates.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.class_id for r in found.collect()} == {0}


def test_probability_jaccard_is_estimated():
    import numpy as np

    one = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    agree = []
    for shift in range(40):
        terms = near_duplicates.mixed(one, shift)
        a = near_duplicates.prob_min_hash(terms[:250], np.ones(250))
        b = near_duplicates.prob_min_hash(terms[50:], np.ones(250))
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 200 / 300) < 0.04


def test_weighted_samples_estimate_generalised_jaccard():
    import numpy as np

    sampler = fingerprints.Sampler()
    pick = np.random.default_rng(3)
    terms = np.unique(pick.integers(0, 2**63, 200, dtype=np.uint64))
    near = []
    for i in range(40):
        a, b = pick.integers(1, 9, len(terms)), pick.integers(1, 9, len(terms))
        named = near_duplicates.mixed(terms, i + 1)
        order = np.argsort(named)
        codes = [sampler.sample(named[order], w[order]) for w in (a, b)]
        near.append((codes[0] == codes[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(near)) < 0.04


def probes(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for (d, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        yield d, n, hashlib.sha256(edited.encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_edit_probes(docs, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", block_bytes)
    found = fingerprints.edit_probes(docs).collect()
    assert len(found) == len(rows)
    # Rows without an id, and rows of one id, have no order of their own but by a hash.
    unique = {d for d, n in Counter(r[0] for r in rows).items() if n == 1 and d is not None}
    last = max(unique)
    same_rows(
        [(r.doc_id, r.n_chars, r.edited_sha256) for r in found if r.doc_id in unique - {last}],
        [x for x in probes(rows) if x[0] in unique - {last}],
    )
    by_text = {}
    texts = {r[0]: r[1] or "" for r in rows if r[0] in unique}
    for r in found:
        if r.doc_id in unique:
            assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_fingerprint_column_and_likeness(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([("a b c d e f g", "a b c d e f g h"), (None, ""), ("x", None)], "s string, t string")
    both = table.select(fingerprints.fingerprint(F.col("s")).alias("f"), fingerprints.fingerprint(F.col("t")).alias("g"))
    found = [r[0] for r in both.select(fingerprints.likeness(F.col("f"), F.col("g"))).collect()]
    assert 0.5 < found[0] < 1 and found[1] == 1 and found[2] == 0


def test_nothing_in_nothing_out(nothing, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for table in (
        phrases.remove_passages(nothing), suffix_arrays.remove_repeats(nothing), suffix_arrays.cut_texts(nothing),
        near_duplicates.duplicate_classes(nothing), near_duplicates.keep_one(nothing),
        fingerprints.edit_probes(nothing), quality.judge_quality(nothing, labels), quality.keep_good(nothing, labels),
    ):
        assert table.collect() == []


def brute_kneser_ney(texts: list[str], order: int, classes: int):
    """Log probability of the last symbol of an n-gram, straight from the definition."""
    grams = {k: Counter() for k in range(1, order + 1)}
    for text in texts:
        symbols = [quality.BEFORE] * (order - 1) + [ord(c) for c in text]
        for i in range(len(symbols) - order + 1):
            grams[order][tuple(symbols[i : i + order])] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cuts = {}
    for k, counts in grams.items():
        n = [sum(1 for c in counts.values() if c == i) for i in range(1, 5)]
        if n[0] and n[1] and n[2]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            cuts[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
        else:
            cuts[k] = [0.5, 1.0, 1.5]

    followers = {k: {} for k in grams}
    for k, counts in grams.items():
        for g, c in counts.items():
            followers[k].setdefault(g[:-1], []).append(c)

    def p(gram: tuple) -> float:
        k = len(gram)
        if k == 0:
            return 1 / classes
        cs = followers[k].get(gram[:-1])
        if not cs:
            return p(gram[1:])
        cut = lambda c: cuts[k][min(c, 3) - 1]
        c = grams[k][gram]
        own = c - cut(c) if c else 0
        return own / sum(cs) + sum(map(cut, cs)) / sum(cs) * p(gram[1:])

    return p


def points(text: str) -> list[int]:
    return [ord(c) for c in text]


def test_kneser_ney_is_the_definition(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choice("aab cde\nÉ!Жж字") for _ in range(pick.randint(0, 80))) for _ in range(30)]
    asked = [*texts[:5], "zebra 12 aab", "aab!", "жЖ字字"]
    order = quality.ORDER

    def grams(text):
        symbols = [quality.BEFORE] * (order - 1) + points(text)
        return ["".join(map(chr, symbols[i : i + order])) for i in range(len(text))]

    counts = Counter(g for t in texts for g in grams(t))
    counts.update({g: 0 for t in asked for g in grams(t)})
    table = spark.createDataFrame(list(counts.items()), "gram string, c bigint")
    found = {r.gram: r.p for r in quality.kneser_ney(table).collect()}
    p = brute_kneser_ney(texts, order, len(set("".join(texts))) + 1)
    assert found.keys() == counts.keys()
    for gram in found:
        assert abs(found[gram] - p(tuple(points(gram)))) < 1e-12


def test_runs_count_every_gram_of_long_texts_and_large_alphabets(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(quality, "_AT_ONCE", 50)
    monkeypatch.setattr(quality, "_MOST_SYMBOLS", 20)
    pick = random.Random(8)
    texts = ["".join(chr(pick.randint(97, 97 + w)) for _ in range(n)) for n, w in ((400, 60), (3, 5), (0, 1), (90, 15))]
    texts.append("".join(chr(pick.choice([0x10000, 0x4E00, 65])) for _ in range(120)))
    flags = [True, False, True, True, False]
    got: Counter = Counter()

    def emit(strings, counts):
        for g, c in zip(strings.to_pylist(), counts.tolist(), strict=True):
            got[g] += c

    counter = quality._Counter(emit, quality.ORDER)
    for run in quality.runs(zip(texts, flags, strict=True)):
        counter.add(*run)
    counter.flush()
    expected: Counter = Counter()
    for text, flag in zip(texts, flags, strict=True):
        padded = chr(quality.BEFORE) * (quality.ORDER - 1) + text
        for i in range(len(text)):
            expected[padded[i : i + quality.ORDER]] += flag
    assert dict(got) == dict(expected)
    logs = np.arange(len(got), dtype=np.float32)
    at = dict(zip(got, logs.tolist(), strict=True))
    answers = quality.Answers(pa.array(list(got)), logs)
    for text in texts:
        padded = chr(quality.BEFORE) * (quality.ORDER - 1) + text
        found = [x for p, e, _ in quality.runs([(text, False)]) for x in answers(p, e).tolist()]
        assert found == [at[padded[i : i + quality.ORDER]] for i in range(len(text))]


def test_junk_of_other_scripts_is_told_from_clean_text(spark):
    pick = random.Random(5)
    words = {"ru": "мир дом река слово город человек время".split(), "zh": "今天 天气 我们 学习 中国 历史 文化".split()}
    rows, labels = [], []
    for i in range(400):
        lang = ("ru", "zh")[i % 2]
        text = " ".join(pick.choice(words[lang]) for _ in range(60))
        junk = i % 10 >= 8
        if junk:
            letters = list(text)
            pick.shuffle(letters)
            text = "".join(letters)
        rows.append((i, lang, text))
        if not junk and i % 4 < 2:
            labels.append((i, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = quality.judge_quality(docs, labels).collect()
    assert sum(r.keep for r in found if r.doc_id % 10 >= 8) == 0
    assert sum(r.keep for r in found if r.doc_id % 10 < 8) >= 310


def test_verdicts_are_those_of_the_definition(spark):
    import math

    import numpy as np

    pick = random.Random(6)
    rows = [
        (i, pick.choice(["en", "de", None]), "".join(pick.choice("abc dé") for _ in range(pick.randint(0, 60))))
        for i in range(120)
    ]
    trusted = [i for i in range(120) if i % 3]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id bigint, quality int, toxic int")
    held = {
        r.doc_id
        for r in labels.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) = 0 AS held").collect()
        if r.held
    }
    sure = [t for i, _, t in rows if i in trusted and i not in held]
    order, steady = quality.ORDER, quality.STEADY_CHARS
    p = brute_kneser_ney(sure, order, len(set("".join(sure))) + 1)

    def mean_log(text):
        symbols = [quality.BEFORE] * (order - 1) + points(text)
        return -sum(math.log(p(tuple(symbols[i : i + order]))) for i in range(len(text))) / len(text)

    logs = {i: mean_log(t) for i, _, t in rows if t}
    known = [(lang, len(t), logs[i]) for i, lang, t in rows if i in held and t]
    overall = np.mean([x for _, _, x in known])

    def limit(lang):
        mine = [k for k in known if k[0] == lang]
        usual = np.mean([x for _, _, x in mine]) if mine else overall
        scores = sorted(math.exp((x * n + usual * steady) / (n + steady)) for _, n, x in mine or known)
        return usual, scores[math.ceil(quality.QUANTILE * len(scores)) - 1] * quality.MARGIN

    found = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    for i, lang, text in rows:
        usual, most = limit(lang)
        assert math.isclose(found[i].limit, most, rel_tol=1e-5)
        if text:
            score = math.exp((logs[i] * len(text) + usual * steady) / (len(text) + steady))
            assert math.isclose(found[i].perplexity, score, rel_tol=1e-5)
            assert found[i].keep == (found[i].perplexity <= found[i].limit)


def test_quality_on_held_out_labels(spark, sf_dir):
    from pyspark.sql import functions as F

    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = quality.judge_quality(docs, seen).join(held, "doc_id")
    good, bad = found.where("quality = 1").agg(F.avg(F.col("keep").cast("int"))), found.where("quality = 0").agg(
        F.avg(F.col("keep").cast("int"))
    )
    assert good.first()[0] > 0.97 and bad.first()[0] < 0.3


def test_without_trusted_documents_all_are_kept(docs, rows, spark):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    found = quality.judge_quality(docs, labels).collect()
    assert len(found) == len(rows) and all(r.keep for r in found)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_awkward_documents_are_judged(docs, rows, spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 40)], "doc_id bigint, quality int, toxic int")
    found = quality.judge_quality(docs, labels).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    assert all(r.keep and r.perplexity is None for r in found if r.doc_id is not None and not texts[r.doc_id])
    assert quality.keep_good(docs, labels).count() == sum(r.keep for r in found)
