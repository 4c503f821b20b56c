"""Tokens, packing, search, chat and hosts against plain Python."""

import functools
import hashlib
import random
from array import array

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from apportion.llm import bpe, chat, metric_tree, packing, queries, reputation


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = bpe.load_ranks(queries.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "  ", "a", "a  b", " a \n b ", "it's  'll we'RE", "x\u00a0y\u3000 \u00a0 z", "\x1c a \x1cb",
    "naïve 日本語 😀😀 text", "1 2 3   4", "word " * 700, "z" * 5000, "<|endoftext|> a <|endoftext|>", "\u0301e\u0301 \ud7ff",
]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(2)
    more = ["".join(pick.choice(" \n\ta1'sé!   \x1c_²٣") for _ in range(pick.randint(0, 14))) for _ in range(300)]
    return [*TEXTS, *more, TEXTS[4]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, length int")


def test_ids_are_those_of_the_library_and_decode(docs, texts, tiktoken_encoding):
    ids = bpe.with_ids(docs, queries.RANKS, public_tokenizers.PATTERN)
    found = sorted(map(tuple, (r.ids for r in ids.collect())))
    assert found == sorted(tuple(tiktoken_encoding.encode_ordinary(t or "")) for t in texts)
    back = bpe.decoded(ids, queries.RANKS)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)


def test_single_pieces_of_any_bytes(tiktoken_encoding):
    ranks = bpe.load_ranks(queries.RANKS)
    machine, pick, words = bpe.Transducer(ranks, kept=3000), random.Random(3), list(ranks)
    for i in range(4000):
        if i % 3 == 0:
            piece = b"".join(pick.choice(words) for _ in range(pick.randint(1, 6)))
        elif i % 3 == 1:
            piece = bytes(pick.randrange(256) for _ in range(pick.randint(1, 20)))
        else:
            piece = bytes(pick.choice(b"abc eth") for _ in range(pick.randint(1, 40)))
        assert machine.encode(piece) == tiktoken_encoding._core_bpe.encode_single_piece(piece)


def test_a_piece_is_encoded_once_whatever_stands_around_it(monkeypatch):
    ranks = bpe.load_ranks(queries.RANKS)
    encode, met = bpe.Transducer.encode, []
    monkeypatch.setattr(bpe.Transducer, "encode", lambda self, piece: met.append(piece) or encode(self, piece))
    encoder = bpe.rank_encoder(ranks, public_tokenizers.PATTERN)
    text = "x éaioiê éaioiê, éaioiê. (éaioiê) éaioiê;"
    ids = list(np.frombuffer(encoder.ids(text), "<u4"))
    assert met.count(" éaioiê".encode()) == 1
    machine = bpe.Transducer(ranks)
    pieces = [p.encode() for p in regex.findall(public_tokenizers.PATTERN, text)]
    assert ids == [i for p in pieces for i in ([ranks[p]] if p in ranks else machine.merged(p))]


def test_few_pieces_are_remembered_and_long_ones_are_not():
    ranks = bpe.load_ranks(queries.RANKS)
    encoder, pick = bpe.PieceEncoder(ranks, public_tokenizers.PATTERN, kept=20), random.Random(5)
    words = ["".join(pick.choice("éaioxq") for _ in range(pick.randint(1, 9))) for _ in range(60)] + ["x" * 90]
    machine = bpe.Transducer(ranks)
    for _ in range(40):
        texts = [" ".join(pick.choices(words, k=12)) for _ in range(2)]
        for text, ids in zip(texts, encoder(texts), strict=True):
            pieces = [p.encode() for p in regex.findall(public_tokenizers.PATTERN, text)]
            expected = [i for p in pieces for i in ([ranks[p]] if p in ranks else machine.merged(p))]
            assert np.frombuffer(ids, "<u4").tolist() == expected
        assert max(map(len, encoder._known)) <= bpe.LONGEST_KEPT
        assert len(encoder._known) + len(encoder._older) <= 60


def test_steps_are_made_when_they_are_wanted_often():
    ranks = bpe.load_ranks(queries.RANKS)
    machine, pieces = bpe.Transducer(ranks), [" éaioiê".encode(), b" onthwh", b"thorshha", b"a" * 200]
    for _ in range(bpe.WANTED // 3):
        assert [machine.encode(p) for p in pieces[:3]] == [machine.merged(p) for p in pieces[:3]]
    assert len(machine.states) == 1
    for _ in range(bpe.WANTED):
        assert [machine.encode(p) for p in pieces] == [machine.merged(p) for p in pieces]
    assert len(machine.states) > 1


def test_pieces_of_a_batch_are_walked_together(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 700)
    ranks = bpe.load_ranks(queries.RANKS)
    machine, pick, words = bpe.Transducer(ranks, kept=300), random.Random(8), list(ranks)
    alone = []
    monkeypatch.setattr(machine, "_simulated", lambda *a: alone.append(a))
    for _ in range(3):
        pieces = [b"".join(pick.choice(words) for _ in range(pick.randint(1, 6))) for _ in range(800)]
        pieces += [bytes(pick.randrange(256) for _ in range(pick.randint(1, 20))) for _ in range(800)]
        pieces += [bytes(pick.choice(b"abc eth") for _ in range(pick.randint(1, 90))) for _ in range(800)]
        pieces += [("".join(pick.choice("éaoqß日") for _ in range(pick.randint(1, 20)))).encode() for _ in range(800)]
        found = machine.encode_all([*pieces, b""])
        assert found[-1] == b"" and all(len(p) > bpe.SIMULATED for _, p, _ in alone)
        for piece, ids in zip(pieces, found, strict=False):
            assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding._core_bpe.encode_single_piece(piece)


def test_pairs_in_one_slot_do_not_mix():
    ranks = bpe.load_ranks(queries.RANKS)
    machine, pick = bpe.Transducer(ranks), random.Random(4)
    walk = bpe._Walk(machine)
    walk._SLOTS, walk.judged = 3, np.full(8, -1, dtype=np.int64)
    for _ in range(4):
        left, right = (np.array([pick.randrange(low, 600) for _ in range(2000)]) for low in (-1, 0))
        expected = [machine._suits(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        assert walk._suit(left, right).tolist() == expected


def test_transducer_lags_by_a_bounded_lookahead():
    ranks = bpe.load_ranks(queries.RANKS)
    machine = bpe.Transducer(ranks)
    longest = max(map(len, ranks))
    machine.encode(b"theresting" * 300)
    assert all(len(w) <= longest for s in machine.states for _, _, w in s)


def test_streaming_decoder_finishes_cut_characters(tiktoken_encoding):
    words = {i: w for w, i in bpe.load_ranks(queries.RANKS).items()}
    text = "日本語 😀 naïve"
    decoder, out = bpe.StreamingDecoder(words), []
    for i in tiktoken_encoding.encode_ordinary(text):
        out.append(decoder.feed([i]))
    assert "".join(out) + decoder.finish() == text
    with pytest.raises(UnicodeDecodeError):
        broken = bpe.StreamingDecoder(words)
        broken.feed([bpe.load_ranks(queries.RANKS)["日".encode()[:1]]])
        broken.finish()


def test_pieces_hold_each_id_once_with_little_padding(docs, texts):
    from tokenizers import Tokenizer

    encoder = functools.partial(packing.tokenizer_encoder, queries.VOCABULARY)
    rows = packing.pack(docs.repartition(2), encoder, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    expected = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    used = padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids)
            at += r.length
        assert at <= packing.CAPACITY
        used += at
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert used == sum(map(len, expected)) and padding <= 2 * packing.CAPACITY
    # Documents without an id can't be told apart, the others come back whole.
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    whole = [
        [i for r in sorted(v, key=lambda r: r.start) for i in r.ids] for k, v in by_doc.items() if k is not None
    ]
    for ids in whole:
        expected.remove(ids)
    assert all(r.doc_tokens == sum(x.length for x in by_doc[r.doc_id]) for r in rows if r.doc_id is not None)


def test_packing_nothing(spark):
    encoder = functools.partial(packing.tokenizer_encoder, queries.VOCABULARY)
    nothing = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(nothing, encoder).collect() == []
    assert bpe.with_ids(nothing, queries.RANKS, public_tokenizers.PATTERN).collect() == []


def brute_top(vectors, queries_, k):
    out = []
    for own, q in queries_:
        scored = {(int(np.dot(q, v)), n) for n, v in vectors if n != own}
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
        out += [(own, i + 1, n, s) for i, (s, n) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, query_rows", [(1 << 15, 1 << 12), (97, 7)])
def test_top_products_with_ties_and_bad_rows(spark, shard_rows, query_rows):
    pick = np.random.default_rng(1)
    good = [(i, [float(x) for x in pick.normal(size=8) * 0.2]) for i in range(600)]
    good += [(600 + i, good[50][1]) for i in range(300)]
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, good[0][1]), (2004, [])]
    table = spark.createDataFrame([(n, v, 1) for n, v in [*good, *bad, good[3]]], "vec_id bigint, embedding array<float>, v int")
    vectors = metric_tree.whole_vectors(table.select("vec_id", "embedding"))
    whole = [(n, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for n, v in good]
    found = metric_tree.top_inner_products(vectors, F.col("vec_id") % 50 == 0, 5, shard_rows, query_rows)
    expected = brute_top(whole, [x for x in whole if x[0] % 50 == 0], 5)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_few_candidates_and_none(spark):
    schema = "vec_id bigint, v array<bigint>"
    one = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (50, [0, 0])], schema)
    found = metric_tree.top_inner_products(one, F.col("vec_id") % 50 == 0, 5)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1, 11), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert metric_tree.top_inner_products(spark.createDataFrame([], schema), F.lit(True)).collect() == []


def test_the_tree_avoids_distances():
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(40, 8)) * 3000
    vectors = np.concatenate([c + pick.normal(size=(100, 8)) * 20 for c in centres]).astype(int)
    tree = metric_tree.MTree(np.arange(len(vectors)), vectors, float((vectors.astype(float) ** 2).sum(axis=1).max()))
    for i in range(20):
        best = tree.search(i, vectors[i], 5)
        scores = vectors @ vectors[i]
        order = sorted((n for n in range(len(vectors)) if n != i), key=lambda n: (-scores[n], n))[:5]
        assert [n for _, n in best] == order
    assert tree.computed < 20 * len(vectors) / 2


def test_events_fold_into_messages(spark):
    events = [
        (1, 0, "m", 2, "delta", None, "lo"), (1, 0, "m", 1, "delta", "user", "hel"),
        (1, 1, "m", 1, "delta", "assistant", "bad"), (1, 1, "m", 2, "regenerate", None, "a"), (1, 1, "m", 3, "delta", None, "b"),
        (1, 2, "m", 5, "delta", None, "!"), (1, 2, "m", 4, "edit", "user", "new"), (1, 2, "m", 3, "delta", "user", "old"),
        (None, None, None, None, None, None, None),
    ]
    schema = "conv_id bigint, turn bigint, message string, seq bigint, kind string, role string, text string"
    found = {r.turn: (r.role, r.text) for r in chat.fold(spark.createDataFrame(events, schema)).collect()}
    assert found == {0: ("user", "hello"), 1: ("assistant", "ab"), 2: ("user", "new!"), None: ("", "")}
    assert chat.fold(spark.createDataFrame([], schema)).collect() == []


def test_conversations_come_back_whole(spark):
    pick = random.Random(1)
    marks = ["<|im_start|>", "<|im_end|>\n", "\\", "\\1", "[INST]", "</s>", "\n", "é😀", "word ", "0"]
    rows = []
    for conv in range(30):
        for turn in range(pick.randint(1, 6)):
            role = ["user", "assistant", "system", None, "odd\nrole<|"][pick.randrange(5)]
            rows.append((conv, turn, role, "".join(pick.choice(marks) for _ in range(pick.randint(0, 400)))))
    rows += [(99, 0, "assistant", None), (99, 0, "assistant", None), (None, 0, "user", "x"), (99, None, "user", "first")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, seq int")
    pieces = chat.render(chat.fold(chat.as_events(table)))
    assert all(
        r.piece.count("<") == 2 and "[" not in r.piece and r.piece.endswith(chat.CLOSE) for r in pieces.collect()
    )
    found = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = found[conv]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_hosts_paths_and_rules(spark):
    urls = [
        ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://a.net", "a.net", "", None, "allow"), ("https://a.net/", "a.net", "/", "net/", "block"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://b.org#/fr/", "b.org", "", None, "allow"), ("http://ÄB.org/fr/é", "Äb.org", "/fr/é", "org/fr/", "allow"),
        ("no scheme/", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    rows = [(i, u[0], "h", "x") for i, u in enumerate(urls)] + [(None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    outcomes = spark.createDataFrame([], "page_id bigint, bad int")
    found = {r.page_id: tuple(r)[1:] for r in reputation.judge_urls(pages, outcomes, queries.RULES).collect()}
    assert found == {**{i: u[1:] for i, u in enumerate(urls)}, None: ("", "", None, "allow")}
    assert reputation.judge_urls(pages.limit(0), outcomes, queries.RULES).collect() == []


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    pages, bad = [], []
    for host, n, wrong in (("evil.a.com", 60, 58), ("fine.a.com", 60, 1), ("one.b.com", 1, 1), ("other.b.com", 80, 2), ("new.c.com", 0, 0)):
        for _ in range(max(n, 1)):
            i = len(pages)
            pages.append((i, f"http://{host}/{i}"))
            if n:
                bad.append((i, int(sum(1 for j, _ in bad if pages[j][1].startswith(f"http://{host}/")) < wrong)))
    found = reputation.judge_urls(
        spark.createDataFrame(pages, "page_id bigint, url string"),
        spark.createDataFrame([*bad, (None, 1), (3, None)], "page_id bigint, bad int"), (),
    )
    verdicts = {r.host: r.verdict for r in found.collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {"evil.a.com"}
