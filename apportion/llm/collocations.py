"""Phrases whose words occur together far more often than apart, counted with double-array tries.

Levels follow each other. Frequent words are counted first. Then, for two and three words, a pass
over the texts finds the Apriori-safe candidates, phrases all of whose shorter parts are frequent: it
walks the trie of the level before, and places where two frequent parts overlap name a
candidate. A second walk, with the trie of the candidates, counts them.

Tries are double arrays over bytes: from state s the byte c leads to t = base[s] + c if check[t] = s.
All words of a few MB of text are start positions; numpy moves the states of all that are
still alive by one byte at a time, and accepting states are summed by ``bincount``. Tasks
hold sums per state, and these are added up. Every trie has at most about
``TRIE_BYTES`` of phrases: in the order of the alphabet candidates are cut into as many tries as that takes, built
by tasks into the shared folder, and a task loads one after the other for some ``TEXT_HELD`` bytes of text. A trie
is only walked from the words that begin like phrases of its range, so more tries are hardly more steps, and
what a task passes on is in proportion to the text that it has read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.llm.warc import opened
from apportion.operators.ordinal import number_rows
from apportion.session import scratch_dir, written

LEAST_COUNT = 10
LONGEST = 3  # words
BEST = 2000  # phrases of a language
SUBSUMED_PERCENT = 50
NO_LANGUAGE = "und"
TRIE_BYTES = 12 << 20  # of phrases in one trie, of which about a third are states of 12 bytes
COUNT_BLOCK = 1024  # phrases whose sums travel together
TEXT_BYTES = 1 << 20  # of text cut into words at once
TEXT_HELD = 16 << 20  # of words that several tries are loaded for, one after the other
WALKED = 1 << 18  # words walked at once
HELD_KEYS = 1 << 18  # keys or words a task holds before it passes them on

# Fixed characters of the definition.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_SPACES = b" \t"

_CODES = np.arange(256, dtype=np.uint8)
_CODES[65:91] += 32
_KIND = np.zeros(256, dtype=np.int8)
_KIND[list(_SPACES)], _KIND[list(_PIECE_ENDS)] = 1, 2
_CODES[_KIND == 1], _CODES[_KIND == 2] = 0x20, 0x0A
_WORDS_ONLY = np.where(_KIND > 0, np.uint8(0x20), _CODES).tobytes()
_GAP = b"[" + re.escape(_SPACES + _PIECE_ENDS) + b"]"
_NEXT_WORDS = re.compile((_GAP + b"*" + _GAP.replace(b"[", b"[^", 1) + b"+") * (LONGEST - 1))
_NEXT_GAP = re.compile(_GAP)


# Texts


@dataclass
class Words:
    """Words of a part of the texts, each followed by one separator in ``text``.

    ``counted`` says which words begin a phrase here; the others are the overlap with the next part.
    """

    text: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    counted: np.ndarray


def cut(raw: bytes, size: int = TEXT_BYTES) -> Iterator[tuple[bytes, int]]:
    """Parts of a text with the number of their bytes at which phrases may begin."""
    at = 0
    while len(raw) - at > size:
        gap = _NEXT_GAP.search(raw, at + size)
        if gap is None:
            break
        more = _NEXT_WORDS.match(raw, gap.start())
        yield raw[at : more.end() if more else len(raw)], gap.start() - at
        at = gap.start()
    yield raw[at:], len(raw) - at


def words_of(parts: list[tuple[int, bytes, int]]) -> Words:
    """Words of parts (language, text, bytes that count)."""
    data = np.frombuffer(b"\n".join([x for _, x, _ in parts]) + b"\n", dtype=np.uint8)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = kind == 0
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    ends = np.flatnonzero(edges == -1)
    # A word's separator ends the piece if any character of the gap does.
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kind == 2, out=breaks[1:])
    broken = breaks[np.append(starts[1:], len(data))] > breaks[ends] if len(ends) else np.zeros(0, dtype=bool)
    text = _CODES[data]
    text[ends] = np.where(broken, np.uint8(0x0A), np.uint8(0x20))
    keep = kind == 0
    keep[ends] = True
    lengths = ends - starts + 1
    firsts = np.cumsum([0, *(len(x) + 1 for _, x, _ in parts)])
    owner = np.searchsorted(firsts, starts, "right") - 1
    limit = firsts[:-1] + np.array([n for _, _, n in parts], dtype=np.int64)
    languages = np.array([x for x, _, _ in parts], dtype=np.int64)
    return Words(text[keep], np.cumsum(lengths) - lengths, languages[owner], starts < limit[owner])


def parts_of(batches: Iterator[pa.RecordBatch], languages: dict[str, int]) -> Iterator[Words]:
    """The texts of Arrow batches (language, text as bytes) in parts of bounded size."""
    held: list[tuple[int, bytes, int]] = []
    size = 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            number = languages.setdefault(language, len(languages))
            for part, n in cut(text.as_py()):
                held.append((number, part, n))
                size += len(part)
                if size >= TEXT_BYTES:
                    yield words_of(held)
                    held, size = [], 0
    if held:
        yield words_of(held)


def held_words(batches: Iterator[pa.RecordBatch], languages: dict[str, int], tries: int) -> Iterator[Words]:
    """The parts of :func:`parts_of`, about ``TEXT_HELD`` bytes together if there are several tries to be loaded."""
    if tries == 1:
        yield from parts_of(batches, languages)
        return
    held: list[Words] = []
    size = 0
    for words in parts_of(batches, languages):
        held.append(Words(words.text, words.starts + size, words.language.astype(np.int32), words.counted))
        size += len(words.text)
        if size >= TEXT_HELD:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[Words]) -> Words:
    columns = zip(*((w.text, w.starts, w.language, w.counted) for w in held), strict=True)
    return Words(*(np.concatenate(column) for column in columns))


# Tries

_HEAD = 7  # bytes by which a trie's words are told from others


def _head(text: bytes, rest: bytes) -> int:
    return int.from_bytes((text + rest * _HEAD)[:_HEAD], "big")


class Starts:
    """Words by their language and first bytes."""

    def __init__(self, words: Words, languages: int):
        data = np.append(words.text, np.zeros(8, dtype=np.uint8))
        eight = np.ndarray(len(words.text) + 1, dtype=">u8", buffer=data, strides=(1,))
        self._order = np.argsort(words.language.astype(np.uint16) if languages <= 1 << 16 else words.language, kind="stable")
        self._heads = (eight[words.starts[self._order]].astype(np.uint64) >> np.uint64(8)).astype(np.int64)
        self._bounds = np.searchsorted(words.language[self._order], np.arange(languages + 1))

    def within(self, ranges: dict[str, tuple[int, int]], languages: dict[str, int]) -> np.ndarray:
        """Numbers of the words from which a phrase within the ranges of its language can begin."""
        out = [np.zeros(0, dtype=np.int64)]
        for name, (low, high) in ranges.items():
            if name in languages:
                own = slice(*self._bounds[languages[name] : languages[name] + 2])
                heads = self._heads[own]
                out.append(self._order[own][(heads >= low) & (heads <= high)])
        return np.concatenate(out)


@dataclass
class Trie:
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # number of the phrase that ends in a state, or -1
    roots: dict[str, int]

    def walk(self, words: Words, names: list[str], some: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Start words and numbers of phrases found, level by level of bytes; from all words or ``some``."""
        roots = np.array([self.roots.get(x, -1) for x in names], dtype=np.int64)
        some = np.arange(len(words.starts)) if some is None else some
        state = roots[words.language[some]] if len(some) else np.zeros(0, dtype=np.int64)
        word = some[state >= 0]
        state, at = state[state >= 0], words.starts[word]
        symbol = words.text[at] if len(at) else np.zeros(0, dtype=np.uint8)
        while len(word):
            ahead = self.base[state] + symbol
            alive = np.flatnonzero(self.check[ahead] == state)
            state, word, at = ahead[alive], word[alive], at[alive] + 1
            symbol = words.text[at]
            over = np.flatnonzero((symbol == 0x20) | (symbol == 0x0A))
            if len(over):
                phrase = self.accept[state[over]]
                found = phrase >= 0
                if found.any():
                    yield word[over[found]], phrase[found]
                on = symbol != 0x0A
                state, word, at, symbol = state[on], word[on], at[on], symbol[on]


class TrieBuilder:
    """Places the children of all states of one depth at a time."""

    def __init__(self, room: int):
        self._used = np.zeros(max(room, 1024), dtype=bool)
        self._low = self._scan = self.top = 0

    def _reach(self, n: int) -> None:
        if n > len(self._used):
            self._used = np.append(self._used, np.zeros(n, dtype=bool))

    def take(self, n: int, least: int) -> np.ndarray:
        """``n`` free places from ``least`` on."""
        self._reach(self.top + n + least + 256)
        while self._low < len(self._used) and self._used[self._low]:
            self._low += 1
        start = max(self._low, least)
        free = start + np.flatnonzero(~self._used[start : max(self.top, start) + n])[:n]
        self._used[free] = True
        self.top = max(self.top, int(free[-1]) + 1 if n else 0)
        return free

    def fit(self, symbols: np.ndarray, tries: int = 64) -> int:
        """A base at which all symbols find a free place.

        The search goes on where the last one failed; places left behind are for ``take``.
        """
        self._reach(self.top + 1024)
        self._scan = max(self._scan, self._low, 256)
        lead, rest = int(symbols[0]), symbols - symbols[0]
        while self._scan < self.top:
            free = self._scan + np.flatnonzero(~self._used[self._scan : self._scan + 4 * tries])[:tries]
            fits = np.flatnonzero(~self._used[free[:, None] + rest].any(axis=1)) if len(free) else free
            if len(fits):
                base = int(free[fits[0]]) - lead
                break
            self._scan = int(free[-1]) + 1 if len(free) == tries else self._scan + 4 * tries
        else:
            base = max(self.top, 256)
        self._reach(base + 512)
        self._used[base + symbols] = True
        self.top = max(self.top, base + int(symbols[-1]) + 1)
        return base


def build_trie(languages: list[str], phrases: list[bytes], numbers: list[int]) -> Trie:
    """A double-array trie of phrases, distinct within their language."""
    order = sorted(range(len(phrases)), key=lambda i: (languages[i], phrases[i]))
    names = sorted(set(languages))
    lengths = np.array([len(phrases[i]) for i in order], dtype=np.int64)
    data = np.frombuffer(b"".join([phrases[i] for i in order]), dtype=np.uint8)
    offsets = np.cumsum(lengths) - lengths
    number = np.array([numbers[i] for i in order], dtype=np.int32)
    builder = TrieBuilder(2 * len(data) + 1024)
    roots = dict(zip(names, builder.take(len(names), 1).tolist(), strict=True))
    size = 2 * len(data) + len(names) + 2048
    base, check, accept = np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
    state = np.array([roots[languages[i]] for i in order], dtype=np.int64)
    depth = 0
    while len(state):
        symbol = data[offsets + depth].astype(np.int64)
        fresh = np.ones(len(state), dtype=bool)
        fresh[1:] = (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(fresh)
        parent, edge = state[at], symbol[at]
        heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        counts = np.diff(np.append(heads, len(parent)))
        many = np.flatnonzero(counts > 1)
        bases = np.empty(len(heads), dtype=np.int64)
        for k in many[np.argsort(-counts[many], kind="stable")].tolist():
            bases[k] = builder.fit(edge[heads[k] : heads[k] + counts[k]])
        one = np.flatnonzero(counts == 1)
        places = builder.take(len(one), 256)
        bases[one] = places - edge[heads[one]]
        child = np.repeat(bases, counts) + edge
        if builder.top + 512 > len(base):
            more = builder.top + 1024
            base, check = (np.append(x, np.zeros(more, np.int32)) for x in (base, check))
            accept = np.append(accept, np.full(more, -1, np.int32))
        base[parent[heads]] = bases
        check[child] = parent
        state = child[np.cumsum(fresh) - 1]
        depth += 1
        done = lengths == depth
        accept[state[done]] = number[done]
        state, offsets, lengths, number = (x[~done] for x in (state, offsets, lengths, number))
    top = builder.top + 512
    return Trie(base[:top], check[:top], accept[:top], roots)


_TRIE = "shard int, base binary, check binary, accept binary, names array<string>, roots array<int>"
_TRIE += ", lows array<bigint>, highs array<bigint>"


def ranges_of(languages: list[str], phrases: list[bytes]) -> dict[str, tuple[int, int]]:
    """The first bytes with which a text may begin that begins with a phrase and its end, from and to, by language."""
    out: dict[str, tuple[int, int]] = {}
    for name, phrase in zip(languages, phrases, strict=True):
        # A word or piece ends with a space or a line end, and whatever follows it.
        low, high = _head(phrase, b"\0"), _head(phrase + b" ", b"\xff")
        least, most = out.get(name, (low, high))
        out[name] = min(low, least), max(high, most)
    return out


@dataclass
class Tries:
    """Tries in the shared folder, and the table of their phrases: number, lang, phrase."""

    folder: str
    shards: int
    phrases: DataFrame

    def load(self, shard: int) -> tuple[Trie, dict[str, tuple[int, int]]]:
        """A trie and the ranges of its phrases."""
        key = (self.folder, shard)
        if key not in _loaded:
            _loaded.clear()  # one at a time
            system, path = opened(f"{self.folder}/shard={shard}")
            found = pa.dataset.dataset(path, filesystem=system, format="parquet").to_table()
            if not found.num_rows:
                _loaded[key] = build_trie([], [], []), {}
            else:
                arrays = (np.frombuffer(found[x][0].as_buffer(), dtype=np.int32) for x in ("base", "check", "accept"))
                names, roots, lows, highs = (found[x][0].as_py() for x in ("names", "roots", "lows", "highs"))
                ranges = dict(zip(names, zip(lows, highs, strict=True), strict=True))
                _loaded[key] = Trie(*arrays, dict(zip(names, roots, strict=True))), ranges
        return _loaded[key]

    def walk(self, words: Words, languages: dict[str, int]) -> Iterator[tuple[Trie, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """Each trie with the start words and numbers of phrases found with it."""
        starts = Starts(words, len(languages)) if self.shards > 1 else None
        for shard in range(self.shards):
            trie, ranges = self.load(shard)
            some = starts.within(ranges, languages) if starts else np.arange(len(words.starts))
            names = list(languages)
            yield trie, (x for i in range(0, len(some), WALKED) for x in trie.walk(words, names, some[i : i + WALKED]))


_loaded: dict[tuple[str, int], tuple[Trie, dict[str, tuple[int, int]]]] = {}


def tries_of(phrases: DataFrame) -> Tries | None:
    """Tries of the phrases (lang, phrase), of bounded size each; None without phrases."""
    spark = phrases.sparkSession
    size = phrases.agg(F.sum(F.octet_length("phrase") + 1)).head()[0]
    if size is None:
        return None
    numbered, count = number_rows(phrases.select("lang", "phrase"), "lang", "phrase", name="number")
    if count >= 1 << 31:
        raise ValueError("more phrases than 31 bits can number")
    each = max(1, count * TRIE_BYTES // int(size))
    shards = -(-count // each)
    shard = F.floor(F.col("number") / each).cast("int")
    table = written(numbered.select(shard.alias("shard"), F.col("number").cast("int").alias("number"), "lang", "phrase"), "phrases")

    def build(rows: pa.Table) -> pa.Table:
        languages, phrases = rows["lang"].to_pylist(), rows["phrase"].to_pylist()
        trie = build_trie(languages, phrases, rows["number"].to_pylist())
        ranges = ranges_of(languages, phrases)
        return pa.table({
            "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
            **{x: pa.array([getattr(trie, x).tobytes()], pa.binary()) for x in ("base", "check", "accept")},
            "names": [list(trie.roots)], "roots": pa.array([list(trie.roots.values())], pa.list_(pa.int32())),
            **{x: pa.array([[ranges[name][i] for name in trie.roots]], pa.list_(pa.int64())) for i, x in enumerate(("lows", "highs"))},
        })

    folder = scratch_dir(spark, "tries")
    as_bytes = table.select("shard", "number", "lang", F.col("phrase").cast("binary").alias("phrase"))
    tries = as_bytes.groupBy("shard").applyInArrow(build, _TRIE)
    tries.write.partitionBy("shard").option("compression", "none").parquet(folder)  # loaded far more often than written
    return Tries(folder, shards, table.select("number", "lang", "phrase"))


# Passes over the texts


class Sums:
    """Sums by 64-bit key that pass on what they hold before they grow large."""

    def __init__(self):
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._held = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        some, counts = np.unique(keys, return_counts=True)
        self._keys.append(some)
        self._counts.append(counts)
        self._held += len(some)
        if self._held > 2 * HELD_KEYS:
            keys, counts = self._merged()
            self._keys, self._counts, self._held = [keys], [counts], len(keys)
            if self._held > HELD_KEYS:
                yield from self.rows()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self._keys), np.concatenate(self._counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
        return keys[first], np.add.reduceat(counts, first) if len(keys) else counts

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self._merged()
        self._keys, self._counts, self._held = [], [], 0
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_pydict({"key": keys[i : i + (1 << 16)], "count": counts[i : i + (1 << 16)]})


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase, f of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = held[language]
                size -= len(mine)
                for part, n in cut(text.as_py()):
                    mine.update(part[:n].translate(_WORDS_ONLY).split(b" "))
                size += len(mine) + 1
                if size > HELD_KEYS // 2:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for language, counts in held.items():
            counts.pop(b"", None)
            items = list(counts.items())
            for i in range(0, len(items), 1 << 16):
                some = items[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "lang": [language] * len(some), "phrase": pa.array([x for x, _ in some], pa.binary()).cast(pa.string()),
                    "f": pa.array([n for _, n in some], pa.int64()),
                })

    local = texts.mapInArrow(count, "lang string, phrase string, f bigint")
    return written(local.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")


def overlaps(texts: DataFrame, tries: Tries) -> DataFrame:
    """left and right: numbers of frequent phrases that overlap in all but their ends often enough.

    Parts of one word follow each other, parts of more share all words but the outer two.
    """
    walked = Tries(tries.folder, tries.shards, None)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, int] = {}
        sums = Sums()
        for words in held_words(batches, languages, walked.shards):
            found = np.full(len(words.starts), -1, dtype=np.int64)
            for _, hits in walked.walk(words, languages):
                for word, phrase in hits:
                    found[word] = phrase
            on = np.zeros(len(found), dtype=bool)
            on[:-1] = words.text[words.starts[1:] - 1] == 0x20
            on[:-1] &= words.counted[:-1] & (found[:-1] >= 0) & (found[1:] >= 0)
            at = np.flatnonzero(on)
            yield from sums.add(found[at] << 32 | found[at + 1])
        _loaded.clear()
        yield from sums.rows()

    total = (
        texts.mapInArrow(pairs, "key bigint, count bigint")
        .groupBy("key")
        .agg(F.sum("count").alias("count"))
        .where(F.col("count") >= LEAST_COUNT)
    )
    low = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    return total.select(F.shiftright("key", 32).cast("int").alias("left"), low.cast("int").alias("right"))


def phrase_counts(texts: DataFrame, tries: Tries) -> DataFrame:
    """lang, phrase, f of the phrases in the tries, counted at all positions of all texts."""
    walked = Tries(tries.folder, tries.shards, None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, int] = {}
        first, total = 0, np.zeros(0, dtype=np.int64)
        for words in held_words(batches, languages, walked.shards):
            for trie, hits in walked.walk(words, languages):
                if not len(total):
                    known = trie.accept[trie.accept >= 0]
                    first = int(known.min(initial=(1 << 31) - 1)) // COUNT_BLOCK
                    total = np.zeros(max(0, int(known.max(initial=-1)) + 1 - first * COUNT_BLOCK), dtype=np.int64)
                numbers = [phrase[words.counted[word]] for word, phrase in hits]
                if numbers:
                    total += np.bincount(np.concatenate(numbers) - first * COUNT_BLOCK, minlength=len(total))
                if walked.shards > 1:  # a single trie's sums are kept until the end
                    yield from blocks(first, total)
                    total = total[:0]
        _loaded.clear()
        yield from blocks(first, total)

    def blocks(first: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.append(total, np.zeros(-len(total) % COUNT_BLOCK, dtype=np.int64)).reshape(-1, COUNT_BLOCK)
        some = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(some), 1024):
            numbers = pa.array(some[i : i + 1024] + first, pa.int32())
            packed = pa.array([pack_counts(total[k]) for k in some[i : i + 1024]], pa.binary())
            yield pa.RecordBatch.from_arrays([numbers, packed], names=["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = -1, np.zeros(COUNT_BLOCK, dtype=np.int64)
        for batch in batches:
            held = []
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != last:
                    held.append(frequent(last, total))
                    last, total = number, np.zeros(COUNT_BLOCK, dtype=np.int64)
                add_counts(raw.as_buffer(), total)
            yield from held
        yield frequent(last, total)

    def frequent(number: int, total: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(total >= LEAST_COUNT)
        return pa.RecordBatch.from_pydict({"number": (hit + number * COUNT_BLOCK).astype(np.int32), "f": total[hit]})

    total = texts.mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block")
    return tries.phrases.join(total.mapInArrow(added, "number int, f bigint"), "number").select("lang", "phrase", "f")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of a block: all, or, where that is shorter, places and counts of those that aren't 0."""
    hit = np.flatnonzero(counts)
    if 10 * len(hit) >= counts.nbytes:
        return counts.tobytes()
    return hit.astype(np.uint16).tobytes() + counts[hit].tobytes()


def add_counts(packed: pa.Buffer | bytes, total: np.ndarray) -> None:
    """Adds to ``total`` what :func:`pack_counts` has made."""
    if len(packed) == total.nbytes:
        total += np.frombuffer(packed, dtype=np.int64)
        return
    n = len(packed) // 10
    total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.int64, n, 2 * n)


def joined(pairs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases of pairs: the left one and the last word of the right one."""
    left = phrases.select(F.col("number").alias("left"), "lang", F.col("phrase").alias("l"))
    right = phrases.select(F.col("number").alias("right"), F.substring_index("phrase", " ", -1).alias("r"))
    return pairs.join(left, "left").join(right, "right").select("lang", F.concat_ws(" ", "l", "r").alias("phrase"))


def phrase_tables(documents: DataFrame, longest: int = LONGEST) -> list[DataFrame]:
    """Tables (lang, phrase, f): all words, then phrases of 1, 2, … words that occur ``LEAST_COUNT`` times.

    A null text is empty, a null language is ``NO_LANGUAGE``.
    """
    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    words = word_counts(texts)
    tables = [words, words.where(F.col("f") >= LEAST_COUNT)]
    tries = tries_of(tables[1])
    for n in range(2, longest + 1):
        if tries is not None:
            candidates = written(joined(overlaps(texts, tries), tries.phrases), "candidates")
            tries = tries_of(candidates)
        tables.append(tables[0].limit(0) if tries is None else written(phrase_counts(texts, tries), "phrase-counts"))
    return tables


def _cut_scores(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all candidates, at their lowest cut."""
    counts = [t.select("lang", F.col("phrase"), "f") for t in tables]
    out = None
    for n in range(2, len(tables)):
        split = F.split("phrase", " ")
        rows = counts[n].withColumnRenamed("f", "a")
        scores = []
        for k in range(1, n):
            head = counts[k].select("lang", F.col("phrase").alias("head"), F.col("f").alias(f"l{k}"))
            tail = counts[n - k].select("lang", F.col("phrase").alias("tail"), F.col("f").alias(f"r{k}"))
            rows = (
                rows.withColumn("head", F.array_join(F.slice(split, 1, k), " "))
                .withColumn("tail", F.array_join(F.slice(split, k + 1, n - k), " "))
                .join(head, ["lang", "head"])
                .join(tail, ["lang", "tail"])
                .drop("head", "tail")
            )
            exact = "(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)))"
            part = f"(CAST(l{k} AS DECIMAL(18, 0)) * CAST(r{k} AS DECIMAL(18, 0)))"
            score = F.expr(f"CAST({exact} DIV {part} AS BIGINT)")
            scores.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = F.least(*scores) if len(scores) > 1 else scores[0]
        rows = rows.select("lang", "phrase", F.lit(n).alias("words"), "a", best.alias("best"))
        out = rows if out is None else out.unionAll(rows)
    return out.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def _covered(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase and the greatest count of a longer phrase that holds it."""
    out = None
    for n in range(3, len(tables)):
        split = F.split("phrase", " ")
        parts = F.array_distinct(F.array(*(
            F.array_join(F.slice(split, i, m), " ") for m in range(2, n) for i in range(1, n - m + 2)
        )))
        rows = tables[n].select("lang", F.explode(parts).alias("phrase"), F.col("f").alias("longer"))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(documents: DataFrame, best: int = BEST) -> DataFrame:
    """The phrases of two and three words that hold together best, by language.

    lang, rank, phrase, a, l, r, n, score: a phrase occurs a times, its parts at the cut that separates it most
    easily l and r times, and the score is floor(1000000 a a / (l r)), exact. Phrases that are
    mostly part of one longer phrase are left out. Texts are lower-cased in A to Z and never joined across
    punctuation or lines. Null texts are empty, null languages are ``und``; repeated rows count each; ids and
    further columns are not read; an empty table gives no rows.
    """
    tables = phrase_tables(documents)
    n = tables[0].groupBy("lang").agg(F.sum("f").alias("n"))
    rows = _cut_scores(tables).join(_covered(tables), ["lang", "phrase"], "left")
    kept = rows.where(F.col("longer").isNull() | (100 * F.col("longer") < SUBSUMED_PERCENT * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.drop("longer", "words").withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= best).join(n, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
