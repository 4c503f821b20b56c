"""Removal of passages that an earlier document has, by phrase automata.

Words covered by 50 consecutive words that are also in a document of smaller id are
removed. :mod:`recurring` brings the places together where a passage may recur, by the hash of
its anchor. Windows of which a later document holds another are confirmed by hash. All windows of a
context hold its anchor, so what they cover is one run, and the first and last of them bound it: the
distinct confirmed ones that are first or last in some context, each with the smallest document it comes from, are
compiled into Aho-Corasick automata of bounded size over words as letters, and every context
is streamed through them, which locates all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm import recurring as R
from apportion.llm import words as W

WINDOW = 50
GRAM = 12
SHARD = 1 << 14  # windows; their words are fewer than the characters there are
_AT_ONCE = 1 << 19


def compare(run: list[R.Member], what: R.Recurrence) -> list[tuple[int, int] | None]:
    """The reach of each member that documents of smaller order cover, around its anchor.

    Windows are confirmed by their hashes: those of which a later document holds another. The automata
    of the confirmed that bound a member's reach, ``SHARD`` windows each, then go over all members. Where
    they locate less than the hashes promise, two windows had one hash, and all confirmed ones are compiled.
    """
    none: list[tuple[int, int] | None] = [None] * len(run)
    each, place, hashes = _windows([member.segment for member in run], what)
    if not len(each):
        return none
    orders = np.array([member.order for member in run])[each]
    rank = np.lexsort((orders, hashes))
    begins = np.concatenate([[True], np.diff(hashes[rank]) != 0])
    begin = np.flatnonzero(begins)
    smallest = rank[begin][np.cumsum(begins) - 1]  # for each window the equal one of smallest order
    earliest = np.empty_like(rank)
    earliest[rank] = smallest
    late = np.flatnonzero(orders[earliest] < orders)  # by member, then by place
    if not len(late):
        return none
    first = late[np.concatenate([[True], np.diff(each[late]) != 0])]
    last = late[np.concatenate([np.diff(each[late]) != 0, [True]])]
    found = _located(run, what, each, place, np.unique(earliest[np.concatenate([first, last])]))
    bounds = zip(each[first].tolist(), place[first].tolist(), place[last].tolist(), strict=True)
    if any(found.get(number) != (low, high) for number, low, high in bounds):
        found = _located(run, what, each, place, np.unique(earliest[late]))
    for number, (low, high) in found.items():
        left = run[number].left
        none[number] = (low - left, high - left + what.window)
    return none


def _windows(segments: list[bytes], what: R.Recurrence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all segments: numbers of their segments, places in them, hashes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(segments):
        last, size = first, 0
        while last < len(segments) and (last == first or size + len(segments[last]) < _AT_ONCE):
            size += len(segments[last]) + 1
            last += 1
        values = what.units.values(b" ".join(segments[first:last]))
        counts = np.array([segment.count(b" ") + 1 if segment else 0 for segment in segments[first:last]])
        starts = np.cumsum(counts) - counts
        many = np.maximum(counts - what.window + 1, 0)
        each = np.repeat(np.arange(last - first), many)
        place = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        hashes = W.run_hashes(what.units.wide(values), what.window, what.units.powers)
        held.append((each + first, place, hashes[starts[each] + place]))
        first = last
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each, place, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
    return each, place, hashes


def _located(
    run: list[R.Member], what: R.Recurrence, each: np.ndarray, place: np.ndarray, chosen: np.ndarray
) -> dict[int, tuple[int, int]]:
    """The first and the last place in each member of the chosen windows of documents of smaller order."""
    found: dict[int, tuple[int, int]] = {}
    for i in range(0, len(chosen), SHARD):
        letters = _Letters()
        automaton = ahocorasick.Automaton()
        for number, start in zip(each[chosen[i : i + SHARD]].tolist(), place[chosen[i : i + SHARD]].tolist(), strict=True):
            words = run[number].segment.split(b" ")[start : start + what.window]
            automaton.add_word("".join(map(letters.__getitem__, words)), run[number].order)
        automaton.make_automaton()
        known = letters.get
        for number, member in enumerate(run):
            line = "".join([known(word, _OTHER) for word in member.segment.split(b" ")])
            for stop, smallest in automaton.iter(line):
                if smallest < member.order:
                    start = stop - what.window + 1
                    low, high = found.get(number, (start, start))
                    found[number] = min(low, start), max(high, start)
    return found


_OTHER = " "  # any word that no window of an automaton has


class _Letters(dict):
    """One character for each different word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> str:
        code = 0x21 + len(self)
        letter = self[word] = chr(code if code < 0xD800 else code + 0x800)
        return letter


WORDS = R.Recurrence(R.WordUnits(), WINDOW, GRAM, True, compare)


def remove_passages(docs: DataFrame, what: R.Recurrence = WORDS, digest: bool = False) -> DataFrame:
    """Each document without the words of passages that a document of smaller id has.

    ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the other words joined by one space, or its
    SHA-256 as ``kept_sha256`` if ``digest``. Null ids come after all others and are not
    before one another; rows of the same id aren't either. A null text has no words. Of an
    empty table comes an empty result; other columns are not read.
    """
    rows = R.keyed(docs)
    last = "kept_sha256" if digest else "kept"
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (last, pa.string())]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()  # at the same white space as words.word_bounds
                n = len(words)
                for s, e in reversed(R.runs(found, n)):
                    del words[s:e]
                kept = b" ".join(words)
                said = hashlib.sha256(kept).hexdigest() if digest else kept.decode()
                out.append((doc_id, n, n - len(words), said))
            yield R._rows(out, arrow)

    joined = rows.join(R.spans(rows, what), ["ord", "h"], "left")
    return joined.select(F.col("doc_id").cast("bigint"), "text", "spans").mapInArrow(
        apply, f"doc_id bigint, n_words bigint, n_removed bigint, {last} string"
    )
