"""Exact duplicate removal with a logarithmic family of suffix arrays.

Bytes covered by a string of 400 bytes that also starts anywhere else are removed.
Passages of some fifty words are mostly shorter; they can be looked for in the same pass.
:mod:`recurring` brings the candidate places together, each context once. Equal
strings hold their anchor at the same place, so two contexts have one in common if
what they share to the left of the anchor and from it on is long enough together.

The contexts of a run of anchors arrive in batches. A batch gets two sparse suffix arrays, of
what follows its anchors and of what stands before them read backwards, with the common prefixes
of neighbours. Equal-sized levels of the family merge geometrically, and a merge-scan of each new array
finds the windows its members share: those in the same class of both orders. The work is
windows times logarithm of batches; nothing is compared in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm import recurring as R

LENGTH = 400
GRAM = 64
BATCH = 8192
_AT_ONCE = 4096
_BYTES_AT_ONCE = 1 << 23
_FAR = 1 << 30


@dataclass(frozen=True)
class Sorted:
    """Members by the text on one side of their anchors, and what neighbours have in common."""

    order: np.ndarray
    common: np.ndarray


class Family:
    """Suffix arrays of a run of contexts: level i holds 2^i batches, or nothing.

    A level has two sparse arrays, of what follows the anchors and of what stands before them
    read backwards. For windows of ``length`` and, if any, those of ``passage``, ``low`` and ``high`` are how
    far before its anchor the last and the first window begin that a member has in common with another. Windows
    of a passage's length hold the anchor, of ``gram`` bytes; longer ones do as members are cut for them.
    """

    def __init__(self, length: int, passage: int = 0, gram: int = 0):
        self.lengths = [(length, _FAR)] + ([(passage, passage - gram)] if passage else [])
        self.sides: tuple[list[bytes], list[bytes]] = ([], [])
        self.low = [np.zeros(0, dtype=np.int32) for _ in self.lengths]
        self.high = [np.zeros(0, dtype=np.int32) for _ in self.lengths]
        self.levels: list[tuple[Sorted, Sorted] | None] = []

    def add(self, members: list[R.Member]) -> None:
        """A batch: gets its arrays, is scanned, and joins the levels."""
        first = len(self.sides[0])
        for _, segment, left, _ in members:
            self.sides[0].append(segment[left:])
            self.sides[1].append(segment[:left][::-1])
        self.low = [np.append(low, np.full(len(members), _FAR, dtype=np.int32)) for low in self.low]
        self.high = [np.append(high, np.full(len(members), -1, dtype=np.int32)) for high in self.high]
        numbers = list(range(first, len(self.sides[0])))
        array = self._array(numbers, numbers)
        level = 0
        while level < len(self.levels) and self.levels[level]:
            array = self._merged(self.levels[level], array)
            self.levels[level] = None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = array

    def close(self) -> None:
        """Merges the levels that are left, small ones first."""
        held = [level for level in self.levels if level]
        while len(held) > 1:
            held[:2] = [self._merged(held[1], held[0])]
        self.levels = list(held)

    def _merged(self, one: tuple[Sorted, Sorted], other: tuple[Sorted, Sorted]) -> tuple[Sorted, Sorted]:
        """The sort finds two sorted runs and merges them."""
        return self._array(*(a.order.tolist() + b.order.tolist() for a, b in zip(one, other, strict=True)))

    def _array(self, after: list[int], before: list[int]) -> tuple[Sorted, Sorted]:
        array = tuple(
            self._sorted(numbers, texts) for numbers, texts in zip((after, before), self.sides, strict=True)
        )
        self._scan(*array)
        return array

    def _sorted(self, numbers: list[int], texts: list[bytes]) -> Sorted:
        numbers = sorted(numbers, key=texts.__getitem__)
        common = [
            neighbours([texts[n] for n in numbers[i : i + _AT_ONCE + 1]]) for i in range(0, len(numbers), _AT_ONCE)
        ]
        return Sorted(np.array(numbers, dtype=np.int64), np.concatenate(common or [np.zeros(0, np.int32)]))

    def _scan(self, after: Sorted, before: Sorted) -> None:
        """Finds the windows that two members of an array have in common.

        A window that begins o bytes before the anchor is in two members if their o bytes before it
        are equal and so are length - o from it on. In sorted order equal ones are
        neighbours: both arrays fall into classes, and members of the same two classes meet.
        """
        # No member has more in common with any other than with a neighbour.
        right, left = (_nearest(side, len(self.sides[0])) for side in (after, before))
        for (length, farthest), low, high in zip(self.lengths, self.low, self.high, strict=True):
            self._scan_for(length, after, before, right, np.minimum(left, farthest), low, high)

    def _scan_for(
        self, length: int, after: Sorted, before: Sorted, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> None:
        n = len(after.order)
        meets = after.order[left[after.order] + right[after.order] >= length]
        if not len(meets):
            return
        first, last = length - right[meets], left[meets]
        classes = np.empty(len(low), dtype=np.int64)
        others = np.empty(len(low), dtype=np.int64)
        for o in range(max(0, int(first.min())), int(last.max()) + 1):
            some = meets[(first <= o) & (o <= last)]
            if len(some) < 2:
                continue
            classes[before.order] = np.concatenate([[0], np.cumsum(before.common < o)])
            others[after.order] = np.concatenate([[0], np.cumsum(after.common < length - o)])
            pairs = classes[some] * n + others[some]
            rank = np.argsort(pairs, kind="stable")
            same = np.diff(pairs[rank]) == 0
            twice = np.zeros(len(some), dtype=bool)
            twice[rank[1:]] |= same
            twice[rank[:-1]] |= same
            found = some[twice]
            low[found] = np.minimum(low[found], o)
            high[found] = np.maximum(high[found], o)

    def reach(self, which: int = 0) -> list[tuple[int, int] | None]:
        """What of each member is covered by windows of the first length or the second, around its anchor."""
        length = self.lengths[which][0]
        return [
            (-high, length - low) if high >= 0 else None
            for low, high in zip(self.low[which].tolist(), self.high[which].tolist(), strict=True)
        ]


def neighbours(texts: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each text and the next."""
    if len(texts) < 2:
        return np.zeros(0, dtype=np.int32)
    lengths = np.array([len(t) for t in texts])
    width = int(lengths.max()) + 1
    letters = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(-1, width)
    unlike = letters[1:] != letters[:-1]
    unlike[:, -1] = True
    return np.minimum(unlike.argmax(axis=1), np.minimum(lengths[1:], lengths[:-1])).astype(np.int32)


def _nearest(side: Sorted, members: int) -> np.ndarray:
    """The most that each member has in common with another of the array."""
    out = np.zeros(members, dtype=np.int32)
    edges = np.concatenate([[0], side.common, [0]])
    out[side.order] = np.maximum(edges[1:], edges[:-1])
    return out


def compare(run: list[R.Member], what: R.Recurrence) -> list:
    """The covered reach of each member, around its anchor; with ``passage`` also that by shorter windows.

    Texts after an anchor begin with it, so contexts of different anchors share less than a window.
    """
    family = Family(what.window, what.passage, what.gram)
    for i in range(0, len(run), BATCH):
        family.add(run[i : i + BATCH])
    family.close()
    return list(zip(family.reach(), family.reach(1), strict=True)) if what.passage else family.reach()


BYTES = R.Recurrence(R.ByteUnits(), LENGTH, GRAM, False, compare)
# Passages of some fifty words, which seldom have fewer than 4.8 bytes each with the space.
PASSAGES = R.Recurrence(R.ByteUnits(), 240, 48, False, compare)
BOTH = R.Recurrence(R.ByteUnits(), LENGTH, GRAM, False, compare, PASSAGES.window)


def remove_repeats(docs: DataFrame, what: R.Recurrence = BYTES, digest: bool = False) -> DataFrame:
    """Each document without the bytes that recurring strings cover.

    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, what
    is left as bytes; with ``digest`` its SHA-256 as ``kept_sha256``, and ``kept`` as a text without the
    characters of which a removed run took a part. With ``passage`` a last column ``text`` has what is left
    without strings of that shorter length that recur; the others go by the full length. Null texts are empty.
    Repeated rows are each other's repeats. Very long texts are taken whole. Texts shorter than the length
    stay. Of an empty table comes an empty result; other columns are not read.
    """
    rows = R.keyed(docs)
    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
    fields += "kept_sha256 string, kept string" if digest else "kept binary"
    fields += ", text string" if what.passage else ""
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
        + ([("kept_sha256", pa.string()), ("kept", pa.string())] if digest else [("kept", pa.binary())])
        + ([("text", pa.string())] if what.passage else [])
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, spans = text.as_py().encode(), found.as_py()
                long = spans
                if what.passage:
                    long = [one for one in spans or () if not one["fine"]] if len(raw) >= what.window else None
                covered, runs, kept = _without(raw, long)
                last = (hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")) if digest else (kept,)
                if what.passage:
                    last += (_without(raw, spans)[2].decode(errors="ignore"),)
                out.append((doc_id, len(raw), covered, runs, *last))
                size += len(raw)
                if size > _BYTES_AT_ONCE:
                    yield R._rows(out, arrow)
                    out, size = [], 0
            yield R._rows(out, arrow)

    joined = rows.join(R.spans(rows, what), ["ord", "h"], "left")
    return joined.select(F.col("doc_id").cast("bigint"), "text", "spans").mapInArrow(apply, fields)


def _without(raw: bytes, found: list[dict] | None) -> tuple[int, int, bytes]:
    if not found:
        return 0, 0, raw
    covered = R.mask(found, len(raw))
    runs = int(covered[0]) + int(np.count_nonzero(covered[1:] & ~covered[:-1]))
    kept = np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes()
    return int(covered.sum()), runs, kept


def cut_texts(docs: DataFrame, what: R.Recurrence = BYTES) -> DataFrame:
    """The documents with shortened texts and all their columns; ``n_chars`` follows if there is one.

    A character of which a removed run took a part goes too. A null text stays null.
    """
    names = docs.columns
    table = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_{names.index(n)}") for n in ("doc_id", "text"))
    keys = R.keyed(table.select(doc_id.alias("doc_id"), text.alias("text")))
    found = R.spans(keys, what)
    order = F.coalesce(doc_id.cast("bigint"), F.lit(R._LAST))
    marked = table.select(
        "*", order.alias("ord"), R.text_key(F.coalesce(text, F.lit(""))).alias("h")
    ).join(found, ["ord", "h"], "left")

    @F.pandas_udf("string")
    def shortened(texts, spans):
        import pandas as pd

        return pd.Series(
            [
                x if x is None or s is None else _without(x.encode(), list(s))[2].decode(errors="ignore")
                for x, s in zip(texts, spans, strict=True)
            ],
            dtype=object,
        )

    new = F.when(F.col("spans").isNull(), text).otherwise(shortened(text, F.col("spans")))
    columns = []
    for i, name in enumerate(names):
        column = F.col(f"_{i}")
        if name == "text":
            column = new
        elif name == "n_chars":
            column = F.when(F.col("spans").isNull(), column).otherwise(
                F.length(new).cast(table.schema[i].dataType)
            )
        columns.append(column.alias(name))
    return marked.select(*columns)
