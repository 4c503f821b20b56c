"""Windows of fixed length that recur, found without comparing all of them.

A text is a sequence of units, words or bytes. Of all runs of ``gram`` units those
are anchors whose hash is smallest within some window; every window holds one, and
equal windows hold it at the same place. So only occurrences of one anchor need to
meet. The context of an occurrence is all that windows around it can cover.

1. Anchors are counted by hash; those that occur once are done with.
2. Where all contexts of an anchor are equal, all of its windows recur.
3. Of the others, each different context is sent once, as text, to its anchor's
   group, where the windows are compared exactly. In a group of over ``GROUP`` contexts
   the windows themselves are rows, counted by hash, so no task holds the group.

Counts, smallest ids and distinct contexts are aggregated before they are shuffled,
so copies of one text meet as a single context.

In a run that repeats itself at a short distance ("the the the ...") every period would be an anchor, and its contexts
would differ by all that stands beside such runs anywhere. Runs of bytes are anchored only for windows that lie
within them, and their contexts end where the run ends: those of one anchor differ by two lengths at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm import words as W
from apportion.session import discard, shuffles_dropped, written

GROUP = 65_536  # contexts of one anchor that a task compares, some 50 MB of text
RUN = 8192
_DEALS = 16
_CHUNK = 1 << 20
_SCAN = 1 << 18
_LAST = (1 << 63) - 1


class ByteUnits:
    """Bytes as units."""

    powers = W._bytes

    def values(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=np.uint8)

    def wide(self, values: np.ndarray) -> np.ndarray:
        return values.astype(np.uint64) + np.uint64(1)

    def cutter(self, raw: bytes) -> Callable[[int, int], bytes]:
        return lambda i, j: raw[i:j]

    def repeating(self, texts: pa.Array, gram: int) -> list[list[tuple[int, int]]]:
        """For each text the stretches of places at which grams of a short period begin."""
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        ends = np.frombuffer(texts.buffers()[1] or bytes(4), dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        first, last = int(ends[0]), int(ends[-1])
        for s, e in short_periods(data[first:last], gram):
            s, e = s + first, e + first
            i = int(np.searchsorted(ends, s, "right")) - 1
            while i < len(out) and ends[i] < e:
                begin, stop = max(s, int(ends[i])), min(e, int(ends[i + 1]) - gram + 1)  # within the text
                if begin < stop:
                    out[i].append((begin - int(ends[i]), stop - int(ends[i])))
                i += 1
        return out


class WordUnits:
    """Words between white space as units."""

    powers = W._words

    def values(self, raw: bytes) -> np.ndarray:
        return W.word_hashes(raw)

    def wide(self, values: np.ndarray) -> np.ndarray:
        return values

    def cutter(self, raw: bytes) -> Callable[[int, int], bytes]:
        words = raw.split()  # at the same white space as words.word_bounds
        return lambda i, j: b" ".join(words[i:j])

    def repeating(self, texts: pa.Array, gram: int) -> list[list[tuple[int, int]]]:
        return [[]] * len(texts)


def short_periods(data: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Maximal stretches of places at which ``gram`` bytes begin that repeat themselves at a distance of up to half of them.

    Of grams that begin in one stretch neighbours have all but one byte in common, and so the same period.
    """
    found: list[tuple[int, int]] = []
    for base in range(0, len(data), _SCAN):
        part = data[base : base + _SCAN + gram]
        for t in range(1, min(gram // 2, gram - 24) + 1):  # what is equal then fills two words of eight
            n = len(part) - t
            if len(part) < gram:
                break
            words = n // 8 * 8
            equal = part[:words].copy().view(np.uint64) == part[t : t + words].copy().view(np.uint64)
            at = np.flatnonzero(equal[1:] & equal[:-1])
            if not len(at):
                continue
            heads = at[np.append(True, np.diff(at) > 1)]
            tails = at[np.append(np.diff(at) > 1, True)]
            for s, e in zip((8 * heads).tolist(), (8 * tails + 16).tolist(), strict=True):
                while s and part[s - 1] == part[s - 1 + t]:
                    s -= 1
                while e < n and part[e] == part[e + t]:
                    e += 1
                if e - s >= gram - t:
                    found.append((base + s, base + e - gram + t + 1))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


class Member(NamedTuple):
    """A context: its anchor, its text, how many units stand before the anchor, the smallest order that has it."""

    anchor: int
    segment: bytes
    left: int
    order: int


@dataclass(frozen=True)
class Recurrence:
    """What counts as recurring: windows of ``window`` units found by anchors of ``gram``.

    ``earlier``: a window is taken if it also is in a document of smaller order;
    else if it is anywhere else, in the same document too. ``compare`` maps a
    run of whole groups to the covered reach of each member.

    ``passage``: shorter windows looked for in the same pass, 0 for none. Anchors then stand
    so close that each of them holds one, and ``compare`` gives two reaches for each member.
    """

    units: ByteUnits | WordUnits
    window: int
    gram: int
    earlier: bool
    compare: Callable[[list[Member], "Recurrence"], list]
    passage: int = 0

    @property
    def reach(self) -> int:
        """How many units before the anchor a window may begin."""
        return self.window - self.gram

    @property
    def shorter(self) -> "Recurrence":
        """The shortest windows by themselves."""
        return replace(self, window=self.passage, passage=0) if self.passage else self


def text_key(text: Column) -> Column:
    """Tells texts with the same id apart: 128 bits, as any number of texts may have one id or none."""
    return F.unhex(F.md5(text))


def keyed(docs: DataFrame) -> DataFrame:
    """``ord``, ``h`` and ``text``: the order of the id, nulls last, and a digest of the text.

    Neither key can be null, so that inner and outer joins ask for the same shuffle, which is then made once.
    """
    text = F.coalesce("text", F.lit(""))
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    key = F.coalesce(text_key(F.col("text")), F.lit(b""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", order.alias("ord"), key.alias("h"), "text")


def occurrences(rows: DataFrame, what: Recurrence) -> DataFrame:
    """Every anchor of every text: a, ctx (hashes of anchor and context), ord, h, pos, left, right (the context's reach)."""
    arrow = pa.schema(
        [("a", pa.int64()), ("ctx", pa.int64()), ("ord", pa.int64()), ("h", pa.binary()), ("pos", pa.int64())]
        + [("left", pa.int32()), ("right", pa.int32())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            keys = batch.column(1)
            repeating = what.units.repeating(batch.column(2), what.gram)
            for row, (order, text) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(2), strict=True)
            ):
                for found in _anchored(text.as_py().encode(), what, repeating[row]):
                    n = len(found[0])
                    held.append((*found, np.full(n, order), np.full(n, row)))
                    size += n
                if size > 200_000:
                    yield _table(held, keys, arrow)
                    held, size = [], 0
            yield _table(held, keys, arrow)

    return rows.select("ord", "h", "text").mapInArrow(
        scan, "a bigint, ctx bigint, ord bigint, h binary, pos bigint, left int, right int"
    )


def _table(held: list[tuple], keys: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    a, ctx, pos, left, right, order, row = (
        [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 7
    )
    columns = [a.view(np.int64), ctx.view(np.int64), order, keys.take(pa.array(row, pa.int64())), pos, left, right]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def _anchored(raw: bytes, what: Recurrence, repeating: Sequence[tuple[int, int]] = ()) -> Iterator[tuple[np.ndarray, ...]]:
    """Hashes of anchors and contexts, the anchors' places and their contexts' reach, in bounded runs of a text.

    Places at which a repeating gram begins are anchors only where a window has no other. The contexts
    of such an anchor hold windows without other grams; those of the rest end with the text only.
    """
    values = what.units.values(raw)
    n = len(values)
    if n < what.shorter.window:
        return
    begins, ends = np.array(repeating, dtype=np.int64).reshape(-1, 2).T
    for base in range(0, n, _CHUNK):
        lo, hi = max(0, base - what.window), min(n, base + _CHUNK + what.window)
        sums = W.prefix_sums(what.units.wide(values[lo:hi]), what.units.powers)
        down = what.units.powers.down
        grams = W.mixed((sums[what.gram :] - sums[: -what.gram]) * down[: hi - lo - what.gram + 1])
        at = W.anchors(_ranked(grams, begins - lo, ends - lo), what.shorter.reach + 1)
        at = at[(at + lo >= base) & (at + lo < base + _CHUNK)]
        left, right = np.full(len(at), what.reach), np.full(len(at), what.window)
        if len(begins):
            run = np.searchsorted(begins - lo, at, "right") - 1
            inside = np.flatnonzero((run >= 0) & (at < ends[run] - lo))
            before, after = at[inside] + lo - begins[run[inside]], ends[run[inside]] - lo + what.gram - 1 - at[inside]
            long = np.minimum(before, what.reach) + np.minimum(after, what.window) >= what.window
            left[inside] = np.minimum(before, np.where(long, what.reach, what.shorter.reach))
            right[inside] = np.minimum(after, np.where(long, what.window, what.shorter.window))
        start, stop = np.maximum(at - left, 0), np.minimum(at + right, hi - lo)
        context = W.mixed((sums[stop] - sums[start]) * down[start], 5)
        shape = (at - start).astype(np.uint64) << np.uint64(32) | (stop - at).astype(np.uint64)
        yield grams[at], W.mixed(context ^ W.mixed(shape)), at + lo, left, right


def _ranked(grams: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By which of the grams anchors are chosen: the repeating ones come last."""
    if not len(begins):
        return grams
    ranked = grams >> np.uint64(1)
    for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e > 0:
            ranked[max(0, s) : e] |= np.uint64(1 << 63)
    return ranked


def spans(rows: DataFrame, what: Recurrence) -> DataFrame:
    """Covered spans of each text that has any: ord, h, spans (s, e), unsorted, may overlap.

    Ends may lie outside the text; they are cut where the spans are applied. With ``passage`` a span
    has ``fine``, true if only shorter windows cover it; of texts under ``window`` units that goes for all.
    """
    spark = rows.sparkSession
    seen = written(occurrences(rows, what), "anchors")
    counted = seen.groupBy("a").agg(
        F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"),
        F.min("ctx").alias("c1"), F.max("ctx").alias("c2"),
    )
    recurs = F.col("lo") < F.col("hi") if what.earlier else F.col("n") > 1
    anchors = counted.where(recurs).select("a", "lo", (F.col("c1") == F.col("c2")).alias("alike"))
    with shuffles_dropped(spark):
        hits = written(seen.join(anchors, "a"), "occurrences")
    discard(seen)
    alike = hits.where("alike and ord > lo" if what.earlier else "alike")

    differing = hits.where(~F.col("alike")).drop("lo", "alike")
    least = F.min(F.struct("ord", "h", "pos", "left", "right"))
    with shuffles_dropped(spark):
        contexts = written(
            differing.groupBy("a", "ctx").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), least.alias("at")),
            "contexts",
        )
    again = F.col("ord") > F.col("lo") if what.earlier else F.col("n") > 1
    fine = ["fine"] if what.passage else []
    whole = [(F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e")]
    whole += [(F.col("left") + F.col("right") < what.window).alias(name) for name in fine]
    # One join, so that the occurrences are shuffled once: where a context recurs as a whole, what was compared is unread.
    met = differing.join(contexts.select("a", "ctx", "n", "lo"), ["a", "ctx"]).withColumn("again", again)
    reached = _compared(rows, contexts, what).select("a", "ctx", F.struct("s", "e", *fine).alias("part"))
    met = met.join(reached, ["a", "ctx"], "left").where("again or part is not null")
    partly = [F.col("pos") + F.col("part.s"), F.col("pos") + F.col("part.e")] + [F.col("part.fine") for _ in fine]
    found = alike.select("ord", "h", *whole).unionAll(
        met.select("ord", "h", *[
            F.when(F.col("again"), one).otherwise(other).alias(name)
            for one, other, name in zip(whole, partly, ["s", "e", *fine], strict=True)
        ])
    )
    # Rows without an id share one order: copies of a text have the same spans, which count once.
    return found.groupBy("ord", "h").agg(F.collect_set(F.struct("s", "e", *fine)).alias("spans"))


def _segments(rows: DataFrame, contexts: DataFrame, what: Recurrence) -> DataFrame:
    """The text of each different context: a, ctx, ord, left (units before the anchor), segment."""
    wanted = contexts.select("at.ord", "at.h", F.struct("a", "ctx", "at.pos", "at.left", "at.right").alias("one")).groupBy("ord", "h").agg(
        F.collect_list("one").alias("wanted")
    )
    arrow = pa.schema(
        [("a", pa.int64()), ("ctx", pa.int64()), ("ord", pa.int64()), ("left", pa.int32()), ("segment", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for order, text, marks in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True
            ):
                take = what.units.cutter(text.as_py().encode())
                for a, ctx, pos, left, right in zip(*(c.to_pylist() for c in marks.values.flatten()), strict=True):
                    left = min(left, pos)
                    out.append((a, ctx, order, left, take(pos - left, pos + right)))
                if len(out) > 20_000:
                    yield _rows(out, arrow)
                    out = []
            yield _rows(out, arrow)

    # Texts of the same id and digest are one; repeated rows then give equal segments. All columns of the
    # rows are taken, as the join that applies the spans does, so that texts are shuffled once for both.
    return (
        rows.join(wanted, ["ord", "h"])
        .select("ord", "text", "wanted", "doc_id")
        .mapInArrow(cut, "a bigint, ctx bigint, ord bigint, left int, segment binary")
    )


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _compared(rows: DataFrame, contexts: DataFrame, what: Recurrence) -> DataFrame:
    """What of each context recurs in another of its anchor: a, ctx, s, e around the anchor, ``fine`` with ``passage``."""
    large = contexts.groupBy("a").count().where(F.col("count") > GROUP).select("a")
    large = written(large, "large-groups")
    grouped = _in_groups(_segments(rows, contexts.join(large, "a", "left_anti"), what), what)
    if large.isEmpty():
        return grouped
    segments = _segments(rows, contexts.join(large, "a", "left_semi"), what)
    if not what.passage:
        return grouped.unionAll(_by_window(segments, what))
    segments = written(segments, "segments")
    for fine, one in ((False, replace(what, passage=0)), (True, what.shorter)):
        grouped = grouped.unionAll(_by_window(segments, one).withColumn("fine", F.lit(fine)))
    return grouped


def _by_window(segments: DataFrame, what: Recurrence) -> DataFrame:
    """For groups too large for a task: windows are rows, counted by hash wherever they are."""
    arrow = pa.schema(
        [("a", pa.int64()), ("ctx", pa.int64()), ("ord", pa.int64()), ("o", pa.int32()), ("w", pa.int64())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                cuts = [
                    window_hashes(segment, left, what)
                    for left, segment in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
                ]
                each = pa.array(np.repeat(np.arange(len(cuts)), [len(o) for o, _ in cuts]))
                columns = [batch.column(i).take(each) for i in range(3)]
                columns += [np.concatenate([o for o, _ in cuts]), np.concatenate([w for _, w in cuts]).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    windows = written(segments.mapInArrow(cut, "a bigint, ctx bigint, ord bigint, o int, w bigint"), "windows")
    counted = windows.groupBy("a", "o", "w").agg(
        F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")
    )
    counted = counted.where(F.col("lo") < F.col("hi") if what.earlier else F.col("n") > 1)
    # A window may be in a third of all contexts: these are dealt over some tasks.
    dealt = counted.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALS - 1))))
    met = windows.withColumn("deal", F.pmod("ctx", F.lit(_DEALS)).cast("int")).join(dealt, ["a", "o", "w", "deal"])
    if what.earlier:
        met = met.where(F.col("ord") > F.col("lo"))
    return (
        met.groupBy("a", "ctx")
        .agg(F.max("o").alias("far"), F.min("o").alias("near"))
        .select(
            "a", "ctx", (-F.col("far")).cast("bigint").alias("s"), (what.window - F.col("near")).cast("bigint").alias("e")
        )
    )


def window_hashes(segment: bytes, left: int, what: Recurrence) -> tuple[np.ndarray, np.ndarray]:
    """How far before the anchor each window of a context that holds it begins, and its hash."""
    hashes = W.run_hashes(what.units.wide(what.units.values(segment)), what.window, what.units.powers)
    before = left - np.arange(len(hashes))
    holds = (before >= 0) & (before <= what.reach)  # not all do where a context is cut for longer windows
    return before[holds].astype(np.int32), hashes[holds]


def _in_groups(members: DataFrame, what: Recurrence) -> DataFrame:
    """Compares the windows within each group; whole groups arrive one after another, in runs."""
    arrow = pa.schema(
        [("a", pa.int64()), ("ctx", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]
        + ([("fine", pa.bool_())] if what.passage else [])
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(run) >= RUN and run[-1][0] != row[0]:
                    yield _covered(run, what, arrow)
                    run = []
                run.append(row)
        yield _covered(run, what, arrow)

    return (
        members.repartition("a")
        .sortWithinPartitions("a")
        .mapInArrow(compare, "a bigint, ctx bigint, s bigint, e bigint" + (", fine boolean" if what.passage else ""))
    )


def _covered(run: list[tuple], what: Recurrence, schema: pa.Schema) -> pa.RecordBatch:
    found = what.compare([Member(a, segment, left, order) for a, _, order, left, segment in run], what)
    if not what.passage:
        out = [(row[0], row[1], *reach) for row, reach in zip(run, found, strict=True) if reach is not None]
        return _rows(out, schema)
    out = []
    for row, (coarse, fine) in zip(run, found, strict=True):
        if coarse is not None:
            out.append((row[0], row[1], *coarse, False))
        if fine is not None and (coarse is None or fine[0] < coarse[0] or fine[1] > coarse[1]):
            out.append((row[0], row[1], *fine, True))
    return _rows(out, schema)


def runs(found: pa.ListScalar, n: int) -> list[tuple[int, int]]:
    """The maximal runs of ``n`` units that spans cover, in order."""
    if not found.is_valid:
        return []
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(*(c.to_pylist() for c in found.values.flatten()), strict=True)):
        s, e = max(0, s), min(n, e)
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def mask(found: list[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` units are covered by spans."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for one in found or ():
        edges[max(0, one["s"])] += 1
        edges[min(n, one["e"])] -= 1
    return np.cumsum(edges[:n]) > 0
