"""Quality by an interpolated modified Kneser-Ney model of characters.

Trusted documents are counted in n-grams of real characters. Counts, context totals
and probabilities stay tables that are dealt by n-gram, joined order by order; none
is collected, and none has a bound that the corpus couldn't pass.

Documents are taken in blocks of neighbouring rows of a file. Each block names every
different n-gram that it holds once, and gets back the log probability of each in a
file of its own in the shared folder, so texts never move to be scored: a task reads
its rows again and the answers of their blocks. The ids of a block's trusted
documents come to it in the same way.

A document's perplexity is compared with a limit of its language: a high quantile
of the perplexities of trusted documents that the model was not trained on, a fifth
of them, times a margin. A short text says little, so a document counts as if it
went on for some more characters of its language's average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apportion.llm.held import held as remembered
from apportion.llm.warc import opened
from apportion.session import scratch_dir, written

ORDER = 5
QUANTILE = 0.99
MARGIN = 1.1
STEADY_CHARS = 50
FOLDS = 5
BLOCK_ROWS = 8192
# A character that Unicode keeps out of texts stands before every text.
BEFORE = 0x10FFFF
_POINTS = 0x110000
_AT_ONCE = 1 << 20
_MOST_HELD = 1 << 20
_MOST_SYMBOLS = 5400  # to the fifth power, and one bit more, within 63 bits


def runs(texts: Iterator[tuple[str, bool]], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of texts in runs of bounded size, and which of them end an n-gram, and their text's flag.

    Each text, and each further part of a long one, has the ``order`` - 1 points before it in front.
    """
    held: list[tuple[np.ndarray, bool]] = []
    size = 0
    for text, flag in texts:
        before = np.full(order - 1, BEFORE, dtype=np.uint32)
        for i in range(0, len(text), _AT_ONCE):
            points = np.frombuffer(text[i : i + _AT_ONCE].encode("utf-32-le"), dtype="<u4")
            part = np.concatenate([before, points])
            before = part[len(part) - order + 1 :]
            held.append((part, flag))
            size += len(part)
            if size >= _AT_ONCE:
                yield _joined(held, order)
                held, size = [], 0
    if held:
        yield _joined(held, order)


def _joined(parts: list[tuple[np.ndarray, bool]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p, _ in parts])
    ends = np.ones(lengths.sum(), dtype=bool)
    first = np.cumsum(lengths) - lengths
    for k in range(order - 1):
        ends[first + k] = False
    return np.concatenate([p for p, _ in parts]), ends, np.repeat([f for _, f in parts], lengths)


class _Counter:
    """Counts of n-grams as numbers in a growing alphabet; handed over as strings when it is full."""

    def __init__(self, emit: Callable[[pa.Array, np.ndarray], None], order: int):
        self.emit, self.order = emit, order
        self.rank = np.full(_POINTS, -1, dtype=np.int64)
        self._reset()

    def _reset(self) -> None:
        self.symbols = np.zeros(0, dtype=np.uint32)
        self.codes = self.counts = np.zeros(0, dtype=np.int64)

    def add(self, points: np.ndarray, ends: np.ndarray, counted: np.ndarray) -> None:
        fresh = np.unique(points[self.rank[points] < 0])
        if len(self.symbols) + len(fresh) > _MOST_SYMBOLS:
            self.flush()
            if len(points) > _MOST_SYMBOLS:
                # Halves overlap by what stands before the second one's first n-gram.
                half, over = len(points) // 2, self.order - 1
                self.add(points[:half], ends[:half], counted[:half])
                later = ends[half - over :].copy()
                later[:over] = False
                self.add(points[half - over :], later, counted[half - over :])
                return
            fresh = np.unique(points)
        self.rank[fresh] = np.arange(len(self.symbols), len(self.symbols) + len(fresh))
        self.symbols = np.concatenate([self.symbols, fresh])
        ranks = self.rank[points]
        n = len(points) - self.order + 1
        if n <= 0:
            return
        codes = ranks[:n].copy()
        for k in range(1, self.order):
            codes *= _MOST_SYMBOLS
            codes += ranks[k : k + n]
        codes = codes[ends[self.order - 1 :]] * 2 + counted[self.order - 1 :][ends[self.order - 1 :]]
        codes, counts = np.unique(codes, return_counts=True)
        self.codes, self.counts = _added(
            np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts])
        )
        if len(self.codes) >= _MOST_HELD:
            self.flush()

    def flush(self) -> None:
        if len(self.codes):
            codes, counts = _added(self.codes >> 1, np.where(self.codes & 1, self.counts, 0))
            points = np.empty((len(codes), self.order), dtype=np.uint32)
            for k in range(self.order - 1, -1, -1):
                codes, at = np.divmod(codes, _MOST_SYMBOLS)
                points[:, k] = self.symbols[at]
            self.emit(_strings(points), counts)
        self.rank[self.symbols] = -1
        self._reset()


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _strings(points: np.ndarray) -> pa.Array:
    width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width.sum(axis=1))]).astype(np.int32)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(data))


class Answers:
    """Log probabilities of n-grams, looked up for whole runs of text at once."""

    def __init__(self, grams: pa.Array, logs: np.ndarray, order: int = ORDER):
        points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, order)
        self.order = order
        alphabet = np.unique(points)
        self.size = max(1, len(alphabet))
        self.rank = np.full(_POINTS, -1, dtype=np.int64)
        self.rank[alphabet] = np.arange(len(alphabet))
        self.known: dict[int, np.ndarray] = {}
        codes = self._codes([self.rank[points[:, k]] for k in range(order)], learn=True)
        at = np.argsort(codes, kind="stable")
        self.codes, self.logs = codes[at], logs[at]

    def _codes(self, ranks: list[np.ndarray], learn: bool = False) -> np.ndarray:
        codes, bound = ranks[0].copy(), self.size
        for k in range(1, self.order):
            # A large alphabet would pass 63 bits: beginnings are numbered anew.
            if bound * self.size >= 1 << 62:
                if learn:
                    self.known[k] = np.unique(codes)
                codes = np.searchsorted(self.known[k], codes)
                bound = len(self.known[k]) + 1
            codes *= self.size
            codes += ranks[k]
            bound *= self.size
        return codes

    def __call__(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each point that ends an n-gram."""
        ranks = self.rank[points]
        n = len(points) - self.order + 1
        codes = self._codes([ranks[k : k + n] for k in range(self.order)])[ends[self.order - 1 :]]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        if len(codes) and (not len(self.codes) or (self.codes[at] != codes).any()):
            raise RuntimeError("an n-gram was never asked for: the documents changed between two readings")
        return self.logs[at]


def in_blocks(docs: DataFrame) -> DataFrame:
    """Columns by position (``_0``, ``_1``...) and ``block``, the same at every reading of the rows.

    A block is ``BLOCK_ROWS`` neighbouring rows of a Parquet file, however the
    file is split. Documents that don't come straight from such files are written.
    """
    named = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    try:
        return _with_block(named)
    except AnalysisException:
        return _with_block(written(named, "documents"))


def _with_block(named: DataFrame) -> DataFrame:
    at = named.metadataColumn("_metadata")
    rows = F.floor(at["row_index"] / BLOCK_ROWS)
    # Two blocks of one number are one larger block.
    block = F.pmod(F.xxhash64(at["file_path"], rows), F.lit((1 << 31) - 1)).cast("int")
    return named.select("*", block.alias("block"))


def _by_block(table: DataFrame, purpose: str) -> str:
    path = scratch_dir(table.sparkSession, purpose)
    table.repartition("block").write.partitionBy("block").parquet(path)
    return path


def _of_block(folder: str, block: int) -> pa.Table | None:
    system, path = opened(f"{folder}/block={block}")
    if system.get_file_info(path).type == pa.fs.FileType.NotFound:
        return None
    return pa.dataset.dataset(path, filesystem=system, format="parquet").to_table()


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of a batch by block; neighbours stay together."""
    blocks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else [0]
    for i, j in zip(edges, edges[1:], strict=False):
        yield int(blocks[i]), batch.slice(i, j - i)


def gram_counts(placed: DataFrame, text: str, doc_id: str, marks: str, order: int = ORDER) -> DataFrame:
    """Each block's different n-grams, with their count in its documents that train the model (or 0): block, gram, c.

    ``marks`` names the folder of marked ids by block. A gram may have a few rows in a block.
    """
    schema = pa.schema([("block", pa.int32()), ("gram", pa.string()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("quality")
        out: list[pa.RecordBatch] = []
        current: int | None = None
        trained: set = set()

        def emit(grams: pa.Array, counts: np.ndarray) -> None:
            blocks = pa.array(np.full(len(counts), current, dtype=np.int32))
            out.append(pa.RecordBatch.from_arrays([blocks, grams, pa.array(counts, pa.int64())], schema=schema))

        counter = _Counter(emit, order)
        for batch in batches:
            for block, rows in _pieces(batch):
                if block != current:
                    counter.flush()
                    current, found = block, _of_block(marks, block)
                    trained = set() if found is None else set(found.filter(found["train"])["doc_id"].to_pylist())
                flags = [i in trained for i in rows.column(1).to_pylist()]
                texts = (x.as_py() or "" for x in rows.column(0))
                for run in runs(zip(texts, flags, strict=True), order):
                    counter.add(*run)
                    yield from out
                    out.clear()
        counter.flush()
        yield from out

    return placed.select(text, doc_id, "block").mapInArrow(count, "block int, gram string, c bigint")


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Probability of the last character of each n-gram, given those before: gram, p.

    ``counts`` (gram, c) has the n-grams of trusted texts and, with a count of 0,
    others that are asked for. The highest order has counts, those below the number of
    different characters before. Each order has three discounts, from how many
    n-grams have counts 1 to 4. Below all is an even chance of every known
    character and one unknown one.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        levels[k] = written(
            levels[k + 1].groupBy(shorter.alias("gram")).agg(F.count(F.when(F.col("c") > 0, 1)).alias("c")), "grams"
        )
    p = None
    for k in range(1, order + 1):
        level = levels[k]
        n = level.agg(
            *[F.count(F.when(F.col("c") == i, 1)) for i in range(1, 5)], F.count(F.when(F.col("c") > 0, 1))
        ).first()
        one, two, more = _discounts(*n[:4])
        c = F.col("c")
        cut = F.when(c == 0, 0.0).when(c == 1, one).when(c == 2, two).otherwise(more)
        split = level.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("low", F.substring("gram", 2, k))
        totals = split.where(c > 0).groupBy("context").agg(
            F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("weight")
        )
        lower = F.lit(1.0 / (n[4] + 1))
        # One strategy at every size where tables grow with the corpus.
        alike = (lambda t: t.hint("merge")) if k > 2 else (lambda t: t)
        joined = split.join(alike(totals), "context", "left")
        if p is not None:
            joined = joined.join(alike(p.select(F.col("gram").alias("low"), F.col("p").alias("lower"))), "low")
            lower = F.col("lower")
        found = (c - cut) / F.col("total") + F.col("weight") * lower
        p = joined.select("gram", F.coalesce(found, lower).alias("p"))
    return p


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[Column, Column, Column]:
    """The three discounts; a fixed one half, one, one and a half where counts are too few."""
    if not (n1 and n2 and n3):
        return F.lit(0.5), F.lit(1.0), F.lit(1.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(F.lit(min(max(d, 0.05), i - 0.05)) for i, d in enumerate(raw, 1))


def perplexities(
    placed: DataFrame, text: str, answers: str, order: int = ORDER, held: tuple[str, str] | None = None
) -> DataFrame:
    """Add ``perplexity`` to rows in blocks; null for null and empty texts.

    ``held`` names the id column and the folder of marked ids: only documents that are held out are returned then.
    """
    names = placed.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("quality")
        current, lookup, chosen = None, None, None
        for batch in batches:
            for block, rows in _pieces(batch):
                if block != current:
                    current, lookup = block, None
                    if held:
                        marked = _of_block(held[1], block)
                        chosen = set() if marked is None else set(marked.filter(marked["held"])["doc_id"].to_pylist())
                if held:
                    ids = rows.column(names.index(held[0])).to_pylist()
                    rows = rows.filter(pa.array([i in chosen for i in ids], pa.bool_()))
                if not rows.num_rows:
                    continue
                if lookup is None:
                    found = _of_block(answers, block)
                    if found is None:  # a block of empty texts
                        found = pa.table({"gram": pa.array([], pa.string()), "log": pa.array([], pa.float32())})
                    lookup = Answers(found["gram"], found["log"].to_numpy(), order)
                scores = []
                for x in rows.column(names.index(text)):
                    value = x.as_py()
                    total = sum(
                        float(lookup(points, ends).sum(dtype=np.float64))
                        for points, ends, _ in runs([(value or "", False)], order)
                    )
                    scores.append(float(np.exp(-total / len(value))) if value else None)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(scores, pa.float64())], names=[*names, "perplexity"]
                )

    schema = T.StructType([*placed.schema.fields, T.StructField("perplexity", T.DoubleType())])
    return placed.mapInArrow(score, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that a label calls good; toxic documents are not trusted."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where(good).select("doc_id").distinct()


def judge_quality(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN
) -> DataFrame:
    """Each document's id, language, perplexity, limit, and whether it is kept.

    A language without trusted documents has the limit of all of them. Without any
    trusted document, and for empty and null texts, there is nothing to hold
    against a document, and it is kept; null ids are never trusted. Null languages
    count as one language. Very long texts are taken in runs. Repeated rows are
    repeated and judged alike; an empty table gives an empty one; other columns are
    not read, whatever their names.
    """
    judged = _judged(docs.select("doc_id", "lang", "text"), labels, quantile, margin)
    return judged.select(F.col("_0").alias("doc_id"), F.col("_1").alias("lang"), "perplexity", "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names; else as ``judge_quality``."""
    judged = _judged(docs, labels, QUANTILE, MARGIN)
    return judged.where("keep").select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, margin: float) -> DataFrame:
    doc_id, lang, text = (f"_{docs.columns.index(n)}" for n in ("doc_id", "lang", "text"))
    placed = in_blocks(docs)
    marks = _marks(placed, doc_id, labels)
    if marks is None:
        return placed.select(
            "*", F.lit(None).cast("double").alias("perplexity"),
            F.lit(None).cast("double").alias("limit"), F.lit(True).alias("keep"),
        )
    grams = written(gram_counts(placed, text, doc_id, marks), "grams")
    counts = written(grams.groupBy("gram").agg(F.sum("c").alias("c")), "counts")
    log = F.ln("p").cast("float").alias("log")
    answers = _by_block(
        grams.select("block", "gram").join(kneser_ney(counts).hint("merge"), "gram").select("block", "gram", log), "logs"
    )
    fold = perplexities(placed.select(doc_id, lang, text, "block"), text, answers, held=(doc_id, marks))
    known = written(fold.select(F.col(lang).alias("l"), F.length(text).alias("n"), "perplexity"), "held-out")
    mean = known.agg(_mean()).first()[0]
    means = known.groupBy(F.col("l").alias("language")).agg(_mean().alias("usual"))
    steadied = known.join(means, F.col("l").eqNullSafe(F.col("language")), "left")
    at = F.percentile_approx(_steadied(F.coalesce("usual", F.lit(mean)), F.col("n")), quantile, 10_000) * margin
    # A row per language of the trusted documents, and one for all others.
    limits = written(
        steadied.groupBy("language").agg(F.first("usual").alias("usual"), at.alias("at")), "limits"
    )
    overall = known.agg(
        F.percentile_approx(_steadied(F.lit(mean), F.col("n")), quantile, 10_000) * margin
    ).first()[0]
    scored = perplexities(placed, text, answers).join(limits, F.col(lang).eqNullSafe(F.col("language")), "left")
    usual = F.coalesce("usual", F.lit(mean).cast("double"))
    judged = scored.withColumn("perplexity", _steadied(usual, F.length(text))).withColumn(
        "limit", F.coalesce("at", F.lit(overall).cast("double"))
    )
    return judged.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True)))


def _marks(placed: DataFrame, doc_id: str, labels: DataFrame) -> str | None:
    """Folder of the trusted documents' ids by block: those that train and those held out. None without any to train."""
    ids = placed.select("block", F.col(doc_id).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    marked = written(
        ids.join(trusted_ids(labels).hint("merge"), "doc_id").select(
            "block", "doc_id", (~held).alias("train"), held.alias("held")
        ),
        "trusted",
    )
    if marked.where("train").isEmpty():
        return None
    if marked.where("held").isEmpty():
        marked = marked.withColumn("held", F.lit(True))
    return _by_block(marked, "marks")


def _mean() -> Column:
    return F.avg(F.ln("perplexity"))


def _steadied(usual: Column, n: Column) -> Column:
    """Perplexity as if the text went on for ``STEADY_CHARS`` characters of its language's average."""
    return F.exp((F.ln("perplexity") * n + usual * STEADY_CHARS) / (n + STEADY_CHARS))
