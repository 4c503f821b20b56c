"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its word shingles; a shingle's weight is how often
it occurs. For every sample k and term there are fixed r, c ~ Gamma(2, 1) and
b ~ U(0, 1), drawn from tables at places that the term's hash names. A term of
weight w gets t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y e^r), and
the sample is the pair (term, t) of smallest a. Two texts share a sample with a
probability equal to their generalised Jaccard similarity.

A fingerprint has four hexadecimal digits per sample. Likeness is the share of
equal samples. A text without words has all samples 0: it is like another such
text (1) and unlike any other (0). Null counts as empty. Equal texts have equal
fingerprints, whatever the rows around them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from apportion.llm.words import mixed, shingles, word_hashes

SAMPLES = 64
WORDS_PER_TERM = 5
BLOCK_BYTES = 1 << 20
MAX_BLOCKS = 1 << 14
_ROWS_LOG = 13
_TERMS_AT_ONCE = 1 << 11


class Sampler:
    """Draws the samples of weighted term sets; the same in every process."""

    def __init__(self, samples: int = SAMPLES, words: int = WORDS_PER_TERM, seed: int = 1):
        draw = np.random.Generator(np.random.PCG64(seed))
        shape = (1 << _ROWS_LOG, samples)
        self.samples, self.words = samples, words
        self.rate = draw.gamma(2.0, size=shape).astype(np.float32)
        self.log_size = np.log(draw.gamma(2.0, size=shape)).astype(np.float32)
        self.shift = draw.random(size=shape, dtype=np.float32)

    def codes(self, text: bytes) -> np.ndarray:
        """The samples of a text as 16-bit numbers."""
        terms, counts = np.unique(shingles(word_hashes(text), self.words), return_counts=True)
        return self.sample(terms, counts)

    def sample(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best = np.full(self.samples, np.inf, dtype=np.float32)
        who = np.zeros(self.samples, dtype=np.uint64)
        mask, shift = np.uint64((1 << _ROWS_LOG) - 1), np.uint64(_ROWS_LOG)
        every = np.arange(self.samples)
        for i in range(0, len(terms), _TERMS_AT_ONCE):
            some = terms[i : i + _TERMS_AT_ONCE]
            r = self.rate[some & mask]
            c = self.log_size[(some >> shift) & mask]
            b = self.shift[(some >> (shift + shift)) & mask]
            log_weight = np.log(weights[i : i + _TERMS_AT_ONCE]).astype(np.float32)
            t = np.floor(log_weight[:, None] / r + b)
            a = c - r * (t - b + 1)
            low = a.argmin(axis=0)
            found = a[low, every]
            name = mixed(some[low] + t[low, every].astype(np.int64).astype(np.uint64))
            better = found < best
            best[better], who[better] = found[better], name[better]
        codes = (who % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        return codes if len(terms) else np.zeros(self.samples, dtype=np.uint16)


def hexed(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def fingerprint(text: Column, samples: int = SAMPLES, words: int = WORDS_PER_TERM) -> Column:
    """The fingerprint of each text in a column, null as empty."""

    @pandas_udf("string")
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = Sampler(samples, words)
        for batch in batches:
            yield batch.map(lambda x: hexed(sampler.codes((x or "").encode())))

    return computed(F.coalesce(text, F.lit("")))


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints, null if either is null."""
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.filter(
        at, lambda i: F.substring(one, i * 4 + 1, F.lit(4)) == F.substring(other, i * 4 + 1, F.lit(4))
    )
    return F.size(same) / F.lit(float(samples))


def edit_probes(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS_PER_TERM) -> DataFrame:
    """Fingerprints of texts, of their edited texts, and how alike they are.

    The edited text has its last quarter of code points replaced by the first as
    many of the next document, in the order of ``doc_id``, nulls last, then of a
    hash of the text; the last document is followed by the first. A single
    document follows itself. An empty table gives an empty result. Repeated rows
    give repeated rows. Other columns are not read.

    Texts are dealt once, to blocks of neighbouring ids; the first row of a
    block is sent to the block before as well. So no task needs another's rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    blocked = _with_following_block(rows)
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, words)
        block, held, out = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != block:
                    block, held = row[0], None
                mine = (row[2], row[3], sampler.codes(row[3].encode()))
                if held is not None:
                    out.append(_probe(sampler, *held, *mine[1:]))
                held = None if row[1] else mine
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out = []

    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    return (
        blocked.repartition("block")
        .sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_last(), "order")
        .select("block", "guest", "doc_id", "text")
        .mapInArrow(probe, schema)
    )


def _probe(sampler, doc_id, text, codes, next_text, next_codes) -> dict:
    n = len(text)
    edited = text[: n - n // 4] + next_text[: n // 4]
    raw = edited.encode()
    changed = sampler.codes(raw)
    return {
        "doc_id": doc_id,
        "n_chars": n,
        "edited_sha256": hashlib.sha256(raw).hexdigest(),
        "fingerprint": hexed(codes),
        "edited_fingerprint": hexed(changed),
        "near_edited": float((codes == changed).mean()),
        "near_next": float((codes == next_codes).mean()),
    }


def _with_following_block(rows: DataFrame) -> DataFrame:
    """Rows with their block of ids, and each block's first row also as a guest of the one before.

    The blocks are cut at quantiles of the ids, at most ``MAX_BLOCKS``; a guest is
    told by its id and text, so rows equal to the first come along, no others.
    """
    (total,) = rows.agg(F.sum(F.octet_length("text"))).first()
    blocks = max(1, min(MAX_BLOCKS, (total or 0) // BLOCK_BYTES))
    (cuts,) = rows.agg(
        F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 10 * blocks)
    ).first()
    cuts = sorted(set(cuts or [])) if blocks > 1 else []
    with_block = _bucketed(rows, cuts).withColumn("order", F.xxhash64("text"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "order"))
    found = with_block.groupBy("block").agg(first.alias("first")).collect()
    firsts = sorted(((r.block, r["first"]) for r in found), key=lambda x: x[0])
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    table = rows.sparkSession.createDataFrame(
        [(b, f.doc_id, f.order, before[b]) for b, f in firsts],
        "block int, first_id bigint, first_order bigint, before int",
    )
    # At most MAX_BLOCKS rows.
    joined = with_block.join(F.broadcast(table), "block")
    opens = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("order") == F.col("first_order"))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("block"), F.lit(True).alias("guest"))
    return joined.select(
        F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))).alias("to"),
        "doc_id", "text", "order",
    ).select("to.block", "to.guest", "doc_id", "text", "order")


def _bucketed(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Add how many cuts ``doc_id`` is not below; one more than all of them for null."""
    if not cuts:
        return rows.withColumn("block", F.col("doc_id").isNull().cast("int"))
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="as_double", outputCol="as_block")
    return (
        bucketizer.setHandleInvalid("keep")
        .transform(rows.withColumn("as_double", F.col("doc_id").cast("double")))
        .withColumn("block", F.coalesce(F.col("as_block").cast("int"), F.lit(len(splits) - 1)))
        .drop("as_double", "as_block")
    )
