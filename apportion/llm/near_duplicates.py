"""Near duplicates by ProbMinHash signatures, banding and verification.

A text is its set of five-word shingles. Every shingle
starts a Poisson process whose rate is its weight; each arrival falls into a random
slot, and a slot keeps the shingle that arrives first. A shingle is dropped once
its latest arrival is later than the first ones of all slots. Two texts agree in a slot
with a probability equal to the probability Jaccard similarity of their weights. All
weights are one, however often a shingle occurs, so that this is the similarity of the sets
by which links are judged.

Texts that agree in all slots of a band are candidates. A candidate is a link if the
exact Jaccard similarity of the shingle sets reaches the limit. A class is a connected
component of links, so candidates of one component need not be compared: within a
band's bucket each text is first held against a leader, then against the
one with most links, and at last all that are still apart against each other, in
blocks of bounded size.

Copies are one node all along: nodes are digests of texts, so thousands of copies
or a text shared by a third of the rows cost one node, and rows meet it at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm.components import components
from apportion.llm.held import held
from apportion.llm.words import mixed, word_hashes, word_run_hashes
from apportion.session import written

SLOTS, BANDS = 64, 16
FIRST_BANDS = 4
WORDS = 5
LIMIT = 0.8
# Members of a bucket that are compared at once with as many others, and shingles at once.
BLOCK, _COLUMNS = 128, 1 << 13
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def prob_min_hash(terms: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The first term of each slot as 32-bit numbers; all zero without terms."""
    first = np.full(slots, np.inf)
    owner = np.zeros(slots, dtype=np.uint64)
    rate = weights.astype(np.float64)
    time = np.zeros(len(terms))
    done, block = 0, 1
    while len(terms):
        arrivals = np.arange(done + 1, done + block + 1, dtype=np.uint64) * _STRIDE
        draw = mixed(terms[:, None] ^ arrivals[None, :])
        gap = -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)
        when = time[:, None] + np.cumsum(gap / rate[:, None], axis=1)
        slot = ((draw & np.uint64(0xFFF)) % np.uint64(slots)).astype(np.int64).ravel()
        flat = when.ravel()
        earliest = first.copy()
        np.minimum.at(earliest, slot, flat)
        won = np.flatnonzero((flat == earliest[slot]) & (flat < first[slot]))
        owner[slot[won]] = terms[won // block]
        first = earliest
        alive = when[:, -1] < first.max()
        terms, rate, time = terms[alive], rate[alive], when[alive, -1]
        done, block = done + block, min(2 * block, 256)
    return (mixed(owner) >> np.uint64(32)).astype(np.uint32) * (first < np.inf)


def shingle_set(text: str) -> np.ndarray:
    """Hashes of a text's different shingles.

    A text of fewer words than a shingle has one of all of them, and none without words.
    """
    words = word_hashes(text.encode())
    return np.unique(word_run_hashes(words, max(1, min(WORDS, len(words)))))


def node_of(text: Column) -> Column:
    """The node of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(texts: DataFrame) -> DataFrame:
    """A row per different text: node, sig. Texts without words have none."""
    arrow = pa.schema([("node", pa.binary()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_duplicates")
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[bytes, bytes] = {}
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen or node in out:
                    continue
                terms = shingle_set(text.as_py() or "")
                if len(terms):
                    out[node] = prob_min_hash(terms, np.ones(len(terms))).astype("<u4").tobytes()
            seen = set(out) if len(seen) > 100_000 else seen | set(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], schema=arrow
            )

    signed = texts.select(node_of(F.col("text")).alias("node"), "text").mapInArrow(
        sign, "node binary, sig binary"
    )
    return signed.groupBy("node").agg(F.first("sig").alias("sig"))


def _band(i: int) -> Column:
    width = 4 * SLOTS // BANDS
    return F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width))


def _keyed(signed: DataFrame, keys: list[Column]) -> DataFrame:
    return signed.select("node", F.posexplode(F.array(*keys)).alias("band", "key"))


def _leaders(members: DataFrame) -> DataFrame:
    """Buckets of more than one node with the smallest as leader: key, low."""
    sized = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"))
    return sized.where("n > 1").select("key", "low")


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    met = members.join(leaders, "key").where("node <> low")
    return met.select(F.least("node", "low").alias("a"), F.greatest("node", "low").alias("b")).distinct()


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shingles of the texts of some nodes: node, terms as sorted 32-bit numbers."""
    arrow = pa.schema([("node", pa.binary()), ("terms", pa.binary())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_duplicates")
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[bytes, bytes] = {}
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in seen and node not in out:
                    short = (shingle_set(text.as_py() or "") >> np.uint64(32)).astype("<u4")
                    out[node] = np.unique(short).tobytes()
            seen = set(out) if len(seen) > 100_000 else seen | set(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], schema=arrow
            )

    named = texts.select(node_of(F.col("text")).alias("node"), "text")
    found = named.join(nodes, "node", "left_semi").mapInArrow(collect, "node binary, terms binary")
    return found.groupBy("node").agg(F.first("terms").alias("terms"))


def _verified(pairs: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Pairs whose exact similarity reaches the limit."""
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_duplicates")
        for batch in batches:
            out: list[tuple[bytes, bytes, float]] = []
            # Sets are read where they lie in the batch, one pair at a time.
            for a, b, x, y in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, b = a.as_py(), b.as_py()
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True))
                similarity = common / (len(x) + len(y) - common)
                if similarity >= limit:
                    out.append((a, b, similarity))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    # Sets whose sizes are further apart than the limit cannot reach it.
    sizes = F.length("terms_a"), F.length("terms_b")
    return (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("terms").alias("terms_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("terms").alias("terms_a")), "a")
        .where(F.least(*sizes) / F.greatest(*sizes) >= limit)
        .select("a", "b", "terms_a", "terms_b")
        .mapInArrow(verify, "a binary, b binary, similarity double")
    )


def near_components(texts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``node`` and ``component`` of every text that has a near duplicate."""
    signed = written(signatures(texts), "signatures")
    members = _keyed(signed, [_band(i) for i in range(BANDS)])
    leaders = written(_leaders(members), "leaders")
    # Members of shared buckets only, once for all later steps.
    leads = (F.col("node") == F.col("low")).alias("leads")
    shared = written(members.join(leaders, "key").select("node", "band", "key", leads), "buckets")
    sets = written(_sets(texts, shared.select("node").distinct()), "shingles")

    def tried(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """The links among pairs that lie across known components."""
        across = pairs if known is None else _across(pairs, known)
        return written(_verified(across, sets, limit).select("a", "b"), "links")

    def joined(links: DataFrame, known: DataFrame | None) -> DataFrame:
        if known is not None:
            # A component stands for the links that made it.
            links = links.unionAll(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return written(components(links), "components")

    # Few bands find most links; the others then have to look across components only.
    early = F.col("band") < FIRST_BANDS
    first = tried(_pairs(shared.where(early), leaders), None)
    found = joined(first, None)
    second = tried(_pairs(shared.where(~early), leaders), found)
    found = joined(second, found)
    # Where members besides the leader are still apart, the one with most links leads: an
    # original has been linked to each leader that is a copy of it.
    apart = _apart(shared.where(~F.col("leads")), found)
    central = written(_central(apart, first.unionAll(second)), "central")
    found = joined(tried(_pairs(apart, central), found), found)
    # Then all that are apart are held against each other.
    beside = apart.join(central, "key").where("node <> low").select("key", "node")
    return joined(_exhausted(_apart(beside, found), sets, limit), found)


def _labelled(table: DataFrame, found: DataFrame, name: str, label: str) -> DataFrame:
    known = found.select(F.col("node").alias(name), F.col("component").alias("known"))
    return table.join(known, name, "left").withColumn(label, F.coalesce("known", name)).drop("known")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: key, node, component."""
    labelled = _labelled(members.select("key", "node"), found, "node", "component")
    several = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
    )
    return written(labelled.join(several.select("key"), "key", "left_semi"), "apart")


def _central(members: DataFrame, links: DataFrame) -> DataFrame:
    """The member of each bucket with most links: key, low."""
    ends = links.select("a").unionAll(links.select(F.col("b").alias("a")))
    degrees = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    most = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("node").alias("node")))
    return members.join(degrees, "node", "left").groupBy("key").agg(most["node"].alias("low"))


def _exhausted(members: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """Links (a, b) that connect what is near across components, every pair of a bucket compared.

    Members are dealt to blocks, those of a large component to blocks of its own, and
    every two blocks of a bucket meet, unless both are of one component.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    large = F.col("n") >= BLOCK
    rests = parts.groupBy("key").agg(F.sum(F.when(large, 0).otherwise(F.col("n"))).alias("rest"))

    def piece(what: str, n: str) -> Column:
        return F.pmod(F.xxhash64(what), F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)))

    own = F.xxhash64("component", piece("node", "n"))
    block = F.when(large, own).otherwise(piece("component", "rest")).alias("block")
    placed = written(
        members.join(parts, ["key", "component"])
        .join(rests, "key")
        .select("key", "node", "component", block, F.when(large, F.col("component")).alias("whole")),
        "blocks",
    )
    blocks = placed.select("key", "block", "whole").distinct()
    others = blocks.toDF("key", "other", "other_whole")
    meetings = (
        blocks.join(others, "key")
        .where("block <= other and not coalesce(whole = other_whole, false)")
        .select("key", F.col("block").alias("i"), F.col("other").alias("j"))
    )
    sides = meetings.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_pylist()
        apart = np.unique(np.array([x.hex() for x in group["component"].to_pylist()]), return_inverse=True)[1]
        low = _nearest([np.frombuffer(x, "<u4") for x in group["terms"].to_pylist()], apart, limit)
        pairs = [(x, nodes[k]) for i, (x, k) in enumerate(zip(nodes, low.tolist(), strict=True)) if i != k]
        columns = list(zip(*pairs, strict=True)) or [[], []]
        return pa.table([pa.array(c, pa.binary()) for c in columns], schema=arrow)

    return (
        placed.select("key", "block", "node", "component")
        .join(sides, ["key", "block"])
        .join(sets, "node")
        .select("key", "i", "j", "node", "component", "terms")
        .groupBy("key", "i", "j")
        .applyInArrow(compare, "a binary, b binary")
    )


def _nearest(sets: list[np.ndarray], apart: np.ndarray, limit: float) -> np.ndarray:
    """For each set the first one that links across ``apart`` connect it with."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)[count[column] > 1]
    column = column[count[column] > 1]
    common = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(count), _COLUMNS):
        at = slice(*np.searchsorted(column, (lo, lo + _COLUMNS)))
        held = np.zeros((n, _COLUMNS), dtype=np.float32)
        held[row[at], column[at] - lo] = 1
        common += held @ held.T
    near = (common / (sizes[:, None] + sizes[None, :] - common) >= limit) & (apart[:, None] != apart[None, :])
    near |= np.eye(n, dtype=bool)
    low, before = np.arange(n), None
    while before is None or (low != before).any():
        before = low
        low = np.where(near, low[None, :], n).min(axis=1)
    return low


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs between different components."""
    both = _labelled(_labelled(pairs, found, "a", "of_a"), found, "b", "of_b")
    return both.where("of_a <> of_b").select("a", "b")


def duplicate_classes(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Each row's doc_id with ``class_id``, the smallest id in its class, and ``copies``, the class's size.

    Equal texts are one class; so are null and empty texts. A text shorter than five words
    matches the texts of the same words. Null ids are passed over for the class id;
    a class of null ids alone has a null id. Repeated rows are repeated. Other
    columns are not read.
    """
    rows = docs.select("doc_id", "text")
    found = near_components(rows)
    named = rows.select("doc_id", node_of(F.col("text")).alias("node"))
    sizes = named.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    labelled = written(_labelled(sizes, found, "node", "component"), "texts")
    classes = labelled.groupBy("component").agg(
        F.min("low").alias("class_id"), F.sum("n").alias("copies")
    )
    by_node = labelled.join(classes, "component").select("node", "class_id", "copies")
    return named.join(by_node, "node").select("doc_id", "class_id", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns.

    Rows that repeat the kept id and text are dropped too. A class of null ids keeps one row.
    """
    names = docs.columns
    table = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"_{names.index(n)}") for n in ("doc_id", "text"))
    rows = table.select(doc_id.alias("doc_id"), text.alias("text"))
    found = near_components(rows)
    named = rows.select("doc_id", node_of(F.col("text")).alias("node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    lows = named.groupBy("node").agg(F.min(order).alias("low"))
    kept = (
        _labelled(lows, found, "node", "component")
        .groupBy("component")
        .agg(F.min("low").alias("low"))
        .select(_id_key(F.col("low.doc_id")).alias("id_key"), F.col("low.node").alias("node"))
    )
    marked = table.select("*", node_of(text).alias("node"), _id_key(doc_id).alias("id_key"))
    only = marked.join(kept, ["node", "id_key"], "left_semi").dropDuplicates(["node", "id_key"])
    return only.drop("node", "id_key").toDF(*names)


def _id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))
