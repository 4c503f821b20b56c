"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece belongs to class k if its length is at most capacity / k and more than
capacity / (k + 1); every bin of class k takes exactly k pieces, whatever they are.
That wastes nothing where lengths are capacity / k exactly, so a document's ids are
cut into runs of the capacity and its half, quarter and so on down to
``SHORTEST_CUT``; what is left, shorter than that, is one piece of a class of at least
capacity / ``SHORTEST_CUT``. Every task packs its own rows; it needs no other's, and
holds at most one open bin per class. At its end the open bins of the cut classes
close as sequences of powers of two, which need no padding, and those of the
short pieces are emptied into shared bins.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.llm.chunks import PartEncoder
from apportion.llm.held import held

CAPACITY = 2048
SHORTEST_CUT = 64
END_ID = 1
SPECIAL = "<|endoftext|>"


class HarmonicPacker:
    """Deals pieces to bins by their class and numbers the bins of one task.

    ``add`` returns the finished pieces with their sequence and offset.
    """

    def __init__(self, first: int, capacity: int = CAPACITY, shortest: int = SHORTEST_CUT):
        self.next, self.capacity, self.shortest = first, capacity, shortest
        self.open: dict[int, list[dict]] = defaultdict(list)

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        """Start and length of the pieces of ``n`` ids."""
        at, size = 0, self.capacity
        while n - at >= self.shortest:
            while size > n - at:
                size //= 2
            yield at, size
            at += size
        if at < n:
            yield at, n - at

    def add(self, piece: dict) -> list[dict]:
        k = self.capacity // piece["length"]
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self._closed(held)

    def close(self) -> list[dict]:
        done: list[dict] = []
        short: list[dict] = []
        for k, held in sorted(self.open.items()):
            if self.capacity // k < self.shortest:
                short += held
                continue
            while held:
                some = 1 << (len(held).bit_length() - 1)
                done += self._closed(held[:some])
                held = held[some:]
        shared: list[dict] = []
        for piece in short:
            if sum(p["length"] for p in shared) + piece["length"] > self.capacity:
                done += self._closed(shared)
                shared = []
            shared.append(piece)
        self.open.clear()
        return done + (self._closed(shared) if shared else [])

    def _closed(self, held: list[dict]) -> list[dict]:
        offset = 0
        for piece in held:
            piece |= {"sequence_id": self.next, "offset": offset}
            offset += piece["length"]
        self.next += 1
        return held


def tokenizer_encoder(path: str) -> PartEncoder:
    """Encodes as the tokenizers library does with a byte-level BPE file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    end = tokenizer.token_to_id(SPECIAL)

    size = 1 + max(tokenizer.get_vocab().values())
    # A character of a token's name stands for a byte.
    width = np.array([len(tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)

    def whole(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def run(parts: list[str]) -> list[bytes]:
        """The parts as one text, whose ids are dealt to the parts by the bytes they stand for."""
        raw = b"".join(whole(["".join(parts)]))
        after = np.cumsum(width[np.frombuffer(raw, dtype="<u4")])
        cuts = np.cumsum([len(x.encode()) for x in parts])
        ends = (np.searchsorted(after, cuts, "right") * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    class WithSpecial(PartEncoder):
        def ids_of(self, texts: list[str]) -> list[bytes]:
            # The special token is matched before the text is cut.
            if end is None or not any(SPECIAL in x for x in texts):
                return super().ids_of(texts)
            cut = [x.split(SPECIAL) for x in texts]
            ids = iter(super().ids_of([p for x in cut for p in x]))
            return [end.to_bytes(4, "little").join([next(ids) for _ in x]) for x in cut]

    return WithSpecial(whole, run)


def pack(
    docs: DataFrame,
    encoder: Callable[[], PartEncoder],
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """All documents in pieces with their place in sequences.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the ids if ``with_ids``. A null text is empty and still has its end id.
    Repeated rows are packed each for itself. An empty table gives no rows. A
    sequence id holds the task's number above its own count, so ids are unique
    and stay the same when a task runs again. Nothing is shuffled.
    """
    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
        " sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")
    )
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    arrow = pa.schema(
        [(n, pa.int64()) for n in names] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoder(encoder)
        packer = HarmonicPacker(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            out: list[dict] = []
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in known.encoded(zip(batch.column(0).to_pylist(), texts, strict=True)):
                ids += END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                for start, length in packer.cuts(total):
                    run = ids[4 * start : 4 * (start + length)]
                    piece = {
                        "doc_id": doc_id, "start": start, "length": length,
                        "ids_crc32": zlib.crc32(run), "doc_tokens": total,
                    }
                    if with_ids:
                        piece["ids"] = memoryview(run).cast("I").tolist()
                    out += packer.add(piece)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        yield pa.RecordBatch.from_pylist(packer.close(), schema=arrow)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(packed, schema)


def _encoder(make: Callable[[], PartEncoder]) -> PartEncoder:
    """An encoder per process, so that what it remembers outlives a task."""
    made, key = held("packing"), getattr(make, "args", None) or make
    if key not in made:
        made[key] = make()
    return made[key]
