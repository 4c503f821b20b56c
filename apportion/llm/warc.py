"""Web archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: every task keeps an archive open, learns a dictionary from its first records
and rolls over at ``ARCHIVE_BYTES``. Files carry the attempt's number in their name and
are listed in a manifest that only finished tasks contribute to, so what a lost
executor left behind is never read. Equal payloads are stored once; the other records
revisit the one with the smallest id.

Reading: an archive is a stream of frames whose ends are found from their block headers.
A task holds one record at a time, and every length, header and digest is checked. A
record that fails says why in ``fault``; the records after it are still read, unless a
frame is broken, which ends that archive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.session import scratch_dir, written

ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20  # of records, from which an archive's dictionary is learned
SAMPLE_RECORD = 16 << 10  # of one record
LEAST_SHARED = 100  # bytes; shorter payloads are never revisited
LEVEL = 3
READ_BYTES = 1 << 20
MOST_PARTS = 10_000

# Fixed values of the formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
ZSTD_DICTIONARY = 0xEC30A437
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PAGE = re.compile(r"<urn:page:(-?\d+|null)>")


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it."""
    return pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


# Records


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}".encode()]
    head += [f"{k}: {v}".encode("utf-8", "replace") for k, v in fields.items()]
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """A response with its payload, or without one a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    urn = page_urn(page_id)
    uri = urn[1:-1] if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    fields = {
        "WARC-Record-ID": urn,
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if payload is not None:
        return record("response", fields, http.encode() + payload)
    return record("revisit", fields | {"WARC-Refers-To": page_urn(refers_to), "WARC-Profile": PROFILE}, http.encode())


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Header fields (names in lower case), block, and what is wrong with the record."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].split(b"\r\n") if end >= 0 else []
    if not lines or not lines[0].startswith(b"WARC/"):
        return {}, b"", "no WARC header"
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return fields, b"", "header line without a colon"
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    missing = [x for x in MANDATORY if x not in fields]
    if missing:
        return fields, b"", f"no {missing[0]}"
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        return fields, b"", "content-length is not a number"
    block, tail = raw[end + 4 : end + 4 + int(length)], raw[end + 4 + int(length) :]
    if len(block) != int(length) or tail != b"\r\n\r\n":
        return fields, block, "content-length does not fit the record"
    return fields, block, None


def http_payload(block: bytes) -> tuple[int | None, bytes]:
    """The length that the HTTP header states, and the bytes after the header."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), body
    return None, body


# Frames


class FrameReader:
    """Splits a stream into Zstandard frames without decoding them."""

    def __init__(self, stream):
        self._stream, self._held, self._at = stream, b"", 0

    def _need(self, n: int) -> bool:
        """Have ``n`` bytes from the current place on, if the stream has them."""
        if len(self._held) - self._at >= n:
            return True
        parts, have = [self._held[self._at :]], len(self._held) - self._at
        while have < n and (more := self._stream.read(max(READ_BYTES, n - have))):
            parts.append(more)
            have += len(more)
        self._held, self._at = b"".join(parts), 0
        return have >= n

    def _end(self) -> int:
        """Length of the data frame at the current place."""
        if not self._need(6):
            raise ValueError("truncated frame header")
        descriptor = self._held[self._at + 4]
        single, size_flag = descriptor >> 5 & 1, descriptor >> 6
        end = 5 + (1 - single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[size_flag]
        last = 0
        while not last:
            if not self._need(end + 3):
                raise ValueError("truncated block header")
            head = int.from_bytes(self._held[self._at + end : self._at + end + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        return end + 4 * (descriptor >> 2 & 1)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """Magic number and bytes of each frame; of skippable ones the content alone."""
        while self._need(1):
            if not self._need(4):
                raise ValueError("truncated magic number")
            magic = int.from_bytes(self._held[self._at : self._at + 4], "little")
            if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
                if not self._need(8):
                    raise ValueError("truncated skippable frame")
                size, skip = int.from_bytes(self._held[self._at + 4 : self._at + 8], "little"), 8
            elif magic == ZSTD_FRAME:
                size, skip = self._end(), 0
            else:
                raise ValueError(f"no frame begins with {magic:#010x}")
            if not self._need(skip + size):
                raise ValueError("truncated frame")
            start = self._at + skip
            self._at = start + size
            yield magic, self._held[start : self._at]


def dictionary_of(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary in a skippable frame, which may itself be compressed."""
    if content[:4] == ZSTD_FRAME.to_bytes(4, "little"):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if content[:4] != ZSTD_DICTIONARY.to_bytes(4, "little"):
        raise ValueError("the leading skippable frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def frames(stream) -> Iterator[bytes]:
    """The decoded records of an archive, one per frame."""
    decoder = zstandard.ZstdDecompressor()
    for i, (magic, frame) in enumerate(FrameReader(stream)):
        if magic != ZSTD_FRAME:
            if i == 0 and magic == DICTIONARY_FRAME:
                decoder = zstandard.ZstdDecompressor(dict_data=dictionary_of(frame))
            continue
        out = decoder.decompressobj()
        raw = out.decompress(frame)
        if not out.eof or out.unused_data:
            raise ValueError("frame does not end where its blocks do")
        yield raw


class ArchiveWriter:
    """One open archive: the first records teach the dictionary, then frames follow."""

    def __init__(self, folder: str, name: str, date: str):
        self._folder, self._name, self._date, self._count = folder, name, date, 0
        self._reset()

    def _reset(self) -> None:
        self._waiting: list[bytes] = []
        self._size = self._records = self._sampled = 0
        self._sink = self._coder = None

    def add(self, raw: bytes) -> dict | None:
        """Take a record; returns the manifest row of an archive that this one filled."""
        self._records += 1
        if self._sink is None:
            self._waiting.append(raw)
            self._sampled += len(raw)
            if self._sampled < SAMPLE_BYTES:
                return None
            self._start()
        else:
            self._put(self._coder.compress(raw))
        return self.close() if self._size >= ARCHIVE_BYTES else None

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self._size += len(data)

    def _start(self) -> None:
        self._uri = f"{self._folder}/{self._name}-{self._count:05d}.warc.zst"
        system, path = opened(self._uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._sink = system.open_output_stream(path, compression=None)
        made = None
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:SAMPLE_RECORD] for x in self._waiting], level=LEVEL)
        except zstandard.ZstdError:
            pass  # too few records to learn from: the archive goes without a dictionary
        if made is not None:
            content = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
            self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content)
        self._coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        about = {"WARC-Record-ID": f"<urn:archive:{self._name}-{self._count}>", "WARC-Date": self._date,
                 "Content-Type": "application/warc-fields"}
        self._put(self._coder.compress(record("warcinfo", about, b"format: WARC File Format 1.1\r\n")))
        for raw in self._waiting:
            self._put(self._coder.compress(raw))
        self._waiting = []

    def close(self) -> dict | None:
        if not self._records:
            return None
        if self._sink is None:
            self._start()
        self._sink.close()
        done = {"path": self._uri, "records": self._records, "bytes": self._size}
        self._count += 1
        self._reset()
        return done


# Tables


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to of each page.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the one with the smallest page_id
    is kept; the others name it in ``refers_to`` and have a null payload. Rows that repeat
    the smallest id are kept too. A null id comes after all others; where all ids of a payload
    are null, each row is kept. A null html is empty. Digests are counted before they are joined,
    and only pages of a payload that recurs meet, without their payload. Further columns are left out.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    sized = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("payload")).select(
        "*",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    narrow = written(sized.select("page_id", "payload_bytes", "payload_digest"), "warc-digests")
    first = (
        narrow.where(F.col("payload_bytes") >= LEAST_SHARED)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("page_id").alias("ids"),
             F.count("*").alias("n"))
        .where((F.col("refers_to") != F.col("last")) | ((F.col("ids") > 0) & (F.col("ids") < F.col("n"))))
        .select("payload_digest", "refers_to")
    )
    revisits = (
        narrow.join(first, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to")
        .distinct()
    )
    # The digest in the key spreads null ids.
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest"))
    return sized.join(revisits, same, "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", "refers_to",
    )


def write_archives(pages: DataFrame, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Write a record per page into archives and return their manifest: path, records, bytes.

    Takes the columns page_id, url and html as ``with_revisits`` does; ``folder`` is by default
    a fresh one in the shared folder, ``date`` the time of the call. Control characters and spaces of a
    url are percent-encoded, a null url becomes the record's own name. Repeated rows are written each for
    itself, under one record id. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out = ArchiveWriter(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}", date)
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = out.add(page_record(*row, date))
                if full:
                    yield pa.RecordBatch.from_pylist([full], schema=schema)
        left = out.close()
        yield pa.RecordBatch.from_pylist([left] if left else [], schema=schema)

    return written(with_revisits(pages).mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-manifest")


RECORD = (
    "path string, record_type string, record_id string, uri string, refers_to string, payload_bytes bigint,"
    " payload_digest string, fault string"
)


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives listed in ``path``, in any order.

    path, record_type, record_id, uri, refers_to, payload_bytes and payload_digest (as stated by
    the record and, for a response, found in its payload), fault, and ``payload`` if wanted. A faulty record has a
    row with its fault; a broken frame gives one row with a fault in place of the archive's rest. Null
    paths are passed over, an archive listed twice is read twice; further columns are left out.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x == "payload_bytes" else pa.string() for x in names]
    schema = pa.schema([*zip(names, kinds, strict=True), *([("payload", pa.binary())] if with_payload else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in _records(uri):
                    size += len(row["payload"] or b"")
                    rows.append(row)
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    paths = manifest.where(F.col("path").isNotNull()).select("path")
    parts = max(1, min(paths.count(), MOST_PARTS))
    return paths.repartition(parts).mapInArrow(read, RECORD + (", payload binary" if with_payload else ""))


def _records(uri: str) -> Iterator[dict]:
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None) as stream:
        try:
            for raw in frames(stream):
                yield {"path": uri} | checked(raw)
        except (ValueError, zstandard.ZstdError) as error:
            yield dict.fromkeys(["record_type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest", "payload"]) | {
                "path": uri, "fault": str(error)}


def checked(raw: bytes) -> dict:
    """A record's fields, with what is wrong with it in ``fault``."""
    fields, block, fault = parsed(raw)
    kind, label = fields.get("warc-type"), fields.get("warc-payload-digest")
    digest = None if label is None else label.removeprefix("sha256:").lower()
    size = payload = None
    if fault is None and kind in ("response", "revisit"):
        size, payload = http_payload(block)
        if kind == "revisit":
            fault = None if "warc-refers-to" in fields else "revisit without warc-refers-to"
            payload = None
        elif size is not None and size != len(payload):
            fault = "payload length differs from the HTTP header"
        elif label is not None and label.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest:
            fault = "payload digest differs"
        elif size is None:
            size = len(payload)
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest,
        "fault": fault, "payload": payload,
    }


def page_rows(records: DataFrame) -> DataFrame:
    """The pages among the records: page_id, payload_bytes, payload_digest, record_type, refers_to, fault."""

    def number(name: str):
        return F.regexp_extract(name, _PAGE.pattern, 1).try_cast("bigint").alias(name)

    rows = records.where(F.coalesce("record_type", F.lit("")).isin("response", "revisit") | F.col("fault").isNotNull())
    return rows.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "fault"
    )
