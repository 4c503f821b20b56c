"""Archives: round trips, revisits, and faults that the reader names."""

import hashlib
import io

import pytest
import zstandard

from apportion.llm import warc

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a.org/1", BIG, "own"), (3, "http://a.org/2 b\n", BIG, "own"), (9, None, BIG, "own"), (9, None, BIG, "own"),
    (3, "http://a.org/2", BIG, "own"), (None, "http://n.org", BIG, "own"), (1, "http://s.org", "short", "own"),
    (2, "http://s.org", "short", "own"), (4, "u", None, "own"), (6, "u", "", "own"), (7, "ü", "é日本😀" * 60, "own"),
    (8, "u", "long " * 400_000, "own"), (None, None, "only nulls " * 20, "own"), (None, None, "only nulls " * 20, "own"),
]
SCHEMA = "page_id bigint, url string, html string, payload string"


@pytest.fixture(scope="module")
def manifest(spark):
    return warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).repartition(3))


def expected():
    rows = []
    for page_id, _, html, _ in PAGES:
        raw = (html or "").encode()
        same = [i for i, _, h, _ in PAGES if (h or "").encode() == raw and i is not None]
        first = min(same) if same and len(raw) >= 100 else None
        again = first is not None and page_id != first
        rows.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None, None))
    return sorted(rows, key=repr)


def test_pages_read_back(manifest):
    records = warc.read_archives(manifest)
    found = warc.page_rows(records)
    assert sorted(map(tuple, found.collect()), key=repr) == expected()
    texts = {bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert texts == {(h or "").encode() for _, _, h, _ in PAGES}
    uris = {r.uri for r in records.where("record_type <> 'warcinfo'").collect()}
    assert "http://a.org/2%20b%0A" in uris and "urn:page:9" in uris and "ü" in uris


def test_empty_tables(spark):
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0
    assert warc.page_rows(warc.read_archives(manifest)).count() == 0


def test_dictionary_leads_large_archives(spark):
    rows = [(i, f"http://h{i}.org", f"<html><body><p>page {i} of the archive</p>{'words and more ' * (i % 40 + 10)}</body></html>") for i in range(9000)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))
    (path,) = [r.path for r in manifest.collect()]
    system, inside = warc.opened(path)
    with system.open_input_stream(inside, compression=None) as stream:
        kinds = [magic for magic, _ in warc.FrameReader(stream)]
    assert kinds[0] == warc.DICTIONARY_FRAME and set(kinds[1:]) == {warc.ZSTD_FRAME} and len(kinds) == 9002
    found = warc.page_rows(warc.read_archives(manifest, with_payload=False))
    assert found.where("fault IS NULL AND record_type = 'response'").count() == 9000


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 10)
    out = warc.ArchiveWriter(str(tmp_path), "part", "2024-01-01T00:00:00Z")
    done = []
    for i in range(40):
        text = hashlib.sha512(bytes([i])).hexdigest() * 4
        full = out.add(warc.page_record(i, "u", text.encode(), len(text), hashlib.sha256(text.encode()).hexdigest(), None, "d"))
        done += [full] if full else []
    done.append(out.close())
    assert len(done) > 2 and sum(x["records"] for x in done) == 40
    ids = [r["record_id"] for x in done for r in warc._records(x["path"]) if r["record_type"] == "response"]
    assert ids == [warc.page_urn(i) for i in range(40)]


def frame(raw, **more):
    return zstandard.ZstdCompressor(**more).compress(raw)


GOOD = warc.page_record(1, "u", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None, "d")


@pytest.mark.parametrize("raw, fault", [
    (GOOD, None),
    (GOOD.replace(b"WARC/1.1", b"HTTP/1.1", 1), "no WARC header"),
    (GOOD.replace(b"WARC-Date: d\r\n", b""), "no warc-date"),
    (GOOD.replace(b"WARC-Date: d", b"WARC-Date"), "header line without a colon"),
    (GOOD[:-1], "content-length does not fit the record"),
    (GOOD + b"x", "content-length does not fit the record"),
    (GOOD.replace(b"abc", b"abd"), "payload digest differs"),
    (GOOD.replace(b"Content-Length: 3", b"Content-Length: 4"), "payload length differs from the HTTP header"),
    (b"", "no WARC header"),
])
def test_faults_of_records(raw, fault):
    assert warc.checked(raw)["fault"] == fault
    # The records after a faulty one are read.
    stream = io.BytesIO(frame(raw, write_checksum=True) + frame(GOOD, write_content_size=False))
    assert [warc.checked(x)["fault"] for x in warc.frames(stream)] == [fault, None]


def test_broken_frames_end_an_archive(tmp_path, spark):
    whole = frame(GOOD, write_checksum=True)
    broken = whole[:-1] + bytes([whole[-1] ^ 1])
    rows = []
    for i, data in enumerate((whole + broken, whole + whole[:-3], whole + b"junk" * 4, whole + b"\x28")):
        path = tmp_path / f"{i}.warc.zst"
        path.write_bytes(data)
        rows.append((str(path), 1))
    found = warc.read_archives(spark.createDataFrame(rows, "path string, fault int")).groupBy("path").agg({"fault": "count", "*": "count"})
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(1, 2)] * 4


def test_compressed_and_plain_dictionaries():
    made = zstandard.train_dictionary(4096, [GOOD + bytes([i % 251]) * (i % 90) for i in range(4000)])
    coded = zstandard.ZstdCompressor(dict_data=made).compress(GOOD)
    for content in (made.as_bytes(), frame(made.as_bytes())):
        lead = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content
        assert list(warc.frames(io.BytesIO(lead + coded))) == [GOOD]
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(warc.DICTIONARY_FRAME.to_bytes(4, "little") + (8).to_bytes(4, "little") + b"no dict." + coded)))
