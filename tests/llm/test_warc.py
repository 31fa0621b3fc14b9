"""WARC archives: round trips, revisits, and archives that are broken in every way the reader looks for."""

import hashlib
import io
import random
import struct

import pytest
import zstandard

from folioscan.llm import warc

RNG = random.Random(5)
LONG = "".join(RNG.choice("abcdefgh <p>é\n") for _ in range(3_000_000))
PAGES = [
    (5, "http://a/5", "x" * 100), (3, "http://a/3", "x" * 100), (9, None, "x" * 100), (4, "", "x" * 99), (2, "http://a b\r\nc", "x" * 99), (1, "u", None), (6, "u", ""),
    (None, "u", "y" * 200), (8, "u", "y" * 200), (None, "u", "z" * 150), (None, "u", "z" * 150), (7, "u", "q" * 120), (7, "u", "q" * 120), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "é" * 49 + "e"),
    (13, "u", LONG), (14, "u", LONG + "!"), (15, "u", LONG), (16, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 10), (-4, "u", "negative" * 20), (-5, "u", "negative" * 20),
]


def expected(pages):
    rows = [(p, (t or "").encode()) for p, _, t in pages]
    out, seen = [], set()
    for p, data in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        again = len(data) >= 100 and data in seen
        seen.add(data)
        first = min((q for q, d in rows if d == data), key=lambda q: (q is None, q or 0))
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def table(spark, pages):
    return spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, row int").repartition(3)


@pytest.mark.parametrize("broadcast_rows,archive_bytes", [(10, 1 << 26), (0, 1)])
def test_round_trip(spark, broadcast_rows, archive_bytes):
    pages = PAGES + [(100 + i, "u", f"common {i % 7} " * 30) for i in range(300)]
    archives = warc.write_archives(table(spark, pages), broadcast_rows=broadcast_rows, archive_bytes=archive_bytes)
    records = warc.read_archives(archives).cache()
    got = [(r.page_id, r.payload_bytes, r.payload_digest[7:], r.record_type, r.to) for r in records.withColumn("page_id", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()]
    assert sorted(got, key=repr) == expected(pages)
    by_id = {r.record_id: r for r in records.collect()}
    assert len(by_id) == len(pages)
    for r in by_id.values():
        if r.record_type == "revisit":
            assert by_id[r.refers_to].record_type == "response" and by_id[r.refers_to].payload_digest == r.payload_digest and not r.payload
        else:
            assert len(r.payload) == r.payload_bytes
    assert archives.agg({"records": "sum"}).first()[0] == len(pages)
    assert {r.target_uri for r in by_id.values()} >= {"about:blank", "http://a%20b%0D%0Ac"}


def test_query_columns_and_empty_table(spark):
    assert sorted((tuple(r) for r in warc.archived_pages(table(spark, PAGES)).collect()), key=repr) == expected(PAGES)
    assert warc.archived_pages(table(spark, PAGES).limit(0)).collect() == []


def test_dictionary_leads_and_each_record_is_a_frame(spark, tmp_path):
    pages = [(i, f"http://host/{i}", f"<html><head><title>Page {i}</title></head>" + " ".join(f"word{(i * k) % 97}" for k in range(150))) for i in range(400)]
    (archive,) = warc.write_archives(table(spark, pages).coalesce(1), folder=f"file://{tmp_path}/deep/er").collect()
    data = open(archive.archive.removeprefix("file://"), "rb").read()
    assert len(data) == archive.bytes and struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    found = list(warc.frames(io.BytesIO(data).read))
    assert len(found) == 400 and found[0][0] > 8 and all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:])) and found[-1][0] + found[-1][1] == len(data)
    assert len(data) < sum(len(zstandard.ZstdCompressor().compress(f[2])) for f in found)
    with pytest.raises(warc.Broken):  # without the dictionary nothing can be decoded
        list(warc.frames(io.BytesIO(data[found[0][0] :]).read))


def good(**change):
    return warc.record(1, 2, "http://u", b"some payload", change.pop("size", 12), hashlib.sha256(b"some payload").hexdigest(), change.pop("first", None))


BROKEN = {
    "version": good().replace(b"WARC/1.1", b"WARC/0.9"), "no warc-date": good().replace(b"WARC-Date", b"X-Date"), "length is": good().replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1),
    "block has": good()[:-1], "block digest": good().replace(b"some payload", b"same payload"), "payload has": good(size=13), "do not end": b"WARC/1.1\r\nWARC-Type: response\r\n",
    "without a name": good().replace(b"WARC-Date:", b"WARC Date:"), "two": good() + good(), "revisit of nothing": good(first="<x>").replace(b"WARC-Refers-To", b"X-Refers-To"),
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_records(name):
    with pytest.raises(warc.Broken, match="block has" if name == "two" else name):
        warc.parsed(BROKEN[name])
    assert warc.parsed(good())["payload"] == b"some payload"


def test_foreign_archives(spark, tmp_path):
    """Plain dictionaries, other record types, folded headers, skippable frames between records, broken frames."""
    frame = zstandard.ZstdCompressor().compress
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX-Note: folded\r\n over lines\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    skip = struct.pack("<II", 0x184D2A51, 5) + b"12345"
    contents = {"a": frame(info) + skip + frame(good()), "b": frame(good()) + frame(b"no record") + frame(good()), "c": frame(good()) + frame(good())[:-3], "d": frame(good()) + b"\0\0\0\0 rest", "e": b"", "f": skip[:6]}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    archives = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in contents], "archive string")
    rows = sorted((r.archive[-1], r.offset, r.record_type, (r.error or "")[:11]) for r in warc.read_archives(archives, errors="keep").fillna("-").collect())
    size = len(frame(good()))
    assert [(a, t, e) for a, _, t, e in rows if e == "-"] == [("a", "warcinfo", "-"), ("a", "response", "-"), ("b", "response", "-"), ("b", "response", "-"), ("c", "response", "-"), ("d", "response", "-")]
    assert [(a, e) for a, _, _, e in rows if e != "-"] == [("b", "WARC header"), ("c", "the archive"), ("d", "the frame a"), ("f", "the archive")]
    assert ("b", size, "-", "WARC header") in rows
    with pytest.raises(Exception, match="the archive ends within"):
        warc.read_archives(archives.where("archive like '%c'")).collect()
