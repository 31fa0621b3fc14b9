"""WARC archives in Zstandard: one frame per record, behind a skippable frame that holds the dictionary.

write_archives() writes a response record per row; of rows with equal payloads only the first is a response, the others are
revisits that name it and carry no payload. Each archive's dictionary is trained on its own first records (at most SAMPLE_BYTES) and leads
the archive in a skippable frame; where there are too few records to train on, there is none. read_archives() takes any such archive: it loads the
dictionary, decodes frame by frame, each of which must be one whole record, and validates version, required headers, lengths and digests.

Scale. Tasks stream: a writer begins a new archive after ARCHIVE_BYTES, a reader holds one record and a few MB, and archives are
dealt out one by one. Payloads move between machines only if more than BROADCAST_ROWS payloads repeat; even then copies of payloads that make up
a thousandth of the rows (so fewer than a thousand payloads, which are broadcast) stay where they are. Files are written through the file systems that pyarrow
knows by their URI, with a name of their own for every attempt; the table of archives that Spark commits names those that count, so a lost
or doubled task leaves files that nobody reads.

Cases. Null payload: as empty. Null id: after all others when the first of equal payloads is chosen. Repeated rows: a record each; of rows with
equal id and payload one is the response. Null or empty address: about:blank; blanks and control characters in it are percent-encoded.
Empty table: no archives. Extra columns are ignored. A broken record raises an error, or with errors="keep" is a row with its error;
past a broken frame the archive can't be read on.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import BATCH_BYTES, scratch, text_bytes, written

#: Payloads below this are never revisited.
LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: Repeated payloads (about 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"

# Of the WARC and Zstandard formats.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORD = "archive string, offset long, frame_bytes long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("frame_bytes", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
_ARCHIVE = "archive string, records long, bytes long"


class Broken(ValueError):
    """What is wrong with a record."""


def record_id(page: int | None, row: int) -> str:
    return f"<urn:folioscan:page:{'' if page is None else page}:{row}>"


def page_of(column: str):
    """The page id in a record id."""
    return F.regexp_extract(column, r"^<urn:folioscan:page:(-?\d*):\d+>$", 1).try_cast("long")


def record(page: int | None, row: int, url: str | None, payload: bytes, size: int, digest: str, first: str | None, date: str = DATE) -> bytes:
    """A WARC record: a revisit of the record named first, or a response with the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first else http + payload
    headers = {
        "WARC-Type": "revisit" if first else "response", "WARC-Record-ID": record_id(page, row), "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "") or "about:blank",
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": first} if first else {}),
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _split_headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    """(first line, headers by lower-cased name, what follows)."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise Broken(f"{what} headers do not end")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Broken(f"{what} header without a name: {line[:80]!r}")
        headers.setdefault(name.lower(), value.strip())
    return first, headers, rest


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise Broken(f"{what} length is {value!r}")
    return int(value)


def _check_digest(value: str | None, data: bytes, what: str) -> None:
    """Digests of kinds other than SHA-256 in hex are not checked."""
    if value and re.fullmatch(r"sha256:[0-9a-fA-F]{64}", value) and value[7:].lower() != hashlib.sha256(data).hexdigest():
        raise Broken(f"{what} digest differs")


def parsed(data: bytes) -> dict:
    """The fields of the one WARC record that data is; raises Broken if it is none."""
    version, headers, rest = _split_headers(data, "WARC")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise Broken(f"version is {version[:20]!r}")
    for name in REQUIRED:
        if not headers.get(name):
            raise Broken(f"no {name}")
    size, kind = _length(headers, "block"), headers["warc-type"].lower()
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken(f"block has {max(0, len(rest) - 4)} bytes, not {size}, or no end")
    block = rest[:size]
    _check_digest(headers.get("warc-block-digest"), block, "block")
    payload, full, digest = block, size, headers.get("warc-payload-digest")
    if headers.get("content-type", "").lower().startswith("application/http"):
        _, inner, payload = _split_headers(block, "HTTP")
        full = _length(inner, "payload") if "content-length" in inner or kind == "revisit" else len(payload)
    if kind == "revisit":
        if not headers.get("warc-refers-to") or not digest:
            raise Broken("revisit of nothing")
        payload = b""
    else:
        if len(payload) != full:
            raise Broken(f"payload has {len(payload)} bytes, not {full}")
        _check_digest(digest, payload, "payload")
        digest = digest if digest and not digest.lower().startswith("sha256:") else f"sha256:{hashlib.sha256(payload).hexdigest()}"
    return {
        "record_type": kind, "record_id": headers["warc-record-id"], "target_uri": headers.get("warc-target-uri"), "date": headers["warc-date"],
        "refers_to": headers.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": full, "payload": payload,
    }


class _Archive:
    """An archive being written: the first records wait for the dictionary that is trained on them."""

    def __init__(self, files: pyarrow.fs.FileSystem, folder: str, name: str):
        files.create_dir(folder, recursive=True)
        self.out, self.waiting, self.held, self.bytes, self.records, self.to = files.open_output_stream(f"{folder}/{name}", compression=None), [], 0, 0, 0, None

    def _begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
        except zstandard.ZstdError:  # too few or too small records
            trained = None
        if trained:
            frame = zstandard.ZstdCompressor().compress(trained.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self.to = zstandard.ZstdCompressor(dict_data=trained) if trained else zstandard.ZstdCompressor()
        for data in self.waiting:
            self._put(self.to.compress(data))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.to:
            self._put(self.to.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> None:
        if not self.to:
            self._begin()
        self.out.close()


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder)
        task, now, k = TaskContext.get(), None, 0

        def closed() -> pa.RecordBatch:
            now.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [now.records], "bytes": [now.bytes]})

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "row", "url", "payload", "size", "digest", "first_page", "first_row"))
            for values in zip(*columns, strict=True):
                page, row, url, payload, size, digest, first_page, first_row = (v.as_py() for v in values)
                if not now:
                    name = f"pages-{task.partitionId():06d}-{k:03d}-{task.taskAttemptId()}.warc.zst"
                    now = _Archive(files, path, name)
                now.add(record(page, row, url, payload or b"", size, digest, None if first_row is None else record_id(first_page, first_row), date))
                if now.bytes >= archive_bytes:
                    yield closed()
                    now, k = None, k + 1
        if now:
            yield closed()

    return run


def frames(read) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, decoded bytes) of each frame that is not skippable; read(n) gives up to n further bytes. Raises Broken where the archive can't be read on."""
    data, offset, decoder = read(READ_BYTES), 0, zstandard.ZstdDecompressor()

    def upto(n: int) -> bytes:
        nonlocal data
        while len(data) < n and (more := read(max(READ_BYTES, n - len(data)))):
            data += more
        if len(data) < n:
            raise Broken(f"the archive ends within the frame at {offset}")
        return data

    while data or (data := read(READ_BYTES)):
        magic = struct.unpack("<I", upto(4)[:4])[0]
        if magic in SKIPPABLE:
            end = 8 + struct.unpack("<I", upto(8)[4:8])[0]
            content = upto(end)[8:end]
            if magic == DICTIONARY_MAGIC and offset == 0:
                try:
                    plain = zstandard.ZstdDecompressor().decompressobj().decompress(content) if content[:4] == struct.pack("<I", FRAME_MAGIC) else content
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
                except zstandard.ZstdError as e:
                    raise Broken(f"the dictionary can't be read: {e}") from None
            data, offset = data[end:], offset + end
            continue
        one, parts, size = decoder.decompressobj(), [], 0
        try:
            while True:
                parts.append(one.decompress(data))
                size += len(data)
                if one.eof:
                    break
                data = read(READ_BYTES)
                if not data:
                    raise Broken(f"the archive ends within the frame at {offset}")
        except zstandard.ZstdError as e:
            raise Broken(f"the frame at {offset} can't be decoded: {e}") from None
        data = one.unused_data
        size -= len(data)
        yield offset, size, b"".join(parts)
        offset += size


def _reader(payloads: bool, keep: bool):
    def rows(archive: str) -> Iterator[dict]:
        files, path = pyarrow.fs.FileSystem.from_uri(archive)
        at = 0
        with files.open_input_stream(path, compression=None) as source:
            try:
                for at, size, data in frames(source.read):
                    row = {"archive": archive, "offset": at, "frame_bytes": size}
                    try:
                        row |= parsed(data)
                    except Broken as e:
                        if not keep:
                            raise Broken(f"{archive} at {at}: {e}") from None
                        row["error"] = str(e)
                    if not payloads:
                        row["payload"] = None
                    yield row
            except Broken as e:
                if not keep:
                    raise Broken(f"{archive}: {e}") from None
                yield {"archive": archive, "offset": at, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                held, size = [], 0
                for row in rows(archive):
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if size >= BATCH_BYTES or len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, _RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORD)

    return run


def _with_first(rows: DataFrame, least_bytes: int, broadcast_rows: int) -> DataFrame:
    """rows with first_page and first_row: the response that a revisit refers to, else null; revisits lose their payload."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), first).where("copies > 1")
    groups = written(groups.select("digest", "copies", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")))
    if groups.count() <= broadcast_rows:
        found = rows.join(F.broadcast(groups), "digest", "left")
    else:
        often = max(2, rows.count() // 1000)  # fewer than 1001 payloads have that many copies
        found = rows.join(F.broadcast(groups.where(F.col("copies") >= often)), "digest", "left")
        others = found.where("copies is null").drop("copies", "first_page", "first_row").join(groups.where(F.col("copies") < often), "digest", "left")
        found = found.where("copies is not null").unionByName(others)
    again = (F.col("size") >= least_bytes) & F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return found.select(
        "page_id", "row", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), "url", "size", "digest", F.when(again, F.col("first_page")).alias("first_page"), F.when(again, F.col("first_row")).alias("first_row")
    )


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS, date: str = DATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(archive, records, bytes): the archives that hold a record per row of pages. folder: a URI that all machines reach; else one in the shared folder."""
    payload = text_bytes(payload_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = written(rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest")))
    return written(_with_first(rows, least_bytes, broadcast_rows).mapInArrow(_writer(folder or scratch(pages.sparkSession), archive_bytes, date), _ARCHIVE))


def read_archives(archives: DataFrame, payloads: bool = True, errors: str = "raise") -> DataFrame:
    """The records of archives (archive: their URIs), as RECORD says. payloads: whether their bytes are wanted. errors: "raise" or "keep"."""
    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(_reader(payloads, errors == "keep"), RECORD)


def archived_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): what the archives of pages hold, read back."""
    records = read_archives(write_archives(pages), payloads=False)
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))
