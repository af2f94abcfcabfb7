"""WARC archives compressed with Zstandard: one frame for each record, a dictionary in a leading skippable frame.

Writing: payload digests are aggregated to the largest id of each payload that stands
more than once; only that table is joined with the pages, so pages stay where they are
while it is small enough to broadcast (its written size says so; else Spark joins by
shuffle and splits a hot digest), and each task writes archives of bounded size. Reading:
the dictionary is loaded from the skippable frame, frames are found by their block
headers, each frame is decoded alone, and version line, header fields, lengths and
digests are validated.

An archive is a row (path, content), which is also what Spark's binaryFile reader gives
for files: save_archives() writes .warc.zst files, and archives from elsewhere are read
the same way. Records of other types (warcinfo, request, metadata, ...) have their block
as payload; ids of other forms give a null key, with the id in record_uri. A record that
breaks the format becomes a row with an error and null fields, and so does the rest of
an archive that cannot be cut into frames.

Null html is an empty payload; null url is left out. A null id takes part in no revisit.
Repeated rows of the id that holds the response are responses too. An empty table gives
no archives. A record of any length is one frame; archives end after ARCHIVE_BYTES. Keys
must be integers; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import cut, integer_key, named

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES, LEVEL = 8 << 20, 16 << 10, 1 << 20, 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class InvalidArchive(ValueError):
    """An archive or record that breaks the format."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return "<urn:x-page:none>" if page is None else f"<urn:x-page:{page}>"


def page_of(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d{1,19})>", uri.strip())
    return int(found[1]) if found and -(2**63) <= int(found[1]) < 2**63 else None


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone; both headers give the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.encode('unicode_escape').decode()}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields, HTTP payload and its length of a record; raises InvalidArchive if headers, lengths or digest don't hold."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise InvalidArchive("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise InvalidArchive(f"not a header field: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise InvalidArchive(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise InvalidArchive("the block is not as long as its header says")
    block = rest[:-4]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:].upper() != digest_of(block):
        raise InvalidArchive("the block's digest is another")
    if fields["warc-type"] not in ("response", "revisit") or not fields.get("content-type", "application/http").lower().startswith("application/http"):
        return fields | {"payload": block, "payload_bytes": len(block)}
    http, found, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("latin-1").split("\r\n")
    if not found or not status.startswith("HTTP/"):
        raise InvalidArchive("no HTTP header")
    own = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
    length = own.get("content-length", str(len(payload)))
    if not length.isdigit():
        raise InvalidArchive("no payload length")
    if fields["warc-type"] == "response":
        if len(payload) != int(length):
            raise InvalidArchive("the payload is not as long as its header says")
        said = fields.get("warc-payload-digest", "")
        if said.startswith("sha1:") and said[5:].upper() != digest_of(payload):
            raise InvalidArchive("the payload's digest is another")
    elif payload or "warc-profile" not in fields:
        raise InvalidArchive("a revisit with a payload or without a profile")
    return fields | {"payload": payload, "payload_bytes": int(length)}


def build_archive(records: list[bytes]) -> bytes:
    """The dictionary, trained on the first records, in a skippable frame; then a frame for each record. Too few records to train on: no dictionary."""
    import zstandard

    dictionary, lead = None, b""
    sample, size = [], 0
    for r in records:
        if size > TRAIN_BYTES:
            break
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
    if len(sample) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
            lead = struct.pack("<II", SKIPPABLE, len(dictionary.as_bytes())) + dictionary.as_bytes()
        except zstandard.ZstdError:
            dictionary = None
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True).compress
    return lead + b"".join(compress(r) for r in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at this offset ends, from its header and block headers."""
    try:
        flags = data[at + 4]
        at += 5
        single = flags & 0x20
        at += (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while True:
            head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except IndexError:
        raise InvalidArchive("a frame is cut off") from None
    at += 4 if flags & 4 else 0
    if at > len(data):
        raise InvalidArchive("a frame is cut off")
    return at


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame."""
    import zstandard

    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise InvalidArchive("the dictionary is cut off")
        held = bytes(data[8 : 8 + size])
        if held[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
            held = zstandard.ZstdDecompressor().decompress(held)
        dictionary, at = zstandard.ZstdCompressionDict(held), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if at + 4 > len(data):
            raise InvalidArchive("a frame is cut off")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise InvalidArchive("no frame where one should begin")
        end = frame_end(data, at)
        try:
            yield decoder.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise InvalidArchive(str(e)) from None
        at = end


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(path, content): archives of all pages, written into the shared folder and read from there."""
    kind = integer_key(pages, key)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [digest_of((x.as_py() or "").encode()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "digest"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in digests(batches):
            yield batch.select([0, 2])

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]), pa.array([build_archive(held)], pa.binary())], ["path", "content"])

        for batch in batches:
            page, u, h, digest, largest = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                own, most = page[i].as_py(), largest[i].as_py()
                refers = most if own is not None and most is not None and most != own else None
                held.append(build_record(own, u[i].as_py(), (h[i].as_py() or "").encode(), digest[i].as_py(), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    own = pages.select(named(key).alias("page"), named(url).alias("url"), named(html).alias("html"))
    met = own.select("page", "html").mapInArrow(digested, f"page {kind}, digest string").groupBy("digest").agg(F.max("page").alias("largest"), F.count("page").alias("n"))
    repeated = cut(met.where("n > 1").select("digest", "largest"), "repeated")
    written = own.mapInArrow(digests, f"page {kind}, url string, html string, digest string").join(repeated, "digest", "left").select("page", "url", "html", "digest", "largest")
    return cut(written.mapInArrow(archives, "path string, content binary"), "warc")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file into a folder that all executors reach (any URI that pyarrow knows); gives (path, n_bytes) of the files.

    A file is written beside its place and then moved, so that a repeated task leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        for batch in batches:
            paths, sizes = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                part = f"{root}/.{path}-{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, f"{root}/{path}")
                paths.append(f"{folder.rstrip('/')}/{path}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return cut(archives.select("path", "content").mapInArrow(run, "path string, n_bytes bigint"), "saved")


RECORDS = "payload_bytes bigint, payload_digest string, record_type string"


def read_records(archives: DataFrame, key: str = "page_id", kind: str = "bigint") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, url, payload, record_uri, error) of all records of (path, content) rows."""

    def row_of(record: bytes) -> tuple:
        f = parse_record(record)
        uri = f.get("warc-target-uri")
        own = page_of(f["warc-record-id"])
        if own is not None or f["warc-record-id"] == record_id(None):
            uri = None if uri is None else uri.encode().decode("unicode_escape")
        digest = f.get("warc-payload-digest")
        return own, f["payload_bytes"], None if digest is None else digest.removeprefix("sha1:"), f["warc-type"], page_of(f["warc-refers-to"]) if "warc-refers-to" in f else None, uri, f["payload"], f["warc-record-id"], None

    def rows_of(content: bytes) -> Iterator[tuple[tuple, int]]:
        try:
            for record in read_archive(content):
                try:
                    yield row_of(record), len(record)
                except InvalidArchive as e:
                    yield (*[None] * 8, str(e)), len(record)
        except InvalidArchive as e:
            yield (*[None] * 8, f"the rest of the archive: {e}"), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                size = 0
                for row, n in rows_of(content.as_py() or b""):
                    out.append(row)
                    size += n
                    if size > ARCHIVE_BYTES:
                        yield _records(out, names, types)
                        out, size = [], 0
                if out:
                    yield _records(out, names, types)

    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "record_uri", "error"]
    id_type = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind]
    types = [id_type, pa.int64(), pa.string(), pa.string(), id_type, pa.string(), pa.binary(), pa.string(), pa.string()]
    return archives.select("content").mapInArrow(run, f"`{key}` {kind}, {RECORDS}, refers_to {kind}, url string, payload binary, record_uri string, error string")


def _records(out: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
