"""WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9
#: Uncompressed bytes after which a frame, and a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


class BundleWriter:
    """Groups records into independent frames; close() appends the seek table as a skippable frame."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, record_id: str, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.frame_bytes:
            self._end_frame()
        self.index.append((record_id, len(self.sizes), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.bytes += len(record)

    def _end_frame(self) -> None:
        if self.open:
            self.frames.append(self.compressor.compress(b"".join(self.open)))
            self.sizes.append((len(self.frames[-1]), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        """The bundle, and for each record its id, frame, offset inside the frame's content and length."""
        self._end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        table = entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table, self.index


class BundleReader:
    """Finds frames by the footer's seek table and reads one without those before it."""

    def __init__(self, bundle: bytes):
        count, descriptor, magic = struct.unpack("<IBI", bundle[-FOOTER_BYTES:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if descriptor & 0x80 else 8
        at = len(bundle) - FOOTER_BYTES - count * width
        if struct.unpack("<II", bundle[at - 8 : at]) != (SKIPPABLE_MAGIC, count * width + FOOTER_BYTES):
            raise ValueError("the seek table is damaged")
        self.bundle, self.starts, self.sizes, start = bundle, [], [], 0
        for i in range(count):
            packed, full = struct.unpack("<II", bundle[at + i * width : at + i * width + 8])
            self.starts.append((start, packed))
            self.sizes.append(full)
            start += packed

    def frame(self, number: int) -> bytes:
        start, packed = self.starts[number]
        return zstandard.ZstdDecompressor().decompress(self.bundle[start : start + packed], max_output_size=self.sizes[number])

    def records(self, index: Iterable[tuple[str, int, int, int]]) -> Iterator[tuple[str, bytes]]:
        """Records by their places, in the order of frames; one frame is held at a time."""
        held, content = -1, b""
        for record_id, frame, offset, length in sorted(index, key=lambda x: x[1:3]):
            if frame != held:
                held, content = frame, self.frame(frame)
            yield record_id, content[offset : offset + length]


def _header(value: object) -> str:
    """A header's value on one line: control characters of foreign text would end it."""
    return "".join(c if c >= " " and c != "\x7f" else " " for c in str(value if value is not None else "")).strip()


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 response with the payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers by lower-case name, its HTTP headers as `http`, and its payload; damaged records raise ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    block = rest[: int(out["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{hashlib.sha1(block).hexdigest()}" != out["warc-block-digest"]:
        raise ValueError(f"damaged record {out.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    if out["warc-type"] == "response" and f"sha1:{hashlib.sha1(payload).hexdigest()}" != out["warc-payload-digest"]:
        raise ValueError(f"the payload of {out.get('warc-record-id')} differs from its digest")
    return out


_BUNDLES = "archive binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def write_bundles(pages: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(archive binary, index) of pages (page_id, url, html): bundles of about bundle_bytes, written to the shared folder.

    Of records with equal payloads of at least 1000 bytes, that with the largest page_id
    is the response and others revisit it. Only digests that repeat take part in the
    join, which a hot payload doesn't skew for its rows are not grouped. Rows that repeat
    the largest page_id are all responses. Null html is an empty payload; a null page_id
    counts as smaller than any other, and a payload that only such pages have is never
    revisited. A payload over the frame's size gets a frame of its own. No rows give no
    bundles; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    long = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.col("digest").alias("same"))
    originals = long.groupBy("same").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").select("same", "original")
    joined = rows.join(originals, F.when(F.octet_length("html") >= REVISIT_BYTES, F.col("digest")) == F.col("same"), "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("original")), None).otherwise(F.col("original"))

    def write(batches):
        def done(writer: BundleWriter) -> pa.RecordBatch:
            archive, index = writer.close()
            keys = ("record_id", "frame", "offset", "length")
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary()), pa.array([[dict(zip(keys, x, strict=True)) for x in index]], kind)], names=["archive", "index"])

        writer = BundleWriter(frame_bytes)
        for b in batches:
            for page_id, url, text, digest, original in zip(*(c.to_pylist() for c in b.columns), strict=True):
                refers_to = None if original is None else f"urn:page:{original}"
                writer.add(f"urn:page:{'' if page_id is None else page_id}", record(f"urn:page:{'' if page_id is None else page_id}", url, text.encode("utf-8", "surrogatepass"), digest, refers_to))
                if writer.bytes >= bundle_bytes:
                    yield done(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield done(writer)

    return written(joined.select("page_id", "url", "html", "digest", refers.alias("original")).mapInArrow(write, _BUNDLES))


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary())])


def read_bundles(bundles: DataFrame, record_ids: list[str] | None = None, payloads: bool = False) -> DataFrame:
    """A row per record of the bundles, or of those named: read through seek table and index, digests checked.

    payload_bytes and payload_digest are of the full payload, which a revisit has in its
    headers. payload is null without `payloads`, and for revisits.
    """
    small_batches(bundles.sparkSession)
    wanted = None if record_ids is None else set(record_ids)
    number = lambda x: int(x.strip("<>").removeprefix("urn:page:")) if x and x.strip("<>") != "urn:page:" else None

    def read(batches):
        for b in batches:
            for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: dict[str, list] = {n: [] for n in _RECORDS.names}
                places = [(x["record_id"], x["frame"], x["offset"], x["length"]) for x in index if wanted is None or x["record_id"] in wanted]
                for (_, frame, offset, length), (record_id, data) in zip(sorted(places, key=lambda x: x[1:3]), BundleReader(archive).records(places), strict=True):
                    found = parse(data)
                    if found["warc-record-id"] != f"<{record_id}>":
                        raise ValueError(f"the index leads from {record_id} to {found['warc-record-id']}")
                    row = (number(record_id), int(found["http"]["content-length"]), found["warc-payload-digest"].removeprefix("sha1:"), found["warc-type"], number(found.get("warc-refers-to")), found["warc-target-uri"], frame, offset, length, found["payload"] if payloads and found["warc-type"] == "response" else None)
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_RECORDS)

    return bundles.select("archive", "index").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, frame int, offset long, length long, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as WARC bundles, then read every record back: see write_bundles and read_bundles."""
    return read_bundles(write_bundles(pages)).drop("payload")
