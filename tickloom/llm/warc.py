"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole
records, followed by the seek table of the seekable format: a skippable frame
with the compressed and decompressed size of each frame. An index table maps
each record to its bundle, frame and offset within the decompressed frame, so a
record is read by decompressing its frame alone.

Bundles are written to the shared folder under names of their own per task
attempt; the index is a written table and names only bundles of attempts that
were committed, so repeated or lost tasks leave at most files nobody refers to.

Payloads of at least ``least_bytes`` that agree in SHA-1 are stored once: with
the smallest page id as a response, otherwise as revisits that refer to it and
carry digest and length. A null payload is empty. Rows with the smallest id and
the same payload are all responses; a null id comes after all others, and is a
response only if no row with an id has its payload. Line breaks in URLs are
dropped; a null URL is left out. An empty table gives empty results; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import lean, narrowed, new_folder, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
STRETCH = 16
#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = "<urn:page:{}>"
INDEX = "bundle string, page_id long, frame int, start long, size long"


def file_system(uri: str):
    """(file system, path) of a folder or file, local without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header block only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD.format(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {RECORD.format(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is cut off")
    return fields, block


class Bundle:
    """A bundle being written."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = file_system(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.packer = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.waiting, self.size, self.bytes = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame)."""
        place = len(self.frames), self.size
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.waiting:
            frame = self.packer.compress(b"".join(self.waiting))
            self.file.write(frame)
            self.frames.append((len(frame), self.size))
            self.bytes += len(frame)
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of the frames of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - n * width)
    table, out, at = file.read(n * width), [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, size))
        at += packed
    return out


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes bundles below ``folder`` and returns their index (INDEX), itself a written table."""
    rows = narrowed(pages, page_id=F.col(id_col).cast("long"), url=url_col, payload=F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")))
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    rows = rows.join(firsts, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, places = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            page, frame, start, size = zip(*places, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([bundle.uri] * len(page)), pa.array(page, pa.int64()), pa.array(frame, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["bundle", "page_id", "frame", "start", "size"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                bundle = bundle or Bundle(folder)
                data = record(page, url, payload, refers)
                places.append((page, *bundle.add(data), len(data)))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield done()
                    bundle, places = None, []
        if bundle:
            yield done()

    return written(rows.mapInArrow(lean(bundles), INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Of each record of an index: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null of revisits).

    A task reads stretches of STRETCH frames of a bundle, frame by frame; the index is small, so
    the number of tasks is set here and not left to its size.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table = pa.Table.from_batches(batches)
        fs, path = file_system(table.column("bundle")[0].as_py())
        out, unpack = [], zstandard.ZstdDecompressor()
        wanted = table.sort_by([("frame", "ascending"), ("start", "ascending")])
        with fs.open_input_file(path) as file:
            frames, at, data = seek_table(file), -1, b""
            for frame, start, size in zip(*(wanted.column(c).to_pylist() for c in ("frame", "start", "size")), strict=True):
                if frame != at:
                    place, packed, whole = frames[frame]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=RECORDS)
                        out = []
                    file.seek(place)
                    at, data = frame, unpack.decompress(file.read(packed), max_output_size=whole)
                out.append(row(data[start : start + size]))
        yield pa.RecordBatch.from_pylist(out, schema=RECORDS)

    stretch = F.floor(F.col("frame") / STRETCH).alias("stretch")
    dealt = index.select("bundle", stretch, "frame", "start", "size").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bundle", "stretch")
    return dealt.groupBy("bundle", "stretch").applyInArrow(lean(fetch), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def row(data: bytes) -> dict:
    """What a record says, with the payload's length and digest checked against its header where the payload is there."""
    fields, block = parsed(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.partition(b": ")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda urn: None if urn is None or urn == RECORD.format(None) else int(urn.removeprefix("<urn:page:").removesuffix(">"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError("a payload does not agree with its digest")
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages written to new bundles in the shared folder and read back."""
    return read(write(pages, new_folder(pages.sparkSession, "warc"), least_bytes))
