"""WARC archives as seekable Zstandard bundles: independent frames of records, a seek table at the end, and an index of records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, shared_dir

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tidemark:page:"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Bundles beyond this number share tasks.
MOST_TASKS = 20_000
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: bytes, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or (payload None) a revisit with the HTTP head alone."""
    name = "null" if page_id is None else str(page_id)
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or URN + name
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:]) | {"version": lines[0]}
    start, size = end + 4, int(head["Content-Length"])
    return head, data[start : start + size], start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the seek table at the end of a bundle of `size` bytes."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    each = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * each)
    table, out, at = file.read(n * each), [], 0
    for k in range(n):
        packed, whole = struct.unpack_from("<II", table, k * each)
        out.append((at, packed, whole))
        at += packed
    return out


class _Bundles:
    """Writes records into bundles of a folder, frame by frame, and gathers the index rows of closed frames."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int) -> None:
        import zstandard

        self.fs, self.at = pa.fs.FileSystem.from_uri(folder)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self.file, self.rows = None, []
        self.held, self.size = [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.held.append((page_id, self.size, data))
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self.frame()

    def frame(self) -> None:
        if not self.held:
            return
        if self.file is None:
            self.name, self.frames, self.end = f"{uuid.uuid4().hex}.warc.zst", [], 0
            self.file = self.fs.open_output_stream(f"{self.at}/{self.name}", compression=None)
        packed = self.pack(b"".join(d for _, _, d in self.held))
        self.file.write(packed)
        for page_id, start, data in self.held:
            self.rows.append((page_id, f"{URN}{'null' if page_id is None else page_id}", f"{self.folder}/{self.name}", len(self.frames), self.end, len(packed), start, len(data)))
        self.frames.append((len(packed), self.size))
        self.end += len(packed)
        self.held, self.size = [], 0
        if self.end >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        self.frame()
        if self.file is not None:
            self.file.write(seek_table(self.frames))
            self.file.close()
            self.file = None


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per row of pages into bundles under `folder` (a fresh shared one) and returns the index, one row per record.

    Of rows with equal payloads that with the largest id is the response, the others revisit it; the payload is found by its
    SHA-1, and only digests and ids meet in the aggregation, so a payload of very many rows costs a row per task; the join
    back splits such a payload's rows. Null payloads are empty, null urls become the record's name. Null ids are least;
    several rows with the winning id and payload are each a response, and if all ids of a payload are null, so is each row.
    Bundles get new names at each attempt: the index, written to the shared folder, has those of the attempts that counted.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).try_cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    last = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha", "last")
    to = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(last, "sha", "left").select("page_id", "url", F.unhex("sha").alias("digest"), F.octet_length("payload").cast("long").alias("size"), to.alias("refers_to"), F.when(to.isNull(), F.col("payload")).alias("payload"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1], recursive=True)
        out = _Bundles(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, digest, size, refers_to, body = (c[k].as_py() for c in batch.columns)
                out.add(page_id, record(page_id, url, body, digest, size, refers_to, date))
            yield _index(out.rows)
            out.rows = []
        out.close()
        yield _index(out.rows)

    return cut(rows.mapInArrow(task, INDEX))


def _index(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ") for x in INDEX.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _facts(head: dict[str, str], block: bytes) -> tuple:
    number = lambda s: None if s in (None, f"<{URN}null>") else int(s[len(URN) + 1 : -1])
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = head["WARC-Type"] == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return number(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), whole


def read_archives(index: DataFrame) -> DataFrame:
    """A row per record of the bundles that the index names, read from their seek tables on; intact: its payload has its digest.

    Each bundle is a task of its own, as bundles are large, and is read frame by frame; memory follows the largest frame.
    An empty index gives no rows. Rows that repeat a page are records of their own; other columns of index are ignored.
    """
    bundles = cut(index.select("bundle").distinct())
    bundles = bundles.repartition(max(1, min(bundles.count(), MOST_TASKS)))  # a number that is asked for is not coalesced

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import zstandard

        names = [x.split(" ") for x in READ.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    for start, packed, whole in frames_of(file, file.size()):
                        file.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=whole)
                        rows, end = [], 0
                        while end < len(data):
                            head, block, end = parse(data, end)
                            rows.append(_facts(head, block))
                        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])

    return bundles.mapInArrow(task, READ)


def fetch(index: DataFrame) -> DataFrame:
    """(page_id, payload) of the records in these index rows, by seeking: only their frames are read. Revisits have null payloads."""

    def make(cols):
        import pyarrow.fs
        import zstandard

        out, held = [], {}
        for path, start, packed, at in zip(*(cols[n].to_pylist() for n in ("bundle", "frame_start", "frame_bytes", "record_start")), strict=True):
            if (path, start) not in held:
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    file.seek(start)
                    held = {(path, start): zstandard.ZstdDecompressor().decompress(file.read(packed))}
            head, block, _ = parse(held[path, start], at)
            out.append(block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None)
        return {"page_id": cols["page_id"], "payload": out}

    return in_arrow(index.select("page_id", "bundle", "frame_start", "frame_bytes", "record_start"), make, "page_id long, payload binary")
