"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently of each other. A bundle ends with a skippable frame
that lists the sizes of the others (the public seekable format), so a reader finds and decodes one frame without the
rest. The index maps every record to its bundle, frame and the offset within the decoded frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.common import query, table
from crawlens.scale import cut, shared_dir, spread_lookup

# Fixed values of the seekable format: magic numbers of a skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES = 256 * 1024, 16 * 1024 * 1024
_ID = re.compile(rb"<urn:page:(-?\d*):([0-9a-f]+):(\d+)>")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, decoded) bytes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decoded bytes) of a bundle's frames; ``tail`` is its end, with the whole seek table."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for size, decoded in (struct.unpack_from("<II", tail, len(tail) - 9 - width * (count - i)) for i in range(count)):
        out.append((at, size, decoded))
        at += size
    return out


def open_frames(file) -> Iterator[bytes]:
    """The decoded frames of an open bundle, one at a time."""
    size = file.size()
    file.seek(size - 9)
    count, flags, _ = struct.unpack("<IBI", file.read(9))
    table = 9 + (12 if flags & 0x80 else 8) * count
    file.seek(size - table)
    decoder = zstandard.ZstdDecompressor()
    for at, packed, decoded in frames_of(file.read(table)):
        file.seek(at)
        yield decoder.decompress(file.read(packed), max_output_size=decoded)


def record(page_id, rank: int, key: str, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record; ``refers_to`` is the (page id, rank) of the response that a revisit stands for, or None."""
    name = lambda i, r: f"<urn:page:{'' if i is None else i}:{key[:16]}:{r}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name(page_id, rank)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(*refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records_in(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers (lower-case names) and block of the WARC records in a decoded frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, v in (line.split(b": ", 1) for line in lines[1:])}
        start, size = end + 4, int(head[b"content-length"])
        yield head, data[start : start + size]
        at = start + size + 4


class BundleWriter:
    """Writes records into frames and frames into bundle files of a folder; gives an index row for each record."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.stream, self.frame, self.pending, self.held = None, [], [], 0

    def add(self, page_id, data: bytes) -> None:
        if self.held and self.held + len(data) > self.frame_bytes:
            self.close_frame()
        self.pending.append((page_id, self.held, len(data)))
        self.frame.append(data)
        self.held += len(data)

    def close_frame(self) -> None:
        if not self.frame:
            return
        if self.stream is None:
            # A name of its own for each attempt: the index names only files of attempts that were committed.
            self.file = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.stream, self.frames, self.written, self.rows = self.fs.open_output_stream(f"{self.path}/{self.file}", compression=None), [], 0, []
        packed = self.compressor.compress(b"".join(self.frame))
        self.stream.write(packed)
        self.rows += [(p, self.file, len(self.frames), self.written, o, n) for p, o, n in self.pending]
        self.frames.append((len(packed), self.held))
        self.written += len(packed)
        self.frame, self.pending, self.held = [], [], 0

    def close_bundle(self) -> list[tuple]:
        self.close_frame()
        if self.stream is None:
            return []
        self.stream.write(seek_table(self.frames))
        self.stream.close()
        self.stream = None
        return self.rows

    @property
    def full(self) -> bool:
        return self.stream is not None and self.written >= self.bundle_bytes


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Writes a WARC record for each row into bundles in ``folder`` (any that executors share); returns the index.

    The index is a written table: page_id, file, frame, frame_offset (in the file), offset and length (in the decoded
    frame). Of records with equal payloads of at least ``min_bytes``, the one with the largest id is a response and
    the others revisit it; smaller payloads are all responses. Payloads are held equal by length and SHA-256. Of rows
    with equal id and payload, one counts as the larger. Null html is an empty payload, a null url is left out, a null
    id is smaller than any other; an empty table writes no files. Other columns are ignored.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    # The length precedes the hash as a part of the key; nothing but the key and the id is moved to find the groups.
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("key"), F.octet_length(html).alias("n"))
    groups = cut(
        rows.groupBy("key", "n", "page_id").agg(F.count(F.lit(1)).alias("same"))
        .groupBy("key", "n").agg(F.max(F.struct("page_id", "same")).alias("top"), F.sum("same").alias("members"), F.max("same").alias("most")),
        "payloads",
    )
    if groups.where("most > 1").isEmpty():
        ranked = rows.withColumn("rank", F.lit(1))
    else:  # repeated rows: number those of the same id and payload, the last one is the response
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "n", "page_id").orderBy("url")))
    placed = spread_lookup(
        ranked, groups.select("key", "n", F.col("top.page_id").alias("top_id"), F.col("top.same").cast("int").alias("top_rank"), "members"), ["key"], F.xxhash64("page_id", "rank"), "inner",
        also=["n"], sizes=groups.groupBy("key").agg(F.sum("members").alias("n")),
    )
    revisits = (F.col("n") >= min_bytes) & ~(F.col("page_id").eqNullSafe(F.col("top_id")) & (F.col("rank") == F.col("top_rank")))
    ready = placed.select("page_id", "rank", "key", "url", "html", revisits.alias("revisit"), "top_id", "top_rank").sortWithinPartitions("key", "page_id", "rank")
    schema = ready.select(
        "page_id", F.lit("").alias("file"), F.lit(0).alias("frame"), *(F.lit(0).cast("long").alias(c) for c in ("frame_offset", "offset", "length"))
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        kinds = {"page_id": id_type, "file": pa.string(), "frame": pa.int32(), "frame_offset": pa.int64(), "offset": pa.int64(), "length": pa.int64()}

        def index(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

        for batch in batches:
            for page_id, rank, key, url, html, revisit, top_id, top_rank in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(page_id, record(page_id, rank, key, url, html.encode(), (top_id, top_rank) if revisit else None, date))
                if writer.full:
                    yield index(writer.close_bundle())
        if last := writer.close_bundle():
            yield index(last)

    id_type = pa.int64()
    return cut(ready.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, schema), "warc-index")


def read_archives(folder: str, index: DataFrame, tasks: int = 10_000) -> DataFrame:
    """The records of the bundles that ``index`` names: page_id, record_type, refers_to, payload_bytes, payload_digest, payload.

    The bundles are dealt to up to ``tasks`` tasks by name; a task holds one decoded frame at a time. A response's
    length and digest are taken from its payload and held against its headers; a revisit has them from its headers.
    """
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = index.select("file").distinct()
    dealt = names.repartition(max(1, min(tasks, names.count())), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        page = lambda found: int(found.group(1)) if found and found.group(1) else None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{path}/{name}") as file:
                    for frame in open_frames(file):
                        out = []
                        for head, block in records_in(frame):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            length = int(re.search(rb"Content-Length: (\d+)", http).group(1))
                            kind, told = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                            if kind == "response" and (len(payload) != length or digest(payload) != told):
                                raise ValueError(f"damaged record {head[b'warc-record-id'].decode()}")
                            refers = page(_ID.fullmatch(head.get(b"warc-refers-to", b"")))
                            out.append((page(_ID.fullmatch(head[b"warc-record-id"])), kind, refers, length, told, payload if kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return dealt.mapInArrow(run, schema)


def read_record(folder: str, file: str, frame_offset: int, frame_bytes: int, offset: int, length: int) -> bytes:
    """One record by its place in the index (``frame_bytes``: compressed size, from the seek table); reads one frame."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{file}") as f:
        f.seek(frame_offset)
        return zstandard.ZstdDecompressor().decompressobj().decompress(f.read(frame_bytes))[offset : offset + length]


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY html),
d AS (SELECT page_id, top, strlen(html) AS payload_bytes,
  array_to_string(list_transform(string_split(sha1(html), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS bits
  FROM p JOIN g USING (html))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark, sf_dir):
    """Every page written to archives in the shared folder and read back from them."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(folder, index).drop("payload")
