"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek
table in a skippable frame (the public seekable format: entries of compressed
and decompressed size, then frame count, descriptor and magic number).  An index
row maps each record to bundle, frame and offset inside the frame, so one record
is read by decompressing one frame.

Bundles are written by the tasks, under a name of the task's attempt first and
then renamed, so that a repeated task replaces its own file.  Payloads that were
stored already are written as ``revisit`` records that refer to the response.

Defined results: a null payload is empty; a null URL gives a record without
target URI; of equal payloads the smallest page_id is the response (a null id is
the largest); repeated rows with that very id are responses too; an empty table
gives no bundle and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, materialize, partitions_for, pick, slices
from dialframe.session import scratch_folder

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = ("page_id long, bundle string, frame long, frame_offset long, frame_bytes long, record_offset long, "
         "record_bytes long")
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a folder's URI; Hadoop's names of S3 (``s3a``, ``s3n``) are S3."""
    scheme, mark, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else folder)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = [(x or "").encode("utf-8", "surrogatepass") for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), pa.array([len(p) for p in payloads], pa.int64()),
             pa.array([sha1_base32(p) for p in payloads], pa.string())],
            names=["page_id", "payload_bytes", "payload_digest"])


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, refers_to of every row of (page_id, html).

    ``refers_to`` is null for a response.  Only identifiers and digests are
    shuffled; a digest that many rows share costs one row per task in the
    aggregate and is split by the skew join when read back.
    """
    own = map_batches(pages.select("page_id", "html"), _digests,
                      "page_id long, payload_bytes long, payload_digest string")
    own = materialize(own, "warc-digests")
    first = (own.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = own.join(first, ["payload_digest", "payload_bytes"], "left")
    return joined.select("page_id", "payload_bytes", "payload_digest",
                         F.when(F.col("page_id") != F.col("first"), F.col("first"))
                         .when(F.col("page_id").isNull(), F.col("first")).alias("refers_to"))


def record_bytes(page_id, url, digest: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record with its headers; a revisit has the HTTP head only."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = head if refers_to is not None else head + payload
    fields = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
              f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
              "WARC-Date: 1970-01-01T00:00:00Z",
              "Content-Type: application/http; msgtype=response",
              f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        safe = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        fields.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields.append(f"Content-Length: {len(body)}")
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` as a dict of its fields, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(fields["Content-Length"])
    head = data.index(b"\r\n\r\n", start) + 4
    declared = int(data[start:head].split(b"Content-Length: ")[1].split(b"\r\n")[0])
    ident = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    refers = fields.get("WARC-Refers-To")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": int(ident) if ident else None, "url": url, "record_type": fields["WARC-Type"],
            "payload_bytes": declared, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": int(refers[len("<urn:page:"):-1]) if refers else None,
            "payload": data[head:start + size]}, start + size + 4


class BundleWriter:
    """One bundle file: frames as they fill, then the seek table."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, attempt: int):
        import zstandard
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._fs, self._to, self._tmp = fs, f"{folder}/{name}", f"{folder}/.{name}.{attempt}"
        self.name, self.size, self._frames, self._buffer, self._open_rows = name, 0, [], bytearray(), []
        self._out = fs.open_output_stream(self._tmp, compression=None)

    def add(self, page_id, record: bytes) -> list[tuple]:
        self._open_rows.append((page_id, len(self._buffer), len(record)))
        self._buffer += record
        return self._flush() if len(self._buffer) >= FRAME_BYTES else []

    def _flush(self) -> list[tuple]:
        if not self._buffer:
            return []
        frame = self._zstd.compress(bytes(self._buffer))
        rows = [(i, self.name, len(self._frames), self.size, len(frame), at, n) for i, at, n in self._open_rows]
        self._out.write(frame)
        self._frames.append((len(frame), len(self._buffer)))
        self.size += len(frame)
        self._buffer, self._open_rows = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self._frames)
        footer = struct.pack("<IBI", len(self._frames), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self._out.close()
        self._fs.move(self._tmp, self._to)
        return rows


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in INDEX.split(",")]
    kinds = [pa.string() if n == "bundle" else pa.int64() for n in names]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as bundles under ``folder``, a URI all executors reach; returns the index."""
    rows = pick(pages, page_id="page_id", url="url", html="html")
    plan = plan_records(rows, min_bytes)
    # Rows with the same id meet by id and digest again, so that repeated ids with other payloads stay apart.
    ranked = map_batches(rows, _with_digest, "page_id long, url string, html string, payload_digest string")
    joined = ranked.join(plan.dropDuplicates(["page_id", "payload_digest"]),
                         [ranked["page_id"].eqNullSafe(plan["page_id"]),
                          ranked["payload_digest"] == plan["payload_digest"]], "left")
    dealt = (joined.select(ranked["page_id"], "url", "html", ranked["payload_digest"], "refers_to")
             .sortWithinPartitions("page_id", "url", "payload_digest"))
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        task = TaskContext.get()
        part, attempt, writer, k = task.partitionId(), task.taskAttemptId(), None, 0
        for b in slices(batches, "html"):
            index = []
            for r in b.to_pylist():
                if writer is None:
                    writer = BundleWriter(fs, path, f"part-{part:05d}-{k:05d}.warc.zst", attempt)
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                index += writer.add(r["page_id"], record_bytes(
                    r["page_id"], r["url"], r["payload_digest"], payload, r["refers_to"]))
                if writer.size >= BUNDLE_BYTES:
                    index += writer.close()
                    writer, k = None, k + 1
            yield _index_batch(index)
        if writer is not None:
            yield _index_batch(writer.close())

    return materialize(map_batches(dealt, run, INDEX), "warc-index")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digest = [sha1_base32((x or "").encode("utf-8", "surrogatepass")) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digest, pa.string())],
                                         names=["page_id", "url", "html", "payload_digest"])


def read_seek_table(stream, size: int) -> list[tuple[int, int]]:
    """(compressed, decompressed) size of each frame, from the footer of an open bundle."""
    stream.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end of the bundle")
    stream.seek(size - 9 - 8 * frames)
    return list(struct.iter_unpack("<II", stream.read(8 * frames)))


def read_record(folder: str, entry) -> dict:
    """One record by its index row, decompressing its frame only."""
    import zstandard
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{entry['bundle']}") as f:
        f.seek(entry["frame_offset"])
        frame = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    return parse_record(frame, entry["record_offset"])[0]


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that ``index`` names, read frame by frame through the seek table.

    Bundles are dealt to tasks one by one, by count and not by the bytes of their names.
    """
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.strip().split(" ")[1]] for x in RECORDS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        fs, path = file_system(folder)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for name in b.column("bundle").to_pylist():
                with fs.open_input_file(f"{path}/{name}") as f:
                    at = 0
                    for packed, size in read_seek_table(f, f.size()):
                        f.seek(at)
                        data = unpack.decompress(f.read(packed), max_output_size=size)
                        at += packed
                        rows, pos = [], 0
                        while pos < len(data):
                            r, pos = parse_record(data, pos)
                            if r["record_type"] == "response" and sha1_base32(r["payload"]) != r["payload_digest"]:
                                raise ValueError(f"payload of page {r['page_id']} does not match its digest")
                            rows.append(r)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    bundles = index.select("bundle").distinct().repartition(partitions_for(index.sparkSession))
    return map_batches(bundles, run, RECORDS)


def archive_folder(spark) -> str:
    """A new folder for archives under the shared checkpoint folder, deleted when the application ends."""
    return scratch_folder(spark, "warc")
