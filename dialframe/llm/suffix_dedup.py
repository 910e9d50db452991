"""Exact substring dedup of a corpus: shards by content, each sorted by external induced sorting.

A byte goes if some ``length``-byte string that covers it starts anywhere else.

Shards are cut so that equal windows (``length`` bytes) always meet: each window
has an anchor, its ``GRAM``-byte string of smallest hash, which equal windows
share.  Windows with one anchor occurrence form a segment of text.

1. One pass finds all segments: anchor, digest, place.  Occurrences are summed per
   anchor, from partial sums; anchors that occur once cannot be in a repeated window.
2. Equal segments are merged before anything else moves: all windows of a segment
   that occurs twice are repeated.  Where all segments of an anchor are equal,
   nothing is left to sort.
3. The distinct segments of the other anchors are fetched from the texts and
   dealt into shards by anchor.  A task cuts its rows into shards of some
   :data:`SHARD_BYTES`, between anchors only, and sorts each.  An anchor with more
   than :data:`ANCHOR_BYTES` of distinct segments (the edge of a passage that many
   documents share) is not sorted: its windows are counted by a 128-bit digest,
   with partial counts, so that no task holds the anchor.
4. Marked windows go back to every document that holds the segment, and the
   documents are cut.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; repeated rows are copies of each other; a null id is an id; an empty
table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, materialize, partitions_for, pick, slices
from dialframe.llm.induced_sort import repeated
from dialframe.session import release_materialized

LENGTH = 200
GRAM = 32
SHARD_BYTES = 2 << 20
#: Distinct text of one anchor that is still sorted in one shard.
ANCHOR_BYTES = 2 << 20
#: Windows of a text that are looked at together.
_STRETCH = 1 << 19
_U = np.uint64
_TABLE = np.random.default_rng(17).integers(0, 1 << 64, 256, np.uint64)
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at each position, by doubling."""
    h, size = _TABLE[data], 1
    for step in _STEPS:
        h = h[:len(h) - size] * _U(step) + h[size:]
        size *= 2
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def segments(data: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(anchor, first window, number of windows) of a text: maximal runs of windows with one anchor occurrence.

    A window's anchor is the leftmost of its grams with the smallest hash, so it depends on the window alone.
    """
    out, wide = [], length - GRAM + 1
    for start in range(0, len(data) - length + 1, _STRETCH):
        part = np.frombuffer(data, np.uint8)[start:start + _STRETCH + length - 1]
        h = gram_hashes(part)
        low = (h & ~_U(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)  # a stretch has fewer than 2^20 places
        size = 1
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[:len(low) - (wide - size)], low[wide - size:])
        place = (low & _U(0xFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        count = np.diff(np.append(first, len(place)))
        anchors = h[place[first]].view(np.int64)
        out += zip(anchors.tolist(), (first + start).tolist(), count.tolist())
    return out


# place: first window << 32 | equal segments in a row << 16 | windows of one.
_SEGMENT = "doc_id long, text_key long, anchor long, digest long, place long"


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(5)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = _utf8(text)
                found = segments(data, length)
                if not found:
                    continue
                rows = _in_a_row((a, digest(data[s:s + n + length - 1]), s, n) for a, s, n in found)
                anchors, digests, places = zip(*rows)
                cols[0] += [doc] * len(rows)
                cols[1] += [_text_key(data)] * len(rows)
                cols[2] += anchors
                cols[3] += digests
                cols[4] += places
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(np.array(cols[3], np.uint64).view(np.int64)), pa.array(cols[4], pa.int64())],
                names=["doc_id", "text_key", "anchor", "digest", "place"])
    return run


def _in_a_row(found) -> list[tuple[int, int, int]]:
    """(anchor, digest, place), equal segments that follow each other as one row.

    A text that repeats a word for pages has one anchor at every repeat: without
    this, such texts would put most of a table's rows on a few keys.
    """
    rows: list[list[int]] = []
    for anchor, key, start, windows in found:
        last = rows[-1] if rows else None
        if last and last[:2] == [anchor, key] and last[3] == windows and last[4] < 0xFFFF:
            last[4] += 1
        else:
            rows.append([anchor, key, start, windows, 1])
    return [(a, k, s << 32 | r << 16 | n) for a, k, s, n, r in rows]


def _start(place: int) -> int:
    return place >> 32


def _windows(place: int) -> int:
    return place & 0xFFFF


def _text_key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text as compressed bytes, so that shuffles of whole texts stay small."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, "text"):
        data = [_utf8(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([_text_key(d) for d in data], pa.int64()),
             pa.array([pack.compress(d) for d in data], pa.binary())], names=["doc_id", "text_key", "packed"])


def _cut_segments(length: int):
    """The bytes of the wanted segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, "packed"):
            rows = []
            for packed, wanted in zip(b.column("packed").to_pylist(), b.column("wanted").to_pylist()):
                data = unpack.decompress(packed)
                for w in wanted:
                    start, windows = _start(w["place"]), _windows(w["place"])
                    rows.append((w["anchor"], w["digest"], data[start:start + windows + length - 1]))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                names=["anchor", "digest", "bytes"])
    return run


def _cut_windows(length: int):
    """The windows of the wanted segments of each text, by their digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_128_digest
        for b in slices(batches, "packed"):
            for packed, wanted in zip(b.column("packed").to_pylist(), b.column("wanted").to_pylist()):
                data = unpack.decompress(packed)
                for some in range(0, len(wanted), 256):
                    rows = [(w["anchor"], w["digest"], i, digest(data[s + i:s + i + length]))
                            for w in wanted[some:some + 256] for s in (_start(w["place"]),)
                            for i in range(_windows(w["place"]))]
                    cols = list(zip(*rows)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                         pa.array(cols[3], pa.binary())], names=["anchor", "digest", "window", "key"])
    return run


def _runs(flags: np.ndarray) -> list[int]:
    """Flat [start, end) pairs of the set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


def _sort_shards(length: int):
    """Segments sorted by anchor in, the repeated windows of each out; shards end between anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            marks = [_runs(m) for m in repeated(held, length)]
            found = [(a, d, m) for (a, d), m in zip(keys, marks) if m]
            cols = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.int32()))], names=["anchor", "digest", "marks"])

        for b in slices(batches, "bytes"):
            for anchor, digest, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "bytes"))):
                if size >= SHARD_BYTES and anchor != keys[-1][0]:
                    yield flush()
                    keys, held, size = [], [], 0
                keys.append((anchor, digest))
                held.append(data)
                size += len(data)
        if held:
            yield flush()
    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, ranges) of documents with repeated windows, and the packed texts.

    ``ranges`` holds (first, end) window starts; a window covers ``length`` bytes.
    """
    spark = docs.sparkSession
    found = materialize(map_batches(docs, _segments(length), _SEGMENT), "suffix-found")
    # Partial sums per anchor: a frequent one is a row per task before it is shuffled; a skewed join may be split.
    sums = (found.groupBy("anchor").agg(F.expr("sum(shiftright(place, 16) & 65535)").alias("times"),
                                        F.expr("min(digest) = max(digest)").alias("uniform"))
            .where("times > 1").drop("times"))
    shared = materialize(found.join(sums, "anchor").select(*found.columns, "uniform"), "suffix-segments")
    release_materialized(found)

    start = F.shiftright("place", 32).cast("int")
    repeats = F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    windows = F.col("place").bitwiseAND(F.lit(0xFFFF)).cast("int")

    # Anchors with unlike segments: one text of each is sorted.
    each = shared.where("not uniform").groupBy("anchor", "digest").agg(
        F.sum(repeats).alias("times"), F.min(F.struct("doc_id", "text_key", "place")).alias("at"))
    each = materialize(each, "suffix-distinct")
    # One row per ANCHOR_BYTES of distinct text at most.
    size = F.col("at.place").bitwiseAND(F.lit(0xFFFF)) + (length - 1)
    heavy = materialize(each.groupBy("anchor").agg(F.sum(size).alias("size"))
                        .where(F.col("size") > ANCHOR_BYTES).select("anchor"), "suffix-heavy")
    texts = map_batches(docs, _packed, "doc_id long, text_key long, packed binary")

    def fetched(some: DataFrame) -> DataFrame:
        wanted = (some.select("at.doc_id", "at.text_key", F.struct("anchor", "digest", "at.place").alias("w"))
                  .groupBy("doc_id", "text_key").agg(F.collect_list("w").alias("wanted")))
        return texts.join(wanted, [texts["text_key"] == wanted["text_key"],
                                   texts["doc_id"].eqNullSafe(wanted["doc_id"])]).select("packed", "wanted")

    bits = map_batches(fetched(each.join(F.broadcast(heavy), "anchor", "left_anti")), _cut_segments(length),
                       "anchor long, digest long, bytes binary")
    dealt = bits.repartition(partitions_for(spark), "anchor").sortWithinPartitions("anchor", "digest")
    marks = map_batches(dealt, _sort_shards(length), "anchor long, digest long, marks array<int>")
    if heavy.limit(1).count():
        windows_of = materialize(map_batches(
            fetched(each.join(F.broadcast(heavy), "anchor", "left_semi")), _cut_windows(length),
            "anchor long, digest long, window int, key binary"), "suffix-windows")
        again = windows_of.groupBy("anchor", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        marks = marks.unionByName(
            windows_of.join(again, ["anchor", "key"], "left_semi").groupBy("anchor", "digest")
            .agg(F.flatten(F.collect_list(F.array("window", F.col("window") + 1))).alias("marks")))
    # A segment that occurs twice is repeated as a whole; repeated rows may have brought it twice.
    marks = each.where("times = 1").join(marks.dropDuplicates(["anchor", "digest"]), ["anchor", "digest"]).select(
        "anchor", "digest", "marks")
    several = each.where("times > 1").select("anchor", "digest", F.array(F.lit(0), F.col("at.place").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("marks"))
    marks = marks.unionByName(several)

    whole = shared.where("uniform").select(
        "doc_id", "text_key", F.array(start, start + repeats * windows).alias("ranges"))
    moved = F.flatten(F.transform(F.sequence(F.lit(0), repeats - 1), lambda k: F.transform(
        "marks", lambda m: m + start + k * windows)))
    part = shared.where("not uniform").join(marks, ["anchor", "digest"]).select(
        "doc_id", "text_key", moved.alias("ranges"))
    ranges = (whole.unionByName(part).groupBy("doc_id", "text_key")
              .agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    return ranges, texts


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, "packed"):
            kept, sizes, spans = [], [], []
            for packed, ranges in zip(b.column("packed").to_pylist(), b.column("ranges").to_pylist()):
                data = unpack.decompress(packed)
                merged: list[list[int]] = []
                for s, e in sorted(zip((ranges or [])[::2], (ranges or [])[1::2])):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e + length - 1)
                    else:
                        merged.append([s, e + length - 1])
                out, at = [], 0
                for s, e in merged:
                    out.append(data[at:s])
                    at = e
                kept.append(b"".join([*out, data[at:]]))
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "kept", "removed"])
    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, kept (the remaining bytes joined), removed (maximal removed byte ranges)."""
    rows = pick(docs, doc_id=doc_id, text=text)
    ranges, texts = repeated_windows(rows, length)
    joined = texts.join(ranges, [texts["text_key"] == ranges["text_key"],
                                 texts["doc_id"].eqNullSafe(ranges["doc_id"])], "left")
    return map_batches(joined.select(texts["doc_id"], "packed", "ranges"), _cut(length),
                       "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
