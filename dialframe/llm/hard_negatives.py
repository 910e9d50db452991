"""Hard-negative mining with exact integer scores by the Four-Russians method.

Candidates are stored as packed bit planes: plane ``b`` holds bit ``b`` of every
component (two's complement), eight components to a byte.  For an anchor, the
sums of all 256 subsets of each group of eight of its components are tabulated
once.  One byte of a candidate's plane then looks up the inner product of eight
components; the lookups of a plane are added, and planes are combined from the
highest (which counts negatively) by shift and add.  Scores are exact.

On Spark: anchors (a stated query set) and candidates are dealt to blocks by a
hash of their id, and a tile is one block of each, brought together by their block
numbers.  A first pass scores equal labels only and keeps the best few per tile and
anchor; a second scores unequal labels only and keeps the best few in the window of
each positive.  Every pair is thus scored once in the two passes together.  A tile holds a
bounded number of rows whatever the labels or the distribution of vectors, and the
partial results of the tiles are ranked by a window over (anchor) or (anchor,
positive) of a few rows per candidate block.  The work is anchors x rows by definition;
what is shuffled is rows x anchors / ``ANCHOR_BLOCK`` packed vectors.

Cases: a row without id, label or usable vector (null, or a null or non-finite
component) takes no part.  Rows that repeat an id count once, with the smallest
(label, vector).  Ties in score go to the smaller id.  A shorter vector counts as if
it ended in zeros.  An empty table, or one without anchors, gives an empty
result.  Components beyond +-2^24 stay at that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, materialize, partitions_for
from dialframe.llm.vectors import integer_rows, matrix
from dialframe.session import ship_package

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of its positive's.
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256

#: Rows of a tile, and how many of them are scored at a time.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 8192
ANCHORS_AT_ONCE, CANDIDATES_AT_ONCE = 64, 2048

RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes: bit ``b`` of eight neighbouring components in one byte, lowest first."""
    rows, width = values.shape
    padded = np.zeros((rows, -(-width // 8) * 8), np.int64)
    padded[:, :width] = values
    planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.stack(planes, axis=1)


def subset_sums(anchors: np.ndarray, dtype: type = np.int64) -> np.ndarray:
    """(groups, 256, anchors): the sum of the components that each byte selects from a group of eight."""
    n, width = anchors.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype)
    padded[:, :width] = anchors
    groups = padded.reshape(n, -1, 8).transpose(1, 2, 0)
    table = np.zeros((len(groups), 256, n), dtype)
    for j in range(8):
        table[:, 1 << j:2 << j] = table[:, :1 << j] + groups[:, j, None]
    return table


def lookup_scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(anchors, rows) inner products from ``planes`` (bits, groups, rows) and the anchors' ``table``."""
    bits, groups, rows = planes.shape
    out = np.zeros((table.shape[2], rows), table.dtype)
    for at in range(0, rows, CANDIDATES_AT_ONCE):
        block = planes[:, :, at:at + CANDIDATES_AT_ONCE]
        score = np.zeros((block.shape[2], table.shape[2]), table.dtype)
        for b in range(bits - 1, -1, -1):
            score <<= 1
            for g in range(groups):
                found = table[g].take(block[b, g], axis=0)
                if b == bits - 1:  # the sign plane
                    score -= found
                else:
                    score += found
        out[:, at:at + CANDIDATES_AT_ONCE] = score.T
    return out


class _Tile:
    """The candidates and anchors of one tile, candidates in id order."""

    def __init__(self, candidates: pa.Table, anchors: pa.Table, bits: int, width: int):
        ids = candidates.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], candidates.column("label").to_numpy()[order]
        packed = np.frombuffer(b"".join(candidates.column("planes").to_pylist()), np.uint8)
        self.planes = np.ascontiguousarray(packed.reshape(len(ids), bits, -1)[order].transpose(1, 2, 0))
        self.anchor_ids, self.anchor_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        self.vectors = matrix(anchors.column("v"), width)
        # Partial sums stay below (sum of the anchor's magnitudes) x 2^bits.
        most = int(np.abs(self.vectors).sum(1).max(initial=0)) << bits
        self.dtype = np.int32 if most < 1 << 31 else np.int64

    def scores(self, anchors: np.ndarray, rows: np.ndarray | slice) -> Iterator[tuple[int, np.ndarray]]:
        """(anchor's place, scores of the rows), some anchors at a time."""
        planes = self.planes[:, :, rows]
        for at in range(0, len(anchors), ANCHORS_AT_ONCE):
            some = anchors[at:at + ANCHORS_AT_ONCE]
            yield from zip(some, lookup_scores(planes, subset_sums(self.vectors[some], self.dtype)).astype(np.int64))


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equal ones the first."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")[:k]]


def _pack(rows: DataFrame, bits: int, width: int) -> DataFrame:
    """(vec_id, label, planes) of the integer rows."""
    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = bit_planes(matrix(batch.column("v"), width), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([p.tobytes() for p in packed], pa.binary())], ["vec_id", "label", "planes"])
    return map_batches(rows.select("vec_id", "label", "v"), planes, "vec_id long, label long, planes binary")


def _tiles(candidates: DataFrame, anchors: DataFrame, blocks: tuple[int, int], score, schema: str) -> DataFrame:
    """``score(candidates, anchors)`` over every tile; a row goes once to each block of the other side."""
    n_rows, n_anchors = blocks
    ship_package(candidates.sparkSession)
    n = min(n_rows * n_anchors, 4 * partitions_for(candidates.sparkSession))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long")))).repartition(
                n, "row_block", "anchor_block")

    left = dealt(candidates, "row_block", n_rows, "anchor_block", n_anchors)
    right = dealt(anchors, "anchor_block", n_anchors, "row_block", n_rows)
    keys = ("row_block", "anchor_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def mine(df: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, scale: int = SCALE, vec_id: str = "vec_id",
         embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Hard negatives of the rows that fulfil ``anchors`` (an expression on ``vec_id`` and ``label``).

    Per anchor its ``positives`` best rows of the same label, and for each the ``negatives``
    best rows of another label whose score lies in the window.  Columns: :data:`RESULT`.
    """
    spark = df.sparkSession
    rows = integer_rows(df, scale, vec_id, embedding, label).where("vec_id is not null and label is not null").select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), "v")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    rows = materialize(rows.withColumn("is_anchor", F.coalesce(anchors, F.lit(False))), "mining-rows")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"),
                     F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("high"),
                     F.min(F.array_min("v")).alias("low")).first()
    if not stats["anchors"]:
        return spark.createDataFrame([], RESULT)
    width = max(1, stats["width"])
    bits = 1 + max((stats["high"] or 0).bit_length(), (-1 - (stats["low"] or 0)).bit_length() if (stats["low"] or 0) < 0 else 0)
    blocks = (-(-stats["n"] // CANDIDATE_BLOCK), -(-stats["anchors"] // ANCHOR_BLOCK))
    packed = _pack(rows, bits, width)
    asked = rows.where("is_anchor").select("vec_id", "label", "v")

    def same_label(candidates: pa.Table, some: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if candidates.num_rows and some.num_rows:
            tile = _Tile(candidates, some, bits, width)
            for label in np.unique(tile.anchor_labels):
                here = np.flatnonzero(tile.labels == label)
                if len(here) == 0:
                    continue
                for a, scores in tile.scores(np.flatnonzero(tile.anchor_labels == label), here):
                    other = tile.ids[here] != tile.anchor_ids[a]
                    ids, scores = tile.ids[here][other], scores[other]
                    top = _first(scores, positives)
                    found.append((np.full(len(top), tile.anchor_ids[a]), ids[top], scores[top]))
        return _table(found, ["anchor_id", "positive_id", "positive_score"])

    best = _tiles(packed, asked, blocks, same_label, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = best.withColumn("_place", place).where(F.col("_place") <= positives)
    lists = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores"))
    asked = asked.join(lists, "vec_id")

    def other_label(candidates: pa.Table, some: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if candidates.num_rows and some.num_rows:
            tile = _Tile(candidates, some, bits, width)
            ids, scores = some.column("positive_ids").to_pylist(), some.column("positive_scores").to_pylist()
            for a, row in tile.scores(np.arange(len(tile.anchor_ids)), slice(None)):
                # Whole scores within the window of the positive: ceil(low * s / 100) to floor(high * s / 100).
                spans = [(i, s, -(-low_percent * s // 100), high_percent * s // 100) for i, s in zip(ids[a], scores[a])]
                near = np.flatnonzero((row >= min(x[2] for x in spans)) & (row <= max(x[3] for x in spans)))
                near = near[tile.labels[near] != tile.anchor_labels[a]]
                for i, s, low, high in spans:
                    fit = near[(row[near] >= low) & (row[near] <= high)]
                    top = fit[_first(row[fit], negatives)]
                    n = len(top)
                    found.append((np.full(n, tile.anchor_ids[a]), np.full(n, i), np.full(n, s), tile.ids[top], row[top]))
        return _table(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    hard = _tiles(packed, asked, blocks, other_label, "anchor_id long, positive_id long, positive_score long, "
                                                      "negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(
        F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names)
