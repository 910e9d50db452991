"""Vector code compression: four codebooks of 256 entries learned in integers, one byte per part.

Vectors become integers and are cut into equal consecutive parts.  Each part has
a codebook, refined for a fixed number of rounds: every part goes to its nearest
entry, then an entry becomes the floored mean of its parts.

The nearest entry is found by *equal-average search*.  For a part and an entry of
``d`` components whose component sums differ by ``gap``, the squared distance is
at least ``gap^2 / d``.  Entries lie sorted by their sum; a part starts at its own
sum and looks outward on both sides, until on each side ``gap^2 / d`` strictly
exceeds its best distance (an equal one may still win the tie by a lower index).
Parts are taken in order of their sums, a block at a time, so that a block shares
its starting place and its steps are small matrix products; each part leaves the
search by its own bound.

On Spark: the integer rows are written once; a round is one pass that sums parts
per entry inside each task and then by a ``groupBy``.  Only codebooks (parts x 256
x width numbers) reach the driver and the tasks.

Cases: a null vector or one with a null or non-finite component is dropped.  Rows
that repeat an id are rows of their own; a null id is kept, after all others in
the first codebook's order.  A vector shorter than the longest (or a length that
the parts do not divide) ends in zeros.  Fewer than 256 rows give as many entries.
An empty table gives an empty result.  Components beyond +-2^24 stay at that bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, materialize
from dialframe.llm.vectors import integer_rows, matrix

PARTS = 4
ENTRIES = 256  # an index is two hex digits
ROUNDS = 4
SCALE = 1024

#: Parts of a block, and entries looked at in one step of its search.
BLOCK = 512
STEP = 16


def _distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries)."""
    most = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0))
    if rows.shape[1] * 4 * int(most) ** 2 < 1 << 53:  # every term and sum is a whole number that a double holds
        r, e = rows.astype(np.float64), entries.astype(np.float64)
        return ((r * r).sum(1)[:, None] - 2 * (r @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((rows - e) ** 2).sum(1) for e in entries], axis=1)


def nearest(rows: np.ndarray, book: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` (ties: the lowest) and its squared distance, per row.

    ``seen``, if given, collects the number of distances computed.
    """
    width, k = rows.shape[1], len(book)
    order = np.argsort(book.sum(1), kind="stable")
    sums, sorted_book = book.sum(1)[order], book[order]
    row_sums = rows.sum(1)
    index, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    by_sum = np.argsort(row_sums, kind="stable")
    for at in range(0, len(rows), BLOCK):
        where = by_sum[at:at + BLOCK]
        part, mine = rows[where], row_sums[where]
        found, dist = np.full(len(where), k), np.full(len(where), np.iinfo(np.int64).max)

        def look(active: np.ndarray, lo: int, hi: int) -> None:
            columns = np.sort(order[lo:hi])  # in index order, so that the first minimum is the lowest index
            d = _distances(part[active], book[columns])
            if seen is not None:
                seen.append(d.size)
            i = d.argmin(1)
            d, i = d[np.arange(len(i)), i], columns[i]
            better = (d < dist[active]) | ((d == dist[active]) & (i < found[active]))
            dist[active[better]], found[active[better]] = d[better], i[better]

        def still(entry: int) -> np.ndarray:
            """Rows that the entry's gap does not exclude; rounding can only keep a row."""
            gap = (mine - sums[entry]).astype(np.float64)
            return np.flatnonzero(gap * gap <= width * dist.astype(np.float64) * (1 + 1e-9))

        lo = max(0, int(np.searchsorted(sums, mine[0], "left")) - STEP // 2)
        hi = min(k, int(np.searchsorted(sums, mine[-1], "right")) + STEP // 2)
        look(np.arange(len(where)), lo, hi)
        while lo > 0 or hi < k:
            left = still(lo - 1) if lo > 0 else ()
            if len(left):
                look(left, max(0, lo - STEP), lo)
                lo = max(0, lo - STEP)
            else:
                lo = 0
            right = still(hi) if hi < k else ()
            if len(right):
                look(right, hi, min(k, hi + STEP))
                hi = min(k, hi + STEP)
            else:
                hi = k
        index[where], best[where] = found, dist
    return index, best


def _parts(lists: pa.Array, books: np.ndarray) -> Iterator[np.ndarray]:
    n_parts, _, width = books.shape
    whole = matrix(lists, n_parts * width)
    for p in range(n_parts):
        yield np.ascontiguousarray(whole[:, p * width:(p + 1) * width])


def _refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the floored mean of each entry's parts; an entry without parts stays."""
    n_parts, k, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((n_parts, k, width), np.int64), np.zeros((n_parts, k), np.int64)
        for batch in batches:
            for p, part in enumerate(_parts(batch.column("v"), books)):
                index, _ = nearest(part, books[p])
                np.add.at(total[p], index, part)
                n[p] += np.bincount(index, minlength=k)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e])]
            + [pa.array(total[p, e, i]) for i in range(width)], ["part", "entry", "n", *names])

    schema = "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names)
    per_entry = map_batches(rows.select("v"), sums, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    out = books.copy()
    for r in per_entry.toLocalIterator():  # at most parts x entries rows
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return out


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of the integer rows (vec_id, v)."""
    if not 1 <= entries <= 256:
        raise ValueError(f"entries must be from 1 to 256, got {entries}")
    width = -(-(rows.select(F.max(F.size("v"))).first()[0] or 0) // parts)
    seeds = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    whole = matrix(seeds.column("v"), parts * width)
    books = np.ascontiguousarray(whole.reshape(len(whole), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if books.size else 0):
        books = _refine(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of the integer rows (vec_id, label, v)."""
    kept = [f for f in rows.schema.fields if f.name in ("vec_id", "label")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", code string, error long"

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            for p, part in enumerate(_parts(batch.column("v"), books)):
                if books.size:
                    index, dist = nearest(part, books[p])
                    code[:, p], error = index, error + dist
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array([c.tobytes().hex() for c in code], pa.string()),
                                                       pa.array(error)], [f.name for f in kept] + ["code", "error"])

    return map_batches(rows.select(*[f.name for f in kept], "v"), codes, schema)


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
             ) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every usable vector, and the codebooks."""
    rows = materialize(integer_rows(df, scale, vec_id, embedding, label), "code-vectors")
    books = train(rows, parts, entries, rounds)
    coded = materialize(encode(rows, books), "codes")
    per_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return joined, books
