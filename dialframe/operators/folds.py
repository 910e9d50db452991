"""Deterministic row index, K-fold assignment and train/validation views.

The row index never uses a window without a partition (that funnels every row
through one task).  The order columns are range-partitioned as a whole tuple, with a
row hash behind it so that equal or null keys spread too; per-partition counts
give each range its offset, and ``row_number`` runs inside a range only.  Wide rows
stay out of it: the index is joined back to them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialframe.session import materialize, num_partitions

MIN_BUCKETS = 64
# The cut points of the quantile sketch go to the driver: bound them.
MAX_BUCKETS = 1 << 14


def _as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def quantile_buckets(df: DataFrame, key: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``: the approximate-quantile bucket of ``key`` (numeric), never decreasing in ``key``.

    Every bucket holds about ``rows / buckets`` rows of the whole frame, so no
    single group can put more than that in one bucket (only exact ties of the key
    stay together).  One sketch pass; at most ``buckets - 1`` cut points reach the
    driver; a binary search (``Bucketizer``) assigns the bucket.  Nulls get -1.
    ``buckets`` defaults to four per input split, between 64 and 16384.
    """
    from pyspark.ml.feature import Bucketizer

    if buckets is None:
        buckets = max(MIN_BUCKETS, 4 * num_partitions(df))
    buckets = max(1, min(buckets, MAX_BUCKETS))
    keyed = df.withColumn("_qk", key.cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(keyed.approxQuantile("_qk", probs, 1.0 / (4 * buckets)))) if buckets > 1 else []
    splits = [float("-inf")] + [c for c in cuts if math.isfinite(c)] + [float("inf")]
    if len(splits) < 3:  # an empty frame, null keys only, or one bucket
        return keyed.withColumn(out, F.when(F.col("_qk").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
                                ).drop("_qk")
    keyed = Bucketizer(splits=splits, inputCol="_qk", outputCol="_qb", handleInvalid="keep").transform(keyed)
    return keyed.withColumn(out, F.when(F.col("_qk").isNull(), F.lit(-1)).otherwise(F.col("_qb")).cast("bigint")
                            ).drop("_qk", "_qb")


def _tie_hash(df: DataFrame) -> Column:
    """Hash of the row's columns (maps and variants cannot be hashed)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields
                        if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])


def _narrow(df: DataFrame, order: Sequence[str]) -> bool:
    """Whether the columns beside the order are a few numbers, which cost less to shuffle than to join back."""
    rest = [f.dataType.typeName() for f in df.schema.fields if f.name not in order]
    return len(rest) <= 4 and all(t in ("byte", "short", "integer", "long", "float", "double", "boolean", "date",
                                        "timestamp", "timestamp_ntz") for t in rest)


def number_rows(df: DataFrame, order: Sequence[str], out: str, total: str | None, partitions: int) -> DataFrame:
    """:func:`with_global_index` of narrow rows whose order decides every tie that matters.

    The rows are range-partitioned by the order and written once in the checkpoint
    folder, so that counting and numbering see the same ranges.  The offsets are one row per range.
    """
    ranged = materialize(df.repartitionByRange(partitions, *order).withColumn("_bucket", F.spark_partition_id()),
                         "index-ranges")
    counts = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most `partitions` rows: one small ordered pass for the running offsets.
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0).cast("bigint")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    joined = ranged.join(F.broadcast(offsets), "_bucket")
    w = Window.partitionBy("_bucket").orderBy(*order)
    res = joined.withColumn(out, (F.col("_offset") + F.row_number().over(w) - 1).cast("bigint"))
    if total:
        res = res.withColumnRenamed("_total", total)
    return res.select(*df.columns, out, *([total] if total else []))


def with_row_key(df: DataFrame, order: Sequence[str], unique: bool) -> DataFrame:
    """``df`` written once, with a row number of no meaning (``_row``) and a hash that breaks ties (``_tie``)."""
    tie = F.lit(0).cast("bigint") if unique else _tie_hash(df)
    return materialize(df.withColumn("_tie", tie).withColumn("_row", F.monotonically_increasing_id()), "index-rows")


def with_global_index(df: DataFrame, order: str | Sequence[str], out: str = "idx", total: str | None = None,
                      partitions: int | None = None, unique: bool = False) -> DataFrame:
    """Add a 0-based index in ``order`` (any sortable columns, nulls first; ties by a hash of the row).

    Only the order columns, the hash and a row number are shuffled and numbered; the
    index is then joined back to the rows, which are written once and shuffled at most once.  (Rows
    of a few numbers beside the order are numbered as they are.)  Every range holds
    about ``rows / partitions`` rows however the keys cluster, equal and null keys
    included.  ``unique=True`` says that the order has no ties: the rows are not hashed.
    ``total`` names an optional column with the row count of the whole frame.
    """
    order = _as_list(order)
    n = partitions or max(num_partitions(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if _narrow(df, order):
        tied = df if unique else df.withColumn("_tie", _tie_hash(df))
        by = order if unique else [*order, "_tie"]
        return number_rows(tied, by, out, total, n).select(*df.columns, out, *([total] if total else []))
    rows = with_row_key(df, order, unique)
    index = number_rows(rows.select(*dict.fromkeys([*order, "_tie", "_row"])), [*order, "_tie"], out, total, n)
    found = index.select("_row", out, *([total] if total else []))
    return rows.join(found, "_row").select(*df.columns, out, *([total] if total else []))


def kfold(df: DataFrame, order: str | Sequence[str], k: int, out: str = "fold",
          by: str | Sequence[str] = ()) -> DataFrame:
    """Contiguous, unshuffled K-fold: with q = n div k and r = n mod k the first r folds
    get q + 1 rows.  ``fold`` is 1-based (as in ``fold_1 .. fold_k``); k > n raises.
    ``by`` folds each of its groups on its own (e.g. per prompt variant)."""
    if k < 2:
        raise ValueError(f"k must be at least 2, got {k}")
    by = _as_list(by)
    idx = with_global_index(df, [*by, *_as_list(order)], out="idx", total="_n_rows")
    if by:
        # Rows of a group are neighbours in the index: its first place and size, one row per group.
        groups = idx.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(
            F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_size"))
        same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
        idx = idx.join(groups, same).withColumns(
            {"idx": F.col("idx") - F.col("_first"), "_n_rows": F.col("_size")}).drop(*groups.columns)
    n = F.col("_n_rows")
    q = F.floor(n / F.lit(k)).cast("bigint")
    r = n - q * F.lit(k)
    i = F.col("idx")
    big = r * (q + 1)
    fold0 = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / q)).cast("bigint")
    fold = F.when(n < F.lit(k), F.raise_error(F.concat(F.lit(f"cannot split into {k} folds: only "),
                                                        n.cast("string"), F.lit(" rows")))).otherwise(fold0 + 1)
    return idx.withColumn(out, fold.cast("int")).drop("_n_rows")


def fold_roles(folded: DataFrame, k: int, fold: str = "fold", out_round: str = "round",
               out_role: str = "role") -> DataFrame:
    """Expand to the k rounds: in round j the rows of fold j validate, the rest train.

    A generator over ``sequence(1, k)``, not a join.
    """
    return folded.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias(out_round)).withColumn(
        out_role, F.when(F.col(fold) == F.col(out_round), F.lit("validation")).otherwise(F.lit("train")))
