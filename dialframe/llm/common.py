"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.session import ensure_checkpoint_dir, materialize, ship_package

__all__ = ["read", "pick", "map_batches", "slices", "materialize", "shared_folder", "partitions_for"]


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, only the named columns."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the named columns under the operator's own names.

    Extra columns, whatever their names, cannot clash with those of the operator.
    """
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers.

    A worker outlives its task; what the task has freed goes back to the system
    before it waits for the next one, as the JVM needs the memory meanwhile.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back_memory()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where their text passes ``most`` bytes, so that the work arrays of a task stay bounded.

    Every row is in exactly one slice; a longer text is a slice of its own.
    """
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back_memory() -> None:
    """Return to the system what earlier tasks of this worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/dialframe-{name}-{uuid.uuid4().hex}"


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Partition count for a keyed ``repartition``: the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
