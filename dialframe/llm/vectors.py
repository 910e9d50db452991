"""Integer vectors from float embeddings, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components stay within this bound, so that products and sums of thousands of them fit a long.
COMPONENT_LIMIT = 1 << 24


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def floor_components(embedding: Column, scale: int) -> Column:
    """``array<int>`` of floor(scale * x), x as double; beyond +-2^24 a component stays at that bound."""
    def whole(x: Column) -> Column:
        y = F.greatest(F.lit(float(-COMPONENT_LIMIT)), F.least(F.lit(float(COMPONENT_LIMIT)), x.cast("double") * scale))
        return F.floor(y).cast("int")
    return F.transform(embedding, whole)


def integer_rows(df: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(vec_id, label, v ``array<int>``) of the rows with a usable vector; other columns are left out."""
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                     F.col(f"`{embedding}`").alias("e"))
    return rows.where(usable(F.col("e"))).select("vec_id", "label", floor_components(F.col("e"), scale).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """(rows, width) long matrix of a list column; shorter vectors end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out
