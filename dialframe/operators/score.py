"""Batch scoring: a pluggable scorer over encoded examples, then scores -> probabilities -> label.

Only the scorer itself runs in Python (``mapInPandas``, Arrow batches, the model
loaded once per Python worker).  Softmax, argmax and the label mapping are
native expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialframe.operators.prompts import index_to_output
from dialframe.session import ship_package

# A scorer factory returns ``score(batch: pandas.DataFrame) -> numpy array (n, 3)``.
ScorerFactory = Callable[[], Callable]

_SCORERS: dict[str, Callable] = {}
MAX_SCORERS = 4


def worker_scorer(name: str, factory: ScorerFactory, most: int = MAX_SCORERS) -> Callable:
    """The scorer of that name in this Python process, built at first use.

    Tasks call it on the imported module, whose state outlives a task, so a
    reused worker builds each scorer once.  At most ``most`` stay; the one built
    first goes.
    """
    if name not in _SCORERS:
        while len(_SCORERS) >= most:
            del _SCORERS[next(iter(_SCORERS))]
        _SCORERS[name] = factory()
    return _SCORERS[name]


def softmax(scores: Column) -> Column:
    """Numerically stable softmax of an array column (the maximum is subtracted first)."""
    m = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - m))
    z = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / z)


def argmax_first(values: Column) -> Column:
    """0-based position of the maximum; ties go to the first; NaN counts as the largest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def predict_from_scores(df: DataFrame, scores: Sequence[str], keep: Sequence[str], round_digits: int | None = None
                        ) -> DataFrame:
    """Scores for options A, B, C -> ``p_a, p_b, p_c``, ``pred`` (0-based) and ``output``."""
    arr = F.array(*[F.col(s).cast("double") for s in scores])
    probs = softmax(arr)
    out = df.select(*keep, probs.alias("_p"), argmax_first(arr).alias("pred"))
    p = [F.get("_p", i) for i in range(len(scores))]
    if round_digits is not None:
        p = [F.round(x, round_digits) for x in p]
    names = [f"p_{chr(ord('a') + i)}" for i in range(len(scores))]
    return out.select(*keep, *[x.alias(n) for x, n in zip(p, names)], "pred",
                      index_to_output(F.col("pred")).alias("output"))


def source_only(encoded: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Scoring input: the source tokens only.  In eval mode an example with a gold
    output also carries its target; scoring the last position must not see it."""
    return encoded.select(*keep, F.slice("input_ids", 1, F.col("n_source")).alias("input_ids"))


def score_batches(df: DataFrame, factory: ScorerFactory, keep: Sequence[str],
                  out_scores: Sequence[str] = ("s_a", "s_b", "s_c"), key_types: str | None = None,
                  batch_rows: int = 256, name: str | None = None) -> DataFrame:
    """Run ``factory()``'s scorer over Arrow batches of ``df``; returns ``keep`` + score columns.

    The scorer is built once per Python worker and reused across batches and
    tasks; it sees at most ``batch_rows`` rows per call, so the model's batch
    memory stays bounded whatever the Arrow batch size.  ``name`` identifies the
    scorer: give the same one to share it between calls, a new one for another
    model; by default every call has its own.
    """
    scorer_name = name or uuid.uuid4().hex

    def scorer_of(_key):
        from dialframe.operators import score as shared  # the worker's module, not a copy in this closure
        return shared.worker_scorer(scorer_name, factory)

    return _score(df, scorer_of, None, keep, out_scores, key_types, batch_rows)


def score_folds(df: DataFrame, factory: Callable[[int], Callable], folds: Sequence[int], keep: Sequence[str],
                out_scores: Sequence[str] = ("s_a", "s_b", "s_c"), batch_rows: int = 256, name: str | None = None,
                partitions: int | None = None, fold: str = "fold") -> DataFrame:
    """Score every row once with the model of each of ``folds``; returns ``keep`` + ``fold`` + score columns.

    ``factory(fold)`` builds the scorer of a fold.  Rows are repeated per fold and
    dealt so that a partition holds rows of one fold only, and a fold's partitions
    lie together: a task loads one model, and a worker holds one model at a time.
    The rows of a fold are spread over its partitions by a hash of ``keep``.
    ``partitions`` defaults to the session's shuffle partitions.
    """
    spark = df.sparkSession
    folds = [int(f) for f in folds]
    if not folds:
        raise ValueError("no fold to score")
    per_fold = max(1, -(-(partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))) // len(folds)))
    scorer_name = name or uuid.uuid4().hex
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int") - 1
    deal = place * per_fold + F.pmod(F.xxhash64(*keep), F.lit(per_fold)).cast("int")
    dealt = df.withColumn(fold, F.explode(F.array(*[F.lit(f) for f in folds]))).repartitionById(
        per_fold * len(folds), deal)

    def scorer_of(key):
        from dialframe.operators import score as shared
        return shared.worker_scorer(f"{scorer_name}/{key}", lambda: factory(int(key)), most=1)

    return _score(dealt, scorer_of, fold, [*keep, fold], out_scores, None, batch_rows)


def _score(df: DataFrame, scorer_of: Callable, model_key: str | None, keep: Sequence[str], out_scores: Sequence[str],
           key_types: str | None, batch_rows: int) -> DataFrame:
    """``mapInPandas`` of the scorer that ``scorer_of`` gives for each value of the column ``model_key``."""
    ship_package(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name in keep]
    key_schema = key_types or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema = key_schema + ", " + ", ".join(f"{s} double" for s in out_scores)
    keep = list(keep)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        for pdf in batches:
            groups = [(None, pdf)] if model_key is None else pdf.groupby(model_key, sort=True)
            for key, rows in groups:
                scorer = scorer_of(key)
                parts = [np.asarray(scorer(rows.iloc[i:i + batch_rows]), dtype="float64").reshape(-1, len(out_scores))
                         for i in range(0, len(rows), batch_rows)]
                s = np.concatenate(parts) if parts else np.zeros((0, len(out_scores)))
                out = pd.DataFrame({k: rows[k] for k in keep})
                for i, column in enumerate(out_scores):
                    out[column] = s[:, i]
                yield out

    return df.mapInPandas(run, schema)
