"""Hard voting over many prediction sets, attachment to a submission, validation and accuracy.

Prediction sets are one long table ``(id, output, rank)`` - ``rank`` is the
position of the set in the recipe (or the fold number) - so N sets are never
joined N ways: two partial-aggregating group-bys do the vote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hard_vote(preds: DataFrame, id: str = "id", label: str = "output", rank: str = "rank") -> DataFrame:
    """Most frequent label per id; a tie goes to the label whose first vote has the lowest rank.

    Output: ``id``, ``label``, ``votes`` (count of the winner), ``n_votes``.
    """
    per_label = preds.groupBy(id, label).agg(F.count(F.lit(1)).alias("_c"), F.min(rank).alias("_r"))
    key = F.struct(F.col("_c"), (-F.col("_r")).alias("_nr"))
    return per_label.groupBy(id).agg(
        F.max_by(label, key).alias(label), F.max("_c").alias("votes"), F.sum("_c").alias("n_votes"))


def attach_predictions(submission: DataFrame, voted: DataFrame, id: str = "id", label: str = "output") -> DataFrame:
    """Replace the submission's ``label`` by the prediction with the same id (by key, not position)."""
    return submission.drop(label).join(voted.select(id, label), id, "left")


def validate_prediction_sets(submission: DataFrame, preds: DataFrame, id: str = "id", model: str = "model"
                             ) -> DataFrame:
    """Per prediction set: rows, ids missing from it, ids not in the submission, duplicated ids.

    The submission is joined once with the set of (model, id) pairs; the
    per-model totals of the submission are a scalar subquery.
    """
    sub_ids = submission.select(id).distinct()
    n_sub = submission.select(F.count_distinct(id)).scalar()
    per_id = preds.groupBy(model, id).agg(F.count(F.lit(1)).alias("_k"))
    known = per_id.join(sub_ids.withColumn("_in", F.lit(True)), id, "left")
    return known.groupBy(model).agg(
        F.sum("_k").alias("n_rows"),
        (n_sub - F.count_if(F.col("_in").isNotNull())).alias("n_missing"),
        F.count_if(F.col("_in").isNull()).alias("n_extra"),
        F.count_if(F.col("_k") > 1).alias("n_duplicate_ids"))


def accuracy(pred: DataFrame, gold: DataFrame, id: str = "id", label: str = "output",
             group: str | Sequence[str] | None = None) -> DataFrame:
    """Share of ids whose predicted label equals the gold label (per ``group`` if given)."""
    g = [group] if isinstance(group, str) else list(group or [])
    j = pred.select(id, F.col(label).alias("_pred")).join(gold, id)
    ok = (F.col("_pred") == F.col(label)).cast("bigint")
    return j.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_correct"),
                             (F.sum(ok) / F.count(F.lit(1))).alias("accuracy"))


def check_prediction_sets(submission: DataFrame, preds: DataFrame, id: str = "id", model: str = "model",
                          expected: Sequence[str] = ()) -> None:
    """Raise ``ValueError`` when a prediction set does not cover the submission exactly once per id.

    ``expected`` names the sets that must be there: one without any row has no
    group of its own and would otherwise pass unseen.  One small job (the per-set
    summary has one row per set).
    """
    found = validate_prediction_sets(submission, preds, id, model).collect()
    bad = [f"{r[model]}: {r['n_missing']} missing, {r['n_extra']} extra, {r['n_duplicate_ids']} duplicated ids"
           for r in found if r["n_missing"] > 0 or r["n_extra"] > 0 or r["n_duplicate_ids"] > 0]
    bad += [f"{m}: no rows" for m in expected if m not in {r[model] for r in found}]
    if bad:
        raise ValueError(f"prediction sets do not match the submission: {'; '.join(bad)}")


def vote_with_coverage(submission: DataFrame, preds: DataFrame, n_sets: int, id: str = "id", label: str = "output",
                       rank: str = "rank") -> DataFrame:
    """:func:`hard_vote` that also counts, in its own aggregates, how often each set names each id.

    ``rank`` runs from 1 to ``n_sets``.  Output: one row per id of the predictions or the
    submission with ``label``, ``votes``, ``n_votes``, ``asked`` (in the submission) and
    ``set_1 .. set_n``, the rows that a set has for the id.
    """
    sets = [f"set_{r}" for r in range(1, n_sets + 1)]
    per_label = preds.groupBy(id, label).agg(
        F.count(F.lit(1)).alias("_c"), F.min(rank).alias("_r"),
        *[F.count_if(F.col(rank) == r).alias(c) for r, c in enumerate(sets, start=1)])
    key = F.struct(F.col("_c"), (-F.col("_r")).alias("_nr"))
    per_id = per_label.groupBy(id).agg(
        F.max_by(label, key).alias(label), F.max("_c").alias("votes"), F.sum("_c").alias("n_votes"),
        *[F.sum(c).alias(c) for c in sets])
    asked = submission.select(id).distinct().withColumn("asked", F.lit(True))
    full = per_id.join(asked, id, "full_outer")
    return full.select(id, label, "votes", "n_votes", F.coalesce("asked", F.lit(False)).alias("asked"),
                       *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in sets])


def check_coverage(covered: DataFrame, names: Sequence[str]) -> None:
    """Raise ``ValueError`` unless every set of :func:`vote_with_coverage` names each asked id exactly once.

    ``names`` are the sets' names by rank.  One aggregate of ``covered`` (one row).
    """
    tests = []
    for r in range(1, len(names) + 1):
        c = F.col(f"set_{r}")
        tests += [F.coalesce(F.sum(c), F.lit(0)).alias(f"rows_{r}"),
                  F.count_if(F.col("asked") & (c == 0)).alias(f"missing_{r}"),
                  F.count_if(~F.col("asked") & (c > 0)).alias(f"extra_{r}"), F.count_if(c > 1).alias(f"double_{r}")]
    found = covered.agg(*tests).first()
    bad = []
    for r, name in enumerate(names, start=1):
        missing, extra, double = (found[f"{k}_{r}"] for k in ("missing", "extra", "double"))
        if not found[f"rows_{r}"]:
            bad.append(f"{name}: no rows")
        elif missing or extra or double:
            bad.append(f"{name}: {missing} missing, {extra} extra, {double} duplicated ids")
    if bad:
        raise ValueError(f"prediction sets do not match the submission: {'; '.join(bad)}")
