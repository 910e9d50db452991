"""The ensemble step as one function: fold predictions or an ordered list of prediction sets -> submission."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.operators.score import predict_from_scores, score_folds
from dialframe.operators.vote import attach_predictions, check_coverage, hard_vote, vote_with_coverage
from dialframe.session import materialize
from dialframe.sources.jsonio import (fold_name, fold_prediction_paths, prediction_file_names, read_fold_predictions,
                                      read_prediction_sets, unfinished_folds, write_fold_predictions)

SCORES = ("s_a", "s_b", "s_c")


def predict_folds(examples: DataFrame, factory: Callable[[int], Callable], output: str, k: int, id_col: str = "id",
                  batch_rows: int = 256, name: str | None = None) -> list[str]:
    """Score ``examples`` with the model of every unfinished fold and write one prediction set per fold.

    ``factory(fold)`` builds the scorer of a fold (1..k).  Rows of finished folds are
    not scored; the rows of all others are scored in one pass, each once per fold, by
    one partitioned write, and every fold is then published on its own.  Returns the
    paths of all k sets.
    """
    spark = examples.sparkSession
    folds = unfinished_folds(spark, output, k)
    if folds:
        scored = score_folds(examples, factory, folds, [id_col], SCORES, batch_rows=batch_rows, name=name)
        preds = predict_from_scores(scored, SCORES, [id_col, "fold"]).select(
            F.col(id_col).alias("id"), "output", "fold")
        write_fold_predictions(preds, output, k)
    return fold_prediction_paths(output, k)


def ensemble(spark: SparkSession, submission: DataFrame, *, k_folds: int = 1, output: str | None = None,
             base_dir: str | None = None, names: Sequence[str] = (), validate: bool = True) -> DataFrame:
    """Hard-vote either the ``k_folds`` fold predictions of ``output`` or the prediction sets ``names``
    (in recipe order, earliest wins ties) and attach the winners to ``submission`` by id.

    With neither more than one fold nor more than one prediction set there is
    nothing to vote on: that is an argument error, not an empty result.
    """
    if k_folds > 1:
        if not output:
            raise ValueError("k_folds > 1 needs the output path whose fold files are voted")
        preds = read_fold_predictions(spark, output, k_folds)
        models = [fold_name(i) for i in range(1, k_folds + 1)]
    elif len(names) > 1:
        if not base_dir:
            raise ValueError("a list of prediction sets needs base_dir")
        preds = read_prediction_sets(spark, base_dir, names)
        models = [n[:-len(".json")] for n in prediction_file_names(names)]
    else:
        raise ValueError("ensemble needs k_folds > 1 or more than one prediction set")
    if not validate:
        return attach_predictions(submission, hard_vote(preds.select("id", "output", "rank")))
    # Coverage is counted by the vote's own aggregates and kept with the winners: every set is read once.
    covered = materialize(vote_with_coverage(submission, preds, len(models)), "vote")
    check_coverage(covered, models)
    return attach_predictions(submission, covered.where("asked"))
