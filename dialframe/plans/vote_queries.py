"""Driver queries for scoring, hard voting, attachment, validation and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.operators import vote
from dialframe.operators.score import predict_from_scores, score_batches
from dialframe.plans.ensemble import ensemble, predict_folds
from dialframe.plans.registry import register
from dialframe.session import scratch_folder
from dialframe.sources.jsonio import read_fold_predictions
from dialframe.sources.tables import read_table

N_MODELS = 11
N_FOLDS = 5

# Model m (rank m, 0 = first in the recipe) votes by a fixed rule on vec_id and label.
_VOTES_SQL = f"""votes AS (SELECT vec_id, m AS rank, concat('inference_', CASE WHEN (vec_id + m * 7) % 4 = 0
                      THEN (label + m) % 3 + 1 ELSE (label * m + vec_id) % 3 + 1 END) AS output
          FROM embeddings, range(0, {N_MODELS}) r(m))"""

_FOLD_VOTES_SQL = f"""votes AS (SELECT vec_id, f AS rank, concat('inference_', CASE WHEN (vec_id + f) % 3 = 0
                      THEN label % 3 + 1 ELSE (vec_id + label * f) % 3 + 1 END) AS output
          FROM embeddings, range(1, {N_FOLDS + 1}) r(f))"""

_WINNER_SQL = """per AS (SELECT vec_id, output, count(*) AS c, min(rank) AS r FROM votes GROUP BY vec_id, output),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, r ASC) AS pos,
                  CAST(sum(c) OVER (PARTITION BY vec_id) AS BIGINT) AS n_votes FROM per),
winner AS (SELECT vec_id, output, c AS votes, n_votes FROM ranked WHERE pos = 1)"""


def model_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, rank, output) for the 11 models; a generator over the model ranks, not a join."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    m = F.col("rank")
    pick = F.when((F.col("vec_id") + m * 7) % 4 == 0, (F.col("label") + m) % 3 + 1).otherwise(
        (F.col("label") * m + F.col("vec_id")) % 3 + 1)
    return e.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("rank")).select(
        "vec_id", "rank", F.concat(F.lit("inference_"), pick.cast("string")).alias("output"))


def fold_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    f = F.col("rank")
    pick = F.when((F.col("vec_id") + f) % 3 == 0, F.col("label") % 3 + 1).otherwise(
        (F.col("vec_id") + F.col("label") * f) % 3 + 1)
    return e.select("vec_id", "label", F.explode(F.sequence(F.lit(1), F.lit(N_FOLDS))).alias("rank")).select(
        "vec_id", "rank", F.concat(F.lit("inference_"), pick.cast("string")).alias("output"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    return e.select("vec_id", "label", F.concat(F.lit("inference_"), (F.col("label") % 3 + 1).cast("string"))
                    .alias("output"))


@register("hard_vote", "A13, J6, O4 (11 prediction sets, earliest rank wins ties)",
          oracle=f"WITH {_VOTES_SQL}, {_WINNER_SQL} SELECT vec_id, output, votes, n_votes FROM winner")
def hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.hard_vote(model_votes(spark, sf_dir), "vec_id", "output", "rank")


@register("fold_vote", "A12 (vote over K fold predictions)",
          oracle=f"WITH {_FOLD_VOTES_SQL}, {_WINNER_SQL} SELECT vec_id, output, votes, n_votes FROM winner")
def fold_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.hard_vote(fold_votes(spark, sf_dir), "vec_id", "output", "rank")


@register("vote_accuracy", "A14 per gold label", oracle=f"""WITH {_VOTES_SQL}, {_WINNER_SQL},
g AS (SELECT vec_id, label, concat('inference_', label % 3 + 1) AS gold FROM embeddings)
SELECT g.label, count(*) AS n, CAST(sum(CAST(w.output = g.gold AS BIGINT)) AS BIGINT) AS n_correct,
       sum(CAST(w.output = g.gold AS BIGINT)) / count(*) AS accuracy
FROM winner w JOIN g USING (vec_id) GROUP BY g.label""")
def vote_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = vote.hard_vote(model_votes(spark, sf_dir), "vec_id", "output", "rank")
    return vote.accuracy(voted, _gold(spark, sf_dir), "vec_id", "output", "label")


@register("vote_submission", "J7, I5 (attach by id)", oracle=f"""WITH {_VOTES_SQL}, {_WINNER_SQL}
SELECT e.vec_id, e.label, w.output FROM embeddings e LEFT JOIN winner w USING (vec_id)""")
def vote_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    submission = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"]).withColumn("output", F.lit(""))
    voted = vote.hard_vote(model_votes(spark, sf_dir), "vec_id", "output", "rank")
    return vote.attach_predictions(submission, voted, "vec_id", "output")


@register("validate_predictions", "J9 (per prediction set: missing, extra, duplicated ids)", oracle="""
WITH sub AS (SELECT DISTINCT doc_id FROM documents),
preds AS (SELECT 'quality' AS model, doc_id FROM labels UNION ALL SELECT 'toxic', doc_id FROM labels
          UNION ALL SELECT 'all', doc_id FROM documents),
per AS (SELECT model, doc_id, count(*) AS k FROM preds GROUP BY model, doc_id),
known AS (SELECT per.*, sub.doc_id IS NOT NULL AS inside FROM per LEFT JOIN sub USING (doc_id))
SELECT model, CAST(sum(k) AS BIGINT) AS n_rows, (SELECT count(*) FROM sub) - count(*) FILTER (WHERE inside) AS n_missing,
       count(*) FILTER (WHERE NOT inside) AS n_extra, count(*) FILTER (WHERE k > 1) AS n_duplicate_ids
FROM known GROUP BY model""")
def validate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id"])
    preds = (labels.select(F.lit("quality").alias("model"), "doc_id")
             .unionByName(labels.select(F.lit("toxic").alias("model"), "doc_id"))
             .unionByName(docs.select(F.lit("all").alias("model"), "doc_id")))
    return vote.validate_prediction_sets(docs, preds, "doc_id", "model").select(
        "model", F.col("n_rows").cast("bigint").alias("n_rows"), "n_missing", "n_extra", "n_duplicate_ids")


_SCORES_SQL = """s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
                     CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
m AS (SELECT *, greatest(a, b, c) AS mx FROM s),
x AS (SELECT *, exp(a - mx) AS ea, exp(b - mx) AS eb, exp(c - mx) AS ec FROM m),
p AS (SELECT vec_id, round(ea / (ea + eb + ec), 6) AS p_a, round(eb / (ea + eb + ec), 6) AS p_b,
             round(ec / (ea + eb + ec), 6) AS p_c,
             CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred FROM x)"""


@register("score_labels", "I2, M1, M2, O3, J5 (first three embedding values as A/B/C scores)",
          oracle=f"""WITH {_SCORES_SQL}
SELECT vec_id, p_a, p_b, p_c, CAST(pred AS INTEGER) AS pred, concat('inference_', pred + 1) AS output FROM p""")
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    scores = e.select("vec_id", *[F.get("embedding", i).alias(f"s{i}") for i in range(3)])
    return predict_from_scores(scores, ["s0", "s1", "s2"], ["vec_id"], round_digits=6)


def _first_three_scorer():
    """Deterministic stand-in for a model: the first three embedding values are the A/B/C logits."""
    import numpy as np

    def score(pdf):
        return np.stack([np.asarray(v[:3], dtype="float64") for v in pdf["embedding"]]) if len(pdf) else \
            np.zeros((0, 3))
    return score


@register("batch_scores", "I1, I2 (scorer in mapInPandas, Arrow batches)",
          oracle=f"""WITH {_SCORES_SQL}
SELECT vec_id, CAST(pred AS INTEGER) AS pred, concat('inference_', pred + 1) AS output FROM p""")
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    scored = score_batches(e, _first_three_scorer, ["vec_id"])
    return predict_from_scores(scored, ["s_a", "s_b", "s_c"], ["vec_id"]).select("vec_id", "pred", "output")


def _fold_scorer(fold: int):
    """Deterministic stand-in for the model of a fold: three embedding values from place ``fold`` on are the logits."""
    import numpy as np

    def score(pdf):
        return np.stack([np.asarray(v[fold:fold + 3], dtype="float64") for v in pdf["embedding"]]) if len(pdf) else \
            np.zeros((0, 3))
    return score


def _scored_folds(spark: SparkSession, sf_dir: str) -> str:
    """Every embedding scored by the model of each fold; the name whose fold files hold the predictions."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    output = f"{scratch_folder(spark, 'fold-scores')}/model.json"
    predict_folds(e, _fold_scorer, output, N_FOLDS, id_col="vec_id")
    return output


_FOLD_SCORES_SQL = f"""s AS (SELECT vec_id, f, embedding[f + 1] AS a, embedding[f + 2] AS b, embedding[f + 3] AS c
      FROM embeddings, range(1, {N_FOLDS + 1}) r(f)),
votes AS (SELECT vec_id, f AS rank, CASE WHEN a >= b AND a >= c THEN 'inference_1' WHEN b >= c THEN 'inference_2'
          ELSE 'inference_3' END AS output FROM s)"""


@register("fold_scores", "I3, S6, S7, S9 (a model per fold, one scoring pass, one prediction set per fold, read back)",
          oracle=f"""WITH {_FOLD_SCORES_SQL}
SELECT vec_id, CAST(rank AS INTEGER) AS rank, concat('fold_', rank) AS model, output FROM votes""")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_fold_predictions(spark, _scored_folds(spark, sf_dir), N_FOLDS)
    return found.select(F.col("id").cast("bigint").alias("vec_id"), "rank", "model", "output")


@register("fold_submission", "I3, J9, A12, J7, I5 (fold sets scored, written, checked, voted and attached)",
          oracle=f"""WITH {_FOLD_SCORES_SQL}, {_WINNER_SQL}
SELECT e.vec_id, w.output FROM embeddings e LEFT JOIN winner w USING (vec_id)""")
def fold_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    submission = read_table(spark, sf_dir, "embeddings", ["vec_id"]).select(
        F.col("vec_id").cast("string").alias("id"), F.lit("").alias("output"))
    voted = ensemble(spark, submission, k_folds=N_FOLDS, output=_scored_folds(spark, sf_dir))
    return voted.select(F.col("id").cast("bigint").alias("vec_id"), "output")
