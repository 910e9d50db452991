"""Driver queries that write a given table's rows to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.operators import stats, vote
from dialframe.operators.folds import fold_roles, kfold
from dialframe.operators.turns import example_lengths, flatten_conversation, refine_examples
from dialframe.plans.oracle_sql import CLEAN_STAGES, EXAMPLES_VIEW, MERGE_STAGES, NOISE_VIEW
from dialframe.plans.prompt_queries import examples_nested
from dialframe.plans.registry import register
from dialframe.plans.vote_queries import N_MODELS, _VOTES_SQL, model_votes
from dialframe.session import scratch_folder
from dialframe.sources.jsonio import (ingest_examples, read_examples, read_ingested,
                                      read_prediction_sets, recipe_names, write_examples_array, write_examples_json,
                                      write_lengths_csv, write_prediction_sets)
from dialframe.sources.tables import read_table

K_FOLDS = 7


def file_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example view in the layout of the files: text ids, ids of an utterance as an array."""
    ex = examples_nested(spark, sf_dir)
    return ex.withColumns({
        "id": F.col("conv_id").cast("string"),
        "conversation": F.transform("conversation", lambda u: F.struct(
            u["speaker"].alias("speaker"), u["utterance"].alias("utterance"),
            F.array(u["utterance_id"]).alias("utterance_id")))}).drop("conv_id")


def _turns(examples: DataFrame) -> DataFrame:
    flat = flatten_conversation(examples, keep=("id", "split", "category", "output"))
    return flat.select(F.col("id").cast("bigint").alias("conv_id"), "split", "category", "output", "pos", "speaker",
                       "utterance", F.array_join("utterance_id", ",").alias("utterance_ids"))


@register("example_files", "S1, S2, S3, P1, P7, JS1 (raw examples as JSON arrays per split, read in byte ranges)",
          oracle=f"""
WITH v AS ({NOISE_VIEW}), e AS ({EXAMPLES_VIEW})
SELECT conv_id, split, category, output,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, speaker,
       text AS utterance, utterance_id AS utterance_ids
FROM v JOIN e USING (conv_id)""")
def example_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "example-files")
    write_examples_array(file_examples(spark, sf_dir), path)
    return _turns(read_examples(spark, path, glob="*.txt"))


_REFINED = f"""v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES}, e AS ({EXAMPLES_VIEW})"""


def _refined_folder(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_folder(spark, "refined-files")
    write_examples_json(refine_examples(file_examples(spark, sf_dir)), path)
    return path


@register("refined_files", "S3, S4, P7, JS1 (refined examples as JSON Lines per split, ingested, two splits read)",
          oracle=f"""
WITH {_REFINED}
SELECT conv_id, split, category, output,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY start_turn) - 1 AS INTEGER) AS pos, speaker,
       text AS utterance, utterance_ids
FROM merged JOIN e USING (conv_id) WHERE split IN ('train', 'dev')""")
def refined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    dest = scratch_folder(spark, "ingested")
    ingest_examples(spark, _refined_folder(spark, sf_dir), dest, multi_line=False)
    return _turns(read_ingested(spark, dest, ["train", "dev"]))


@register("length_files", "S5, P4 (lengths per example as CSV, read back)", oracle=f"""
WITH v AS ({NOISE_VIEW})
SELECT conv_id, CAST(sum(length(coalesce(text, 'None'))) AS BIGINT) AS total_utterance_length FROM v GROUP BY conv_id""")
def length_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "length-files")
    write_lengths_csv(example_lengths(file_examples(spark, sf_dir)), path)
    return (spark.read.option("header", True).schema("id long, total_utterance_length long").csv(path)
            .withColumnRenamed("id", "conv_id"))


_NAMES_SQL = ", ".join(f"({i}, '{n}')" for i, n in enumerate(recipe_names()))


@register("recipe_vote", "S6, S8, S10, U2, A13 (the recipe's prediction sets written in one pass, read in order, voted)",
          oracle=f"""
WITH {_VOTES_SQL}, names(rank, model) AS (VALUES {_NAMES_SQL}),
per AS (SELECT vec_id, output, count(*) AS c, min(rank) AS r FROM votes GROUP BY vec_id, output),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, r) AS pos FROM per)
SELECT vec_id, output, c AS votes, model AS first_model FROM w JOIN names ON names.rank = w.r WHERE pos = 1""")
def recipe_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, names = scratch_folder(spark, "recipe-sets"), recipe_names()
    assert len(names) == N_MODELS
    write_prediction_sets(model_votes(spark, sf_dir).withColumn("rank", F.col("rank") + 1), base, names, id_col="vec_id")
    sets = read_prediction_sets(spark, base, names)
    won = vote.hard_vote(sets)
    # The earliest set with the winning label: one row per id and label, joined by both.
    first = sets.groupBy("id", "output").agg(F.min_by("model", "rank").alias("first_model"))
    return won.join(first, ["id", "output"]).select(F.col("id").cast("bigint").alias("vec_id"), "output", "votes",
                                                    "first_model")


@register("fold_files", "W2, K1, K2 (documents folded, written by fold, one round read back)", oracle=f"""
WITH i AS (SELECT lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
f AS (SELECT lang, n_chars, CASE WHEN i < (n % {K_FOLDS}) * (n // {K_FOLDS} + 1) THEN i // (n // {K_FOLDS} + 1)
        ELSE n % {K_FOLDS} + (i - (n % {K_FOLDS}) * (n // {K_FOLDS} + 1)) // (n // {K_FOLDS}) END + 1 AS fold FROM i)
SELECT CASE WHEN fold = 3 THEN 'validation' ELSE 'train' END AS role, lang, count(*) AS n,
       CAST(sum(n_chars) AS BIGINT) AS n_chars FROM f GROUP BY ALL""")
def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "fold-files")
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"])
    kfold(docs, "doc_id", K_FOLDS).write.partitionBy("fold").parquet(path)
    rounds = fold_roles(spark.read.parquet(path), K_FOLDS).where("round = 3")
    return rounds.groupBy("role", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@register("percent_table", "N13, A4 (percentages as they are displayed)", oracle="""
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang)
SELECT lang, source, n, printf('%.2f%%', n / total * 100.0) AS pct FROM c JOIN t USING (lang)""")
def percent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["lang", "source"])
    return stats.distribution(docs, "source", "lang").withColumn("pct", stats.percent_text("pct"))
