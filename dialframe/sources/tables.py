"""Parquet table access and the derived views over the driver tables.

The driver tables carry no Korean text and never two equal roles in a row, so
the dialogue operators are exercised through two deterministic views whose
work grows with the tables:

* ``noise_utterances``: every ``conversations`` row, its whole text kept behind a
  Korean prefix, and after it one row of Korean noise, with derived turn, speaker,
  utterance id and reference flag;
* ``example_heads``: one example per conversation with a category, three
  candidate sentences, a gold output and a split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.session import default_parallelism, num_partitions


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None,
               spread: bool = False) -> DataFrame:
    """Read one parquet table; selecting columns here lets the scan prune the rest.

    ``spread`` is for inputs that feed CPU-heavy row work (regex cleaning,
    tokenizing): when the scan yields fewer splits than the default parallelism
    (a small file with one row group), rows are dealt round-robin to that many
    partitions.  A large input already has enough splits and is left alone.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    if spread:
        want = default_parallelism(spark)
        if num_partitions(df, want) < want:
            df = df.repartition(want)
    return df


# FIXED VALUES: prefix of a text and noise row after it, by (conv_id * 3 + turn) % 8
NOISE_CASES = (
    ("", "ㅇㅇ ㅇㅇ 조심해"),
    ("안녕하세요 name1입니다~ ", None),
    ("(웃음) 진짜????? ", "ㅋㅋㅋㅋ ㅎㅎㅎ 웃겨 ㄱㄱㄱ"),
    ("", "ㅋㄱㅋㄲㅋ"),
    ("name_2!  그래....... ㅠㅡㅠ ", "반갑습니당 저는 name2 ㅠㅠ"),
    ("ㅇㅋㅋ ", "^^ OK."),
    ("저안녕 ", "네"),
    ("", "ㄴㄴ ㄷㄷㄷ ㅇㅇㅇ 그래 ㅎ"),
)


def noise_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as utterances: conv_id, turn, speaker, utterance_id, is_ref, text.

    Turn ``t`` gives the rows ``2 t`` (prefix and whole text) and ``2 t + 1`` (noise).
    """
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"], spread=True)
    cases = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(n).cast("string").alias("noise"))
                      for p, n in NOISE_CASES])
    case = F.get(cases, ((F.col("conv_id") * 3 + F.col("turn")) % 8).cast("int"))
    staged = c.withColumn("case", case)
    odd = F.length("text") % 2
    rows = F.array(
        F.struct((F.col("turn") * 2).alias("turn"), (odd + 1).cast("int").alias("speaker"),
                 F.concat(F.col("case")["prefix"], F.col("text")).alias("text")),
        F.struct((F.col("turn") * 2 + 1).alias("turn"),
                 ((odd + (F.col("conv_id") + F.col("turn")) % 2) % 2 + 1).cast("int").alias("speaker"),
                 F.col("case")["noise"].alias("text")))
    u = staged.select("conv_id", F.inline(rows))
    return u.select(
        "conv_id", "turn", "speaker",
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utterance_id"),
        ((F.col("conv_id") + F.col("turn")) % 5 == 3).alias("is_ref"), "text")


# FIXED VALUES: category by conv_id % 5, in this order
_VIEW_CATEGORIES = ("원인", "후행사건", "전제", "동기", "반응")


def example_head_columns(conv_id: Column) -> list[Column]:
    """Head fields of the example of a conversation: category, inference_1..3, output, split."""
    cid = conv_id
    cat = None
    for i, name in enumerate(_VIEW_CATEGORIES):
        cat = F.when(cid % 5 == i, F.lit(name)) if cat is None else cat.when(cid % 5 == i, F.lit(name))
    return [
        cat.alias("category"),
        F.concat(F.lit("후보 가"), (cid % 7).cast("string")).alias("inference_1"),
        F.concat(F.lit("후보 나"), (cid % 5).cast("string")).alias("inference_2"),
        F.concat(F.lit("후보 다"), (cid % 3).cast("string")).alias("inference_3"),
        F.when(cid % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("inference_"), (cid % 3 + 1).cast("string"))).alias("output"),
        F.when(cid % 10 < 7, F.lit("train")).when(cid % 10 < 8, F.lit("dev")).otherwise(F.lit("test")).alias("split"),
    ]


def example_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example head per conversation: conv_id, category, inference_1..3, output, split."""
    ids = read_table(spark, sf_dir, "conversations", ["conv_id"]).distinct()
    return ids.select("conv_id", *example_head_columns(F.col("conv_id")))
