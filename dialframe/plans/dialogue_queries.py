"""Driver queries for cleaning, merging and per-dialogue lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.functions.text import clean_utterance, code_point_length
from dialframe.operators.turns import (clean_and_drop_empty, merge_examples, merge_turns, total_characters,
                                       turn_count)
from dialframe.plans.oracle_sql import CLEAN_STAGES, MERGE_STAGES, NOISE_VIEW
from dialframe.plans.registry import register
from dialframe.sources.tables import noise_utterances, read_table


def refined_turns_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean + drop empty + merge over the utterance view (the refine job)."""
    raw = noise_utterances(spark, sf_dir)
    # Long conversations are found by the raw rows: their texts are cleaned once.
    return merge_turns(clean_and_drop_empty(raw, "text"), "conv_id", "turn", counted=raw).withColumnRenamed(
        "turn", "start_turn")


@register("clean_text", "C0-C12", oracle=f"""
WITH v AS ({NOISE_VIEW}), {CLEAN_STAGES}
SELECT conv_id, turn, speaker, utterance_id, is_ref, text FROM cleaned
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = noise_utterances(spark, sf_dir)
    return u.select("conv_id", "turn", "speaker", "utterance_id", "is_ref", clean_utterance("text").alias("text"))


@register("refined_turns", "C0-C12, F1, W1, W4, P7", oracle=f"""
WITH v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES}
SELECT conv_id, start_turn, speaker, text, utterance_ids, n_turns FROM merged
""")
def refined_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = refined_turns_df(spark, sf_dir)
    return m.select("conv_id", "start_turn", "speaker", "text",
                    F.array_join("utterance_ids", ",").alias("utterance_ids"), "n_turns")


@register("merge_events", "W1 on a long sequence (events per user)", oracle="""
WITH e AS (SELECT user_id, ts, event_id, event_type, props, event_type = 'purchase' AS is_ref FROM events),
m AS (SELECT *, lag(event_type) OVER w AS pt, lag(is_ref) OVER w AS pr, row_number() OVER w AS rn
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN rn = 1 OR event_type <> pt OR is_ref OR pr THEN 1 ELSE 0 END AS brk FROM m),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS start_event_id, min(event_type) AS event_type,
       string_agg(props, ' ' ORDER BY ts, event_id) AS text,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS event_ids,
       count(*) AS n_events
FROM r GROUP BY user_id, run
""")
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_id", "event_type", "props"])
    e = e.withColumn("is_ref", F.col("event_type") == F.lit("purchase"))
    # Users of many events (a third of all, say) are cut into ranges of their order.
    m = merge_turns(e, "user_id", ["ts", "event_id"], speaker="event_type", text="props", uid="event_id",
                    chunk="quantile")
    return m.select("user_id", F.col("event_id").alias("start_event_id"), "event_type", F.col("props").alias("text"),
                    F.array_join("utterance_ids", ",").alias("event_ids"), F.col("n_turns").alias("n_events"))


@register("dialogue_lengths", "P3, P4 raw and refined, A6 change counts", oracle=f"""
WITH v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES},
raw AS (SELECT conv_id, count(*) AS n_turns_raw,
               CAST(sum(length(coalesce(text, 'None'))) AS BIGINT) AS chars_raw FROM v GROUP BY conv_id),
ref AS (SELECT conv_id, count(*) AS n_turns_refined, CAST(sum(length(text)) AS BIGINT) AS chars_refined
        FROM merged GROUP BY conv_id)
SELECT raw.conv_id, n_turns_raw, chars_raw,
       coalesce(n_turns_refined, 0) AS n_turns_refined, coalesce(chars_refined, 0) AS chars_refined,
       CASE WHEN coalesce(chars_refined, 0) < chars_raw THEN 'shorter'
            WHEN coalesce(chars_refined, 0) = chars_raw THEN 'same' ELSE 'longer' END AS change
FROM raw LEFT JOIN ref ON raw.conv_id = ref.conv_id
""")
def dialogue_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c_raw, c_ref = F.col("chars_raw"), F.col("chars_refined")
    change = F.when(c_ref < c_raw, "shorter").when(c_ref == c_raw, "same").otherwise("longer")
    return conversation_lengths(spark, sf_dir).withColumn("change", change)


def raw_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns_raw, chars_raw: no cleaning, one partial aggregate."""
    return noise_utterances(spark, sf_dir).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns_raw"),
        F.sum(code_point_length(F.coalesce("text", F.lit("None")))).alias("chars_raw"))


def conversation_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id with turns and characters, raw and refined, from one scan and one exchange.

    Rows are cleaned before the exchange, carry their raw form with them, and each
    conversation is merged inside its row.
    """
    u = noise_utterances(spark, sf_dir).select("conv_id", F.struct(
        "turn", "speaker", F.coalesce("text", F.lit("None")).alias("raw"),
        clean_utterance(F.col("text")).alias("utterance"), "utterance_id", "is_ref").alias("u"))
    rows = u.groupBy("conv_id").agg(F.array_sort(F.collect_list("u")).alias("items"))
    raw = F.transform("items", lambda x: F.struct(x["raw"].alias("utterance")))
    turn = F.transform(F.filter("items", lambda x: x["utterance"] != F.lit("")), lambda x: F.struct(
        x["speaker"].alias("speaker"), x["utterance"].alias("utterance"), x["utterance_id"].alias("utterance_id")))
    refs = F.transform(F.filter("items", lambda x: x["is_ref"]), lambda x: x["utterance_id"])
    merged = merge_examples(rows.select("conv_id", raw.alias("raw"), turn.alias("conversation"),
                                        refs.alias("reference_id")), ids_are_arrays=False)
    return merged.select(
        "conv_id", turn_count(F.col("raw")).alias("n_turns_raw"), total_characters(F.col("raw")).alias("chars_raw"),
        turn_count(F.col("conversation")).alias("n_turns_refined"),
        total_characters(F.col("conversation")).alias("chars_refined"))


@register("reference_turns", "P5, J1 (left-semi join of runs on reference ids)", oracle=f"""
WITH v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES}
SELECT conv_id, start_turn, speaker, text FROM merged
WHERE n_turns = 1 AND (conv_id, utterance_ids) IN (SELECT (conv_id, utterance_id) FROM v WHERE is_ref)
""")
def reference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = noise_utterances(spark, sf_dir).where("is_ref").select("conv_id", "utterance_id")
    runs = refined_turns_df(spark, sf_dir).where(F.size("utterance_ids") == 1).select(
        "conv_id", "start_turn", "speaker", "text", F.get("utterance_ids", 0).alias("utterance_id"))
    return runs.join(refs, ["conv_id", "utterance_id"], "left_semi").select("conv_id", "start_turn", "speaker", "text")


@register("merge_event_stream", "W1 with one key holding every row (skew: chunks by ranges of the order)", oracle="""
WITH e AS (SELECT ts, event_id, event_type, props, event_type = 'purchase' AS is_ref FROM events),
m AS (SELECT *, lag(event_type) OVER w AS pt, lag(is_ref) OVER w AS pr, row_number() OVER w AS rn
      FROM e WINDOW w AS (ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN rn = 1 OR event_type <> pt OR is_ref OR pr THEN 1 ELSE 0 END AS brk FROM m),
r AS (SELECT *, sum(brk) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT arg_min(event_id, (ts, event_id)) AS start_event_id, min(event_type) AS event_type,
       string_agg(props, ' ' ORDER BY ts, event_id) AS text,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS event_ids,
       count(*) AS n_events
FROM r GROUP BY run
""")
def merge_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All events form a single sequence: the one key holds every row, and ranges of the
    # order still cut it into chunks for the window.
    e = read_table(spark, sf_dir, "events", ["ts", "event_id", "event_type", "props"])
    # Not a literal: the optimizer would fold a constant key and send all rows to one task.
    e = e.withColumn("stream", F.col("event_id") * 0).withColumn("is_ref", F.col("event_type") == F.lit("purchase"))
    m = merge_turns(e, "stream", ["ts", "event_id"], speaker="event_type", text="props", uid="event_id",
                    chunk="quantile", hot_rows=1_000)
    return m.select(F.col("event_id").alias("start_event_id"), "event_type", F.col("props").alias("text"),
                    F.array_join("utterance_ids", ",").alias("event_ids"), F.col("n_turns").alias("n_events"))
