"""Structured Streaming: refine examples as they arrive.

An example is self-contained (its whole conversation is one row), so cleaning
and merging are stateless per row: the same expressions as the batch job run
on a streaming DataFrame, with no watermark or state store.  Long-form
utterance streams get the stateless cleaning + empty-drop step; merging a
long-form stream needs whole conversations and is left to the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialframe.functions.text import DEFAULT_CLEAN, CleanConfig
from dialframe.operators.turns import clean_and_drop_empty, refine_examples
from dialframe.sources.jsonio import EXAMPLE_READ_SCHEMA, _ids_from_variant, to_example_json_columns


def read_example_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Examples as JSON Lines files arriving in ``path`` (one example per line)."""
    r = spark.readStream.schema(EXAMPLE_READ_SCHEMA).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.json(path)
    conv = F.transform("input.conversation", lambda u: F.struct(
        u["speaker"].alias("speaker"), u["utterance"].alias("utterance"),
        _ids_from_variant(u["utterance_id"]).alias("utterance_id")))
    return raw.select(
        "id", F.lit("stream").alias("split"), conv.alias("conversation"),
        F.col("input.reference_id").alias("reference_id"), F.col("input.category").alias("category"),
        F.col("input.inference_1").alias("inference_1"), F.col("input.inference_2").alias("inference_2"),
        F.col("input.inference_3").alias("inference_3"), F.coalesce(F.col("output"), F.lit("")).alias("output"))


def refine_stream(examples: DataFrame, cfg: CleanConfig = DEFAULT_CLEAN) -> DataFrame:
    """Stateless per-row refine of a stream of nested examples."""
    return refine_examples(examples, cfg)


def clean_utterance_stream(utterances: DataFrame, text: str = "text", cfg: CleanConfig = DEFAULT_CLEAN) -> DataFrame:
    """Stateless cleaning + empty drop of a long-form utterance stream."""
    return clean_and_drop_empty(utterances, text, cfg)


def start_refine(spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = True,
                 cfg: CleanConfig = DEFAULT_CLEAN) -> StreamingQuery:
    """Source JSON Lines -> refined JSON Lines; the checkpoint makes restarts exactly-once for the file sink."""
    out = to_example_json_columns(refine_stream(read_example_stream(spark, source), cfg)).drop("split")
    w = out.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
