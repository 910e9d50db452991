"""Corpus pipeline: documents through five stages, each written as Parquet and read by the next.

A stage is ``function(spark, docs, sf_dir) -> DataFrame``.  All but the last
return the columns of ``documents``; extra columns of the input are dropped.

1. ``quality``: documents that the quality rules reject go.
2. ``near_dedup``: of each group of near duplicates the one with the smallest id stays;
   near is a Jaccard similarity of 0.80 or more of the sets of five-word shingles.
3. ``decontaminate``: documents that hold a benchmark window go.
4. ``secrets``: every secret is replaced by a mask; ``n_chars`` follows the text.
5. ``pack``: what is left is packed into sequences; returns its pieces.

Each stage keeps the defined results of its operator for nulls, empty texts,
ties and repeated rows: a null text fails the quality rules; a row without id is
no duplicate; rows that repeat an id are one document, of which near_dedup keeps
one row (the smallest text); an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.llm import decontaminate, hilbert_pack, minhash_dedup, quality_lr, secret_crf
from dialframe.llm.common import materialize, read
from dialframe.llm.queries import tokenizer_path

#: Similarity from which the stage links documents, and its bands: 30 of 4 miss a
#: pair at 0.80 with probability (1 - 0.8^4)^30, 1.4e-7 (24 of 5 would miss 7.3e-5).
NEAR_PERCENT = 80
NEAR_BANDS, NEAR_ROWS = 30, 4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model trained on the labelled ones."""
    docs = docs.select(*COLUMNS)
    model = quality_lr.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_lr.score(docs, model, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    docs = docs.select(*COLUMNS)
    found = minhash_dedup.near_duplicates(docs, NEAR_PERCENT, n_bands=NEAR_BANDS, band_rows=NEAR_ROWS)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    # Ids are unique in a proper table; where one repeats, its smallest row stays.
    rest = [F.col(c) for c in ("text", "lang", "source", "n_chars")]
    one = (docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
           .select("doc_id", "row.*"))
    return one.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    benchmark = read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination(docs.select(*COLUMNS), benchmark, carry=COLUMNS).where("n_hit = 0").select(
        *COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    docs = docs.select(*COLUMNS)
    found = secret_crf.scan(docs, secret_crf.train(docs), carry=COLUMNS)
    masked = secret_crf.redact_documents(found)
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return masked.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return hilbert_pack.pack(docs, tokenizer_path()).drop("ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmark),
          ("secrets", mask_secrets), ("pack", pack)]

#: The verdict of a trained model and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared checkpoint folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
