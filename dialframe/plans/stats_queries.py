"""Driver queries for corpus statistics (sizes, distributions, summaries, histograms, tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.functions import fixed
from dialframe.functions.text import code_point_length
from dialframe.operators import stats
from dialframe.plans.dialogue_queries import conversation_lengths, raw_lengths, refined_turns_df
from dialframe.plans.oracle_sql import CLEAN_STAGES, EXAMPLES_VIEW, MERGE_STAGES, NOISE_VIEW
from dialframe.plans.registry import register
from dialframe.sources.tables import example_head_columns, example_heads, noise_utterances, read_table

# Oracle pieces --------------------------------------------------------------

_E_ALL = f"""e0 AS ({EXAMPLES_VIEW}),
e AS (SELECT * FROM e0 UNION ALL SELECT * REPLACE ('train+dev' AS split) FROM e0 WHERE split IN ('train', 'dev'))"""

_LENGTHS = f"""v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES},
raw AS (SELECT conv_id, count(*) AS n_turns, CAST(sum(length(coalesce(text, 'None'))) AS BIGINT) AS chars
        FROM v GROUP BY conv_id),
ref AS (SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM merged GROUP BY conv_id),
lens AS (SELECT e.conv_id, e.split, 'raw' AS form, raw.n_turns, raw.chars FROM e JOIN raw USING (conv_id)
         UNION ALL
         SELECT e.conv_id, e.split, 'refined' AS form, coalesce(ref.n_turns, 0), coalesce(ref.chars, 0)
         FROM e JOIN raw USING (conv_id) LEFT JOIN ref USING (conv_id))"""


def _hist_sql(src: str, group: str, value: str, step: int) -> str:
    return f"""{src},
mx AS (SELECT {group}, greatest(CAST(ceil(max({value}) / {step}) AS BIGINT), 1) AS nb FROM x GROUP BY {group}),
bins AS (SELECT {group}, CAST(unnest(range(0, nb)) AS BIGINT) AS bin FROM mx),
c AS (SELECT x.{group}, least(x.{value} // {step}, mx.nb - 1) AS bin, count(*) AS n
      FROM x JOIN mx USING ({group}) GROUP BY ALL)
SELECT bins.{group}, bins.bin, bins.bin * {step} AS bin_start, (bins.bin + 1) * {step} AS bin_end,
       coalesce(c.n, 0) AS n
FROM bins LEFT JOIN c USING ({group}, bin)"""


def _squeeze_sql(t: str) -> str:
    for ch in fixed.SQUEEZED_JAMO:
        t = f"regexp_replace({t}, '{ch}+', '{ch * 2}', 'g')"
    return t


def _tokens_sql(src: str, group: str) -> str:
    return f"""{src},
d AS (SELECT DISTINCT {group}, text FROM x),
t AS (SELECT {group}, unnest(string_split(text, ' ')) AS token FROM d),
tn AS (SELECT {group}, {_squeeze_sql('token')} AS token FROM t),
counts AS (SELECT {group}, token, count(*) AS n FROM tn WHERE length(token) > 1 GROUP BY {group}, token)"""


def _top_sql(group: str) -> str:
    return f"""SELECT {group}, token, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, token ASC) AS rank FROM counts)
WHERE rank <= {fixed.TOP_TOKENS}"""


# Spark frames ---------------------------------------------------------------

def _examples_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_combined_split(example_heads(spark, sf_dir))


def _lengths_long(spark: SparkSession, sf_dir: str, form: str | None = None) -> DataFrame:
    """conv_id, split, form (raw / refined), n_turns, chars: one row per example and form.

    Both forms come from one scan and one exchange by conversation; a single
    ``form`` builds that branch only.
    """
    per_conv = raw_lengths(spark, sf_dir) if form == "raw" else conversation_lengths(spark, sf_dir)
    rows = [F.struct(F.lit(f).alias("form"), F.col(f"n_turns_{f}").alias("n_turns"), F.col(f"chars_{f}").alias("chars"))
            for f in ([form] if form else ("raw", "refined"))]
    # The head fields are functions of conv_id: no second scan for the example heads.
    split = example_head_columns(F.col("conv_id"))[-1]
    return stats.with_combined_split(per_conv.select("conv_id", split, F.inline(F.array(*rows))))


def _texts_by_split(rows: DataFrame) -> DataFrame:
    """Distinct texts with the splits of their examples (a function of conv_id: no join), train+dev included."""
    split = example_head_columns(F.col("conv_id"))[-1]
    return stats.texts_with_groups(rows.select("text", split), "text", "split", ("train", "dev"), "train+dev")


def _refined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts_by_split(refined_turns_df(spark, sf_dir).select("conv_id", "text"))


# Queries --------------------------------------------------------------------

@register("split_sizes", "A1, U1", oracle=f"WITH {_E_ALL} SELECT split, count(*) AS n FROM e GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split_sizes(_examples_all(spark, sf_dir))


@register("category_distribution", "A2, A4", oracle=f"""WITH {_E_ALL},
c AS (SELECT split, category, count(*) AS n FROM e GROUP BY split, category),
t AS (SELECT split, count(*) AS total FROM e GROUP BY split)
SELECT split, category, n, n / total * 100.0 AS pct FROM c JOIN t USING (split)""")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_examples_all(spark, sf_dir), "category", "split")


@register("output_distribution", "A3, A4, J8, O2", oracle=f"""WITH {_E_ALL},
k(output, key_pos) AS (VALUES ('inference_1', 0), ('inference_2', 1), ('inference_3', 2)),
t AS (SELECT split, count(*) AS total FROM e GROUP BY split),
c AS (SELECT split, output, count(*) AS n FROM e GROUP BY split, output)
SELECT t.split, k.output, k.key_pos, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / t.total * 100.0 AS pct
FROM t JOIN k ON true LEFT JOIN c ON c.split = t.split AND c.output = k.output""")
def output_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fixed_key_distribution(_examples_all(spark, sf_dir), "output", fixed.ANSWER_KEYS, "split")


@register("role_distribution", "A2, A4 (no group)", oracle="""
SELECT role, count(*) AS n, count(*) / (SELECT count(*) FROM conversations) * 100.0 AS pct
FROM conversations GROUP BY role""")
def role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(read_table(spark, sf_dir, "conversations", ["role"]), "role")


@register("label_distribution", "A4 over label fields", oracle="""
WITH l AS (SELECT 'quality' AS field, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels),
c AS (SELECT field, value, count(*) AS n FROM l GROUP BY field, value),
t AS (SELECT field, count(*) AS total FROM l GROUP BY field)
SELECT field, value, n, n / total * 100.0 AS pct FROM c JOIN t USING (field)""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", ["quality", "toxic"])
    long = labels.select(F.inline(F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").alias("value")),
                                          F.struct(F.lit("toxic").alias("field"), F.col("toxic").alias("value")))))
    return stats.distribution(long, "value", "field")


@register("length_summary", "A5, A6, A7 (raw and refined, per split)", oracle=f"""WITH {_E_ALL}, {_LENGTHS}
SELECT split, form, count(*) AS n_examples, sum(n_turns) / count(*) AS avg_turns,
       CAST(sum(chars) AS BIGINT) AS total_chars, sum(chars) / count(*) AS avg_chars,
       min(chars) AS min_chars, max(chars) AS max_chars
FROM lens GROUP BY split, form""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lengths_long(spark, sf_dir)
    return lens.groupBy("split", "form").agg(
        F.count(F.lit(1)).alias("n_examples"), (F.sum("n_turns") / F.count(F.lit(1))).alias("avg_turns"),
        F.sum("chars").alias("total_chars"), (F.sum("chars") / F.count(F.lit(1))).alias("avg_chars"),
        F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"))


@register("turn_histogram", "A8 (step 1, turns per example)", oracle=_hist_sql(
    f"WITH {_E_ALL}, {_LENGTHS}, x AS (SELECT split, n_turns FROM lens WHERE form = 'raw')", "split", "n_turns",
    fixed.TURN_HISTOGRAM_STEP))
def turn_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lengths_long(spark, sf_dir, "raw")
    return stats.histogram(lens, "n_turns", fixed.TURN_HISTOGRAM_STEP, "split")


@register("char_histogram", "A8 (step 50, characters per example)", oracle=_hist_sql(
    f"WITH {_E_ALL}, {_LENGTHS}, x AS (SELECT split, chars FROM lens WHERE form = 'raw')", "split", "chars",
    fixed.CHAR_HISTOGRAM_STEP))
def char_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = _lengths_long(spark, sf_dir, "raw")
    return stats.histogram(lens, "chars", fixed.CHAR_HISTOGRAM_STEP, "split")


@register("refined_turn_histogram", "A8 (step 1, refined form)", oracle=_hist_sql(
    f"WITH {_E_ALL}, {_LENGTHS}, x AS (SELECT split, n_turns FROM lens WHERE form = 'refined')", "split", "n_turns",
    fixed.TURN_HISTOGRAM_STEP))
def refined_turn_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_lengths_long(spark, sf_dir, "refined"), "n_turns", fixed.TURN_HISTOGRAM_STEP, "split")


@register("refined_char_histogram", "A8 (step 50, refined form)", oracle=_hist_sql(
    f"WITH {_E_ALL}, {_LENGTHS}, x AS (SELECT split, chars FROM lens WHERE form = 'refined')", "split", "chars",
    fixed.CHAR_HISTOGRAM_STEP))
def refined_char_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_lengths_long(spark, sf_dir, "refined"), "chars", fixed.CHAR_HISTOGRAM_STEP, "split")


@register("document_char_histogram", "P4, A8 over documents", oracle=_hist_sql(
    "WITH x AS (SELECT lang, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL)",
    "lang", "chars", fixed.CHAR_HISTOGRAM_STEP))
def document_char_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["lang", "text"]).select("lang", code_point_length("text").alias("chars"))
    return stats.histogram(docs, "chars", fixed.CHAR_HISTOGRAM_STEP, "lang")


@register("document_length_summary", "P4, A7 over documents", oracle="""
SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total, sum(length(text)) / count(*) AS mean,
       CAST(min(length(text)) AS BIGINT) AS min, CAST(max(length(text)) AS BIGINT) AS max
FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def document_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["lang", "text"]).where(F.col("text").isNotNull())
    return stats.length_summary(docs.select("lang", code_point_length("text").alias("chars")), "chars", "lang")


@register("distinct_utterances", "A9, U3", oracle=f"""WITH {_E_ALL}, v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES}
SELECT DISTINCT e.split, merged.text FROM merged JOIN e USING (conv_id)""")
def distinct_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined_texts(spark, sf_dir).select(F.explode("groups").alias("split"), "text")


@register("distinct_documents", "A9 over documents (counts)", oracle="""
SELECT lang, count(*) AS n_rows, count(DISTINCT text) AS n_distinct FROM documents GROUP BY lang""")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["lang", "text"])
    # Texts are only told apart: a 256-bit digest is the shuffle key, not the text.
    digests = docs.select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    per_text = digests.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("_k"))
    return per_text.groupBy("lang").agg(F.sum("_k").alias("n_rows"),
                                        F.count("digest").alias("n_distinct"))


@register("utterance_token_counts", "A10, N1-N7, F3 (refined utterances per split)", oracle=_tokens_sql(
    f"WITH {_E_ALL}, v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES}, "
    "x AS (SELECT e.split, merged.text FROM merged JOIN e USING (conv_id))", "split")
    + " SELECT split, token, n FROM counts")
def utterance_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_counts(_refined_texts(spark, sf_dir), "text", "split", groups="groups")


@register("top_utterance_tokens", "A11, O1", oracle=_tokens_sql(
    f"WITH {_E_ALL}, v AS ({NOISE_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES}, "
    "x AS (SELECT e.split, merged.text FROM merged JOIN e USING (conv_id))", "split") + " " + _top_sql("split"))
def top_utterance_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.token_counts(_refined_texts(spark, sf_dir), "text", "split", groups="groups")
    return stats.top_tokens(counts, fixed.TOP_TOKENS, "split")


@register("raw_token_counts", "A10, N1-N7, F3 on raw utterances with jamo runs", oracle=_tokens_sql(
    f"WITH {_E_ALL}, v AS ({NOISE_VIEW}), "
    "x AS (SELECT e.split, v.text FROM v JOIN e USING (conv_id) WHERE v.text IS NOT NULL)", "split")
    + " SELECT split, token, n FROM counts")
def raw_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = noise_utterances(spark, sf_dir).where(F.col("text").isNotNull()).select("conv_id", "text")
    return stats.token_counts(_texts_by_split(rows), "text", "split", groups="groups")


@register("output_counts", "A3 (every value, the blank one too)", oracle=f"""WITH {_E_ALL}
SELECT split, output, count(*) AS n FROM e GROUP BY split, output""")
def output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(_examples_all(spark, sf_dir), "output", "split")


@register("document_token_counts", "A10, N1-N7, F3 over documents", oracle=_tokens_sql(
    "WITH x AS (SELECT lang, text FROM documents)", "lang") + " SELECT lang, token, n FROM counts")
def document_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_counts(read_table(spark, sf_dir, "documents", ["lang", "text"]), "text", "lang")


@register("frequent_document_tokens", "A11, O1 over documents, by mergeable summaries and an exact recount",
          oracle=_tokens_sql("WITH x AS (SELECT lang, text FROM documents)", "lang") + " " + _top_sql("lang"))
def frequent_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequent_tokens(read_table(spark, sf_dir, "documents", ["lang", "text"]), fixed.TOP_TOKENS, "text", "lang")


@register("top_document_tokens", "A11, O1 over documents", oracle=_tokens_sql(
    "WITH x AS (SELECT lang, text FROM documents)", "lang") + " " + _top_sql("lang"))
def top_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.token_counts(read_table(spark, sf_dir, "documents", ["lang", "text"]), "text", "lang")
    return stats.top_tokens(counts, fixed.TOP_TOKENS, "lang")
