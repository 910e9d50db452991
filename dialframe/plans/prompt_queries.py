"""Driver queries for prompt building, encoding, padding and fold assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialframe.functions import fixed
from dialframe.operators.encode import encode_examples, length_filter_report as filter_report, pad_batches
from dialframe.operators.folds import fold_roles, kfold, with_global_index
from dialframe.operators.prompts import VARIANTS, build_prompts, to_messages
from dialframe.operators.turns import nest_turns, refine_examples
from dialframe.plans.oracle_sql import CLEAN_STAGES, EXAMPLES_VIEW, MERGE_STAGES, NOISE_VIEW
from dialframe.plans.registry import register
from dialframe.sources.tables import example_head_columns, example_heads, noise_utterances, read_table

EOS = "</s>"
MAX_SOURCE_LEN = 1024
BATCH_SIZE = 4
PAD_ID = 0
K_FOLDS = 5


# Spark frames ---------------------------------------------------------------

def examples_nested(spark: SparkSession, sf_dir: str, refined: bool = False) -> DataFrame:
    """One nested example per conversation, from a single scan of the utterance view.

    The conversation array is nested once, with one exchange; reference ids and
    head fields come from the same row.  ``refined`` cleans and merges inside the
    row (higher-order functions, no shuffle); an example whose utterances all
    clean to empty keeps an empty conversation.
    """
    u = noise_utterances(spark, sf_dir).withColumnRenamed("text", "utterance")
    ex = nest_turns(u, "conv_id", "turn", ["speaker", "utterance", "utterance_id", "is_ref"], chunk=None)
    ex = ex.select("conv_id", "conversation",
                   F.transform(F.filter("conversation", lambda x: x["is_ref"]), lambda x: x["utterance_id"])
                   .alias("reference_id"),
                   *example_head_columns(F.col("conv_id")))
    if refined:
        ex = refine_examples(ex, ids_are_arrays=False)
    return ex


def _prompts(spark: SparkSession, sf_dir: str, names, refined: bool = False) -> DataFrame:
    ex = examples_nested(spark, sf_dir, refined)
    return build_prompts(ex, names, keep=("conv_id",), eos_token=EOS, ids_are_arrays=refined)


# Oracle pieces --------------------------------------------------------------

def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _category_case(idx: int) -> str:
    whens = " ".join(f"WHEN {_lit(row[0])} THEN {_lit(row[idx])}" for row in fixed.CATEGORIES)
    return f"CASE category {whens} END"


def _has_final(x: str) -> str:
    return f"((unicode(right({x}, 1)) - 44032) % 28 + 28) % 28 > 0"


def _user_sql(name: str) -> str:
    v = VARIANTS[name]
    raw = {"category": "category", "term": _category_case(1), "definition": _category_case(2)}[v.subject]
    shown = raw if v.subject == "category" else f"concat('**', {raw}, '**')"
    q = (f"concat(CASE WHEN {_has_final(raw)} THEN concat({_lit(v.lead)}, {shown}, {_lit(v.particles[0])}) "
         f"ELSE {_lit(v.particles[1])} END, {_lit(v.tail)})")
    conv = "conv_block_sep" if v.conversation_label_sep else "conv_block"
    opts = ("concat('[Option]', chr(10), 'A. ', inference_1, chr(10), 'B. ', inference_2, chr(10), "
            "'C. ', inference_3)")
    nl2 = "chr(10) || chr(10)"
    if v.instruction_first:
        return f"concat({q}, {nl2}, {conv}, {nl2}, ref_block, {nl2}, {opts})"
    return f"concat({conv}, {nl2}, ref_block, {nl2}, {q}, {nl2}, {opts})"


_TARGET_SQL = ("CASE output WHEN 'inference_1' THEN concat('A. ', inference_1, " + _lit(EOS) + ") "
               "WHEN 'inference_2' THEN concat('B. ', inference_2, " + _lit(EOS) + ") "
               "WHEN 'inference_3' THEN concat('C. ', inference_3, " + _lit(EOS) + ") ELSE '' END")
_LABEL_SQL = ("CASE output WHEN '' THEN NULL WHEN 'inference_1' THEN 0 WHEN 'inference_2' THEN 1 "
              "WHEN 'inference_3' THEN 2 END")

_RAW_BLOCKS = f"""v AS (SELECT * REPLACE (coalesce(text, 'None') AS text) FROM ({NOISE_VIEW})), e AS ({EXAMPLES_VIEW}),
c AS (SELECT conv_id,
        string_agg(CASE WHEN length(text) > 1 THEN concat(chr(10), '화자', speaker, ': ', text) END, ''
                   ORDER BY turn) AS lines,
        string_agg(CASE WHEN length(text) > 1 THEN concat(chr(10), '화자 ', speaker, ': ', text) END, ''
                   ORDER BY turn) AS lines_sep,
        string_agg(CASE WHEN is_ref AND length(text) > 1 THEN concat(chr(10), '화자', speaker, ': ', text) END, ''
                   ORDER BY turn) AS ref_lines
      FROM v GROUP BY conv_id),
x AS (SELECT e.*, concat('[Conversation]', coalesce(lines, '')) AS conv_block,
             concat('[Conversation]', coalesce(lines_sep, '')) AS conv_block_sep,
             concat('[Utterance References]', coalesce(ref_lines, '')) AS ref_block
      FROM e JOIN c USING (conv_id))"""

_REFINED_BLOCKS = f"""v AS ({NOISE_VIEW}), e AS ({EXAMPLES_VIEW}), {CLEAN_STAGES}, {MERGE_STAGES},
refs AS (SELECT conv_id, utterance_id FROM v WHERE is_ref),
mr AS (SELECT merged.*, (n_turns = 1 AND EXISTS (SELECT 1 FROM refs WHERE refs.conv_id = merged.conv_id
                                                 AND refs.utterance_id = merged.utterance_ids)) AS is_ref_run
       FROM merged),
c AS (SELECT conv_id,
        string_agg(CASE WHEN length(text) > 1 THEN concat(chr(10), '화자', speaker, ': ', text) END, ''
                   ORDER BY start_turn) AS lines,
        string_agg(CASE WHEN length(text) > 1 THEN concat(chr(10), '화자 ', speaker, ': ', text) END, ''
                   ORDER BY start_turn) AS lines_sep,
        string_agg(CASE WHEN is_ref_run AND length(text) > 1 THEN concat(chr(10), '화자', speaker, ': ', text) END,
                   '' ORDER BY start_turn) AS ref_lines
      FROM mr GROUP BY conv_id),
x AS (SELECT e.*, concat('[Conversation]', coalesce(lines, '')) AS conv_block,
             concat('[Conversation]', coalesce(lines_sep, '')) AS conv_block_sep,
             concat('[Utterance References]', coalesce(ref_lines, '')) AS ref_block
      FROM e LEFT JOIN c USING (conv_id))"""


def _prompt_sql(blocks: str, names) -> str:
    parts = [f"SELECT conv_id, '{n}' AS variant, {_user_sql(n)} AS prompt, {_TARGET_SQL} AS target, "
             f"{_LABEL_SQL} AS label FROM x" for n in names]
    return f"WITH {blocks} " + " UNION ALL ".join(parts)


def _codepoints_sql(x: str) -> str:
    return f"list_transform(list_filter(string_split({x}, ''), lambda ch: ch <> ''), lambda ch: unicode(ch))"


_ENCODED_SQL = f"""WITH {_RAW_BLOCKS},
p AS (SELECT conv_id, {_user_sql('v1')} AS prompt, {_TARGET_SQL} AS target, {_LABEL_SQL} AS label FROM x),
s AS (SELECT conv_id, label,
             {_codepoints_sql("concat(" + _lit(fixed.DEFAULT_SYSTEM_TEXT) + ", chr(10), prompt, chr(10))")} AS src,
             {_codepoints_sql('target')} AS tgt FROM p)"""


# Queries --------------------------------------------------------------------

def _make_prompt_query(name: str):
    @register(f"prompt_{name}", "Q1-Q8, J2-J4, N10-N11, P5 (" + name + ")",
              oracle=_prompt_sql(_RAW_BLOCKS, [name]))
    def _q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _prompts(spark, sf_dir, [name]).select(
            "conv_id", "variant", F.col("user").alias("prompt"), "target", "label")
    return _q


for _name in VARIANTS:
    _make_prompt_query(_name)


@register("prompt_refined", "Q1-Q9 on refined examples, several variants in one pass",
          oracle=_prompt_sql(_REFINED_BLOCKS, ["v1", "v5"]))
def prompt_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, ["v1", "v5"], refined=True).select(
        "conv_id", "variant", F.col("user").alias("prompt"), "target", "label")


@register("encoded_examples", "E1, E3-E6, R1, R2 (code-point encoder)", oracle=_ENCODED_SQL + """
SELECT conv_id, CAST(len(src) AS INTEGER) AS n_source, CAST(len(tgt) AS INTEGER) AS n_target,
       array_to_string(list_concat(src, tgt), ' ') AS input_ids,
       array_to_string(list_concat(list_transform(src, lambda t: -100), tgt), ' ') AS labels, label FROM s""")
def encoded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encode_examples(_prompts(spark, sf_dir, ["v1"]), keep=("conv_id",))
    return enc.select("conv_id", "n_source", "n_target", F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("labels", " ").alias("labels"), "label")


@register("length_filtered", "E2, F4 (train mode)", oracle=_ENCODED_SQL + f"""
SELECT conv_id, CAST(len(src) AS INTEGER) AS n_source, CAST(len(tgt) AS INTEGER) AS n_target FROM s
WHERE len(src) <= {MAX_SOURCE_LEN}""")
def length_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encode_examples(_prompts(spark, sf_dir, ["v1"]), keep=("conv_id",), mode="train",
                          max_source_len=MAX_SOURCE_LEN)
    return enc.select("conv_id", "n_source", "n_target")


@register("padded_batches", "E7, E8, W2, W3, R3, R4", oracle=_ENCODED_SQL + f""",
i AS (SELECT conv_id, len(src) + len(tgt) AS n, row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM s),
b AS (SELECT *, idx // {BATCH_SIZE} AS batch FROM i),
w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS batch_len FROM b)
SELECT conv_id, idx, batch, CAST(batch_len AS INTEGER) AS batch_len, CAST(batch_len - n AS INTEGER) AS n_pad,
       CAST(n AS INTEGER) AS n_attended FROM w""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encode_examples(_prompts(spark, sf_dir, ["v1"]), keep=("conv_id",))
    padded = pad_batches(enc.select("conv_id", "input_ids", "labels"), "conv_id", BATCH_SIZE, PAD_ID,
                         unique=True)
    return padded.select(
        "conv_id", "idx", "batch", "batch_len",
        F.size(F.filter("attention_mask", lambda m: ~m)).alias("n_pad"),
        F.size(F.filter("attention_mask", lambda m: m)).alias("n_attended"))


@register("length_filter_report", "F4 (kept and dropped rows per variant)", oracle=f"""WITH {_RAW_BLOCKS},
p AS ({" UNION ALL ".join(
    f"SELECT '{n}' AS variant, "
    + (f"concat({_lit(fixed.DEFAULT_SYSTEM_TEXT)}, chr(10), {_user_sql(n)}, chr(10))" if VARIANTS[n].system_text
       else f"concat({_user_sql(n)}, chr(10))") + " AS src FROM x" for n in VARIANTS)})
SELECT variant, count(*) FILTER (length(src) <= {MAX_SOURCE_LEN}) AS n_kept,
       count(*) FILTER (length(src) > {MAX_SOURCE_LEN}) AS n_dropped FROM p GROUP BY variant""")
def length_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_report(_prompts(spark, sf_dir, list(VARIANTS)), MAX_SOURCE_LEN)


# A pad id that occurs as a real token: the letter A of every gold option "A. ".
REAL_PAD_ID = 65


@register("padded_arrays", "E8, R3 (ids, labels and mask, with a pad id that is a real token)", oracle=_ENCODED_SQL + f""",
i AS (SELECT conv_id, list_concat(src, tgt) AS ids, list_concat(list_transform(src, lambda t: -100), tgt) AS labels,
             row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM s),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY idx // {BATCH_SIZE}) - len(ids) AS pad FROM i),
pd AS (SELECT *, list_concat(ids, list_transform(range(0, pad), lambda t: {REAL_PAD_ID})) AS padded,
             list_concat(labels, list_transform(range(0, pad), lambda t: -100)) AS padded_labels FROM w)
SELECT conv_id, array_to_string(padded, ' ') AS input_ids, array_to_string(padded_labels, ' ') AS labels,
       array_to_string(list_transform(padded, lambda t: CASE WHEN t = {REAL_PAD_ID} THEN 0 ELSE 1 END), '') AS mask
FROM pd""")
def padded_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = encode_examples(_prompts(spark, sf_dir, ["v1"]), keep=("conv_id",))
    padded = pad_batches(enc.select("conv_id", "input_ids", "labels"), "conv_id", BATCH_SIZE, REAL_PAD_ID,
                         unique=True)
    bits = F.transform("attention_mask", lambda m: m.cast("int"))
    return padded.select("conv_id", F.array_join("input_ids", " ").alias("input_ids"),
                         F.array_join("labels", " ").alias("labels"), F.array_join(bits, "").alias("mask"))


V5_SYSTEM = "주어진 대화를 읽고 가장 알맞은 문장을 고르세요."


@register("prompt_messages", "Q7 (messages, with a system text per variant)", oracle=f"WITH {_RAW_BLOCKS} " + " UNION ALL ".join(
    f"SELECT conv_id, '{n}' AS variant, concat('system: ', {_lit(VARIANTS[n].system_text or V5_SYSTEM)}, chr(10), "
    f"'user: ', {_user_sql(n)}) AS messages FROM x" for n in VARIANTS))
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = examples_nested(spark, sf_dir)
    missing = {n: V5_SYSTEM for n, v in VARIANTS.items() if not v.system_text}
    p = build_prompts(ex, list(VARIANTS), keep=("conv_id",), eos_token=EOS, system_text=missing)
    lines = F.transform(to_messages(F.col("system"), F.col("user")), lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return p.select("conv_id", "variant", F.array_join(lines, "\n").alias("messages"))


@register("event_index", "W2 on a string key with ties (row index)", oracle="""
SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS idx FROM events""")
def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_type", "event_id"])
    return with_global_index(e, ["event_type", "event_id"]).select("event_id", "idx")


@register("kfold_assignments", "W2, K1, K2 over orders", oracle=f"""
WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders),
p AS (SELECT *, n // {K_FOLDS} AS q, n % {K_FOLDS} AS r FROM i)
SELECT o_orderkey, idx, CAST(CASE WHEN idx < r * (q + 1) THEN idx // (q + 1) ELSE r + (idx - r * (q + 1)) // q END + 1
                          AS INTEGER) AS fold FROM p""")
def kfold_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey"])
    return kfold(orders, "o_orderkey", K_FOLDS).select("o_orderkey", "idx", "fold")


@register("kfold_roles", "K1 train/validation rounds over examples", oracle=f"""
WITH e AS ({EXAMPLES_VIEW}),
i AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx, count(*) OVER () AS n FROM e),
p AS (SELECT *, n // {K_FOLDS} AS q, n % {K_FOLDS} AS r FROM i),
f AS (SELECT conv_id, CASE WHEN idx < r * (q + 1) THEN idx // (q + 1) ELSE r + (idx - r * (q + 1)) // q END + 1 AS fold
      FROM p),
x AS (SELECT f.*, CAST(rd AS INTEGER) AS round FROM f, range(1, {K_FOLDS + 1}) t(rd))
SELECT round, CASE WHEN fold = round THEN 'validation' ELSE 'train' END AS role, count(*) AS n_rows,
       min(conv_id) AS first_conv, max(conv_id) AS last_conv
FROM x GROUP BY ALL""")
def kfold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = kfold(example_heads(spark, sf_dir).select("conv_id"), "conv_id", K_FOLDS)
    return fold_roles(folded, K_FOLDS).groupBy("round", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"))


@register("prompt_all_variants", "Q1-Q9: all five variants in one pass (generator over variant rows)",
          oracle=_prompt_sql(_RAW_BLOCKS, list(VARIANTS)))
def prompt_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, list(VARIANTS)).select(
        "conv_id", "variant", F.col("user").alias("prompt"), "target", "label")


def _id_arithmetic_scorer():
    """Deterministic stand-in for a model: A/B/C logits from the source token ids."""
    import numpy as np

    def score(pdf):
        sizes = pdf["input_ids"].map(len).to_numpy()
        out = np.zeros((len(pdf), 3))
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate(pdf["input_ids"].to_list()).astype("int64")
            ends = np.cumsum(sizes)[full]
            out[full, 0] = np.add.reduceat(flat, ends - sizes[full]) % 7
            out[full, 1] = sizes[full] % 5
            out[full, 2] = flat[ends - 1] % 3
        return out
    return score


@register("variant_vote", "Q9, E1, I1-I4, A13 end to end: 5 variants -> encode -> score -> vote", oracle=f"""
WITH {_RAW_BLOCKS},
p AS ({" UNION ALL ".join(
    f"SELECT conv_id, {i} AS rank, "
    + (f"concat({_lit(fixed.DEFAULT_SYSTEM_TEXT)}, chr(10), {_user_sql(n)}, chr(10))" if VARIANTS[n].system_text
       else f"concat({_user_sql(n)}, chr(10))") + " AS src FROM x"
    for i, n in enumerate(VARIANTS, start=1))}),
enc AS (SELECT conv_id, rank, {_codepoints_sql('src')} AS ids FROM p),
s AS (SELECT conv_id, rank, CAST(list_sum(ids) % 7 AS DOUBLE) AS a, CAST(len(ids) % 5 AS DOUBLE) AS b,
             CAST(ids[-1] % 3 AS DOUBLE) AS c FROM enc),
votes AS (SELECT conv_id, rank, concat('inference_', CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END)
          AS output FROM s),
per AS (SELECT conv_id, output, count(*) AS c, min(rank) AS r FROM votes GROUP BY conv_id, output),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, r ASC) AS pos,
                  CAST(sum(c) OVER (PARTITION BY conv_id) AS BIGINT) AS n_votes FROM per)
SELECT conv_id, output, c AS votes, n_votes FROM ranked WHERE pos = 1""")
def variant_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialframe.operators.score import predict_from_scores, score_batches, source_only
    from dialframe.operators.vote import hard_vote

    names = list(VARIANTS)
    prompts = _prompts(spark, sf_dir, names)
    enc = encode_examples(prompts, keep=("conv_id", "variant"))
    scored = score_batches(source_only(enc, ["conv_id", "variant"]), _id_arithmetic_scorer, ["conv_id", "variant"])
    preds = predict_from_scores(scored, ["s_a", "s_b", "s_c"], ["conv_id", "variant"])
    rank = F.element_at(F.create_map(*[x for i, n in enumerate(names, start=1) for x in (F.lit(n), F.lit(i))]),
                        F.col("variant"))
    return hard_vote(preds.select("conv_id", "output", rank.alias("rank")), "conv_id", "output", "rank")
