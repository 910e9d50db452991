"""Supervised-example encoding: template, encode, length filter, label mask, batch padding.

The encoder is pluggable.  The native default maps every code point to its
number (a JVM expression, no Python); a model tokenizer is plugged in as an
Arrow-batched ``pandas_udf`` built by :func:`pandas_encoder`, loaded once per
Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from dialframe.functions import fixed
from dialframe.operators.folds import kfold, number_rows, with_row_key
from dialframe.operators.prompts import VARIANTS
from dialframe.session import num_partitions, ship_package
from dialframe.sources.jsonio import id_sequence

Encoder = Callable[[Column], Column]


def code_points(text: Column) -> Column:
    """``array<bigint>`` of code points.  Blank text gives ``[]``: splitting '' yields
    ``['']``, which the inner filter removes (it would otherwise encode to ``[0]``)."""
    chars = F.filter(F.split(text, "", -1), lambda c: c != F.lit(""))
    return F.transform(chars, lambda c: F.ascii(c).cast("bigint"))


def pandas_encoder(encode_batch: Callable[[list[str]], list[list[int]]]) -> Encoder:
    """Wrap ``encode_batch(texts) -> ids`` (e.g. a tokenizer's batch call) as an Arrow UDF."""
    @F.pandas_udf("array<bigint>")
    def _encode(texts: pd.Series) -> pd.Series:
        out = encode_batch([t if t is not None else "" for t in texts.tolist()])
        return pd.Series([list(map(int, ids)) for ids in out])

    def apply(c: Column) -> Column:
        from pyspark.sql import SparkSession
        active = SparkSession.getActiveSession()
        if active is not None:
            ship_package(active)
        return _encode(c)
    return apply


@dataclass(frozen=True)
class ChatTemplate:
    """How system and user text become the source string (with the generation prompt).

    The defaults are a neutral placeholder; a model's own template is passed by the caller.
    """

    system_prefix: str = ""
    user_prefix: str = ""
    turn_suffix: str = "\n"
    generation_prompt: str = ""

    def render(self, system: Column, user: Column) -> Column:
        sys_part = F.when(system.isNotNull(), F.concat(F.lit(self.system_prefix), system, F.lit(self.turn_suffix))
                          ).otherwise(F.lit(""))
        return F.concat(sys_part, F.lit(self.user_prefix), user, F.lit(self.turn_suffix),
                        F.lit(self.generation_prompt))


def encode_examples(prompts: DataFrame, keep: Sequence[str] = ("id",), encoder: Encoder = code_points,
                    template: ChatTemplate = ChatTemplate(), mode: str = "eval",
                    max_source_len: int | None = None, observation: Observation | None = None) -> DataFrame:
    """Encode source and target; ``input_ids`` = source ++ target, ``labels`` = -100 per source token ++ target.

    In ``train`` mode examples whose *source* is longer than ``max_source_len``
    are dropped before the target is encoded (the target is not counted).
    ``observation`` then receives ``n_kept`` and ``n_dropped``, and both per variant
    (``n_kept_v1``) if the prompts have that column among ``keep``, when the result is
    written: the rows are counted as they are encoded, in the same pass.
    """
    if mode not in ("train", "eval"):
        raise ValueError(f"mode must be 'train' or 'eval', got {mode!r}")
    if observation is not None and (mode != "train" or max_source_len is None):
        raise ValueError("an observation counts what a length filter drops: it needs mode='train' and max_source_len")
    # A generator: a condition on its size would be pushed below a projection and encode twice.
    ids = F.explode(F.array(encoder(template.render(F.col("system"), F.col("user")))))
    src = prompts.select(*keep, "target", "label", ids.alias("_src")).withColumn("n_source", F.size("_src"))
    if mode == "train" and max_source_len is not None:
        fits = F.col("n_source") <= max_source_len
        if observation is not None:
            groups = {"": F.lit(True)}
            if "variant" in keep:
                groups |= {f"_{v}": F.col("variant") == v for v in VARIANTS}
            src = src.observe(observation, *[F.count_if(cond & which).alias(f"n_{name}{suffix}")
                                             for suffix, which in groups.items()
                                             for name, cond in (("kept", fits), ("dropped", ~fits))])
        src = src.where(fits)
    tgt = encoder(F.col("target"))
    enc = src.withColumn("_tgt", tgt)
    return enc.select(
        *keep, "n_source", F.size("_tgt").alias("n_target"),
        F.concat("_src", "_tgt").alias("input_ids"),
        F.concat(F.array_repeat(F.lit(fixed.IGNORE_INDEX).cast("bigint"), F.col("n_source")), "_tgt").alias("labels"),
        "label")


def length_filter_report(prompts: DataFrame, max_source_len: int, by: Sequence[str] = ("variant",),
                         encoder: Encoder = code_points, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Rows that the train-mode length filter keeps and drops, per ``by``: n_kept, n_dropped."""
    size = F.size(encoder(template.render(F.col("system"), F.col("user"))))
    return prompts.select(*by, size.alias("_n")).groupBy(*by).agg(
        F.count_if(F.col("_n") <= max_source_len).alias("n_kept"),
        F.count_if(F.col("_n") > max_source_len).alias("n_dropped"))


def train_folds(prompts: DataFrame, k: int, max_source_len: int | None = None, train: str = "train",
                encoder: Encoder = code_points, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(id, split, variant, fold) of the train rows that fit, folded per variant in file order.

    File order is the column ``position`` (an example's place in its file).  A frame
    without it is ordered by the trailing number of the id, then the id (ids without
    a number come first, by their text).  Only ids and numbers are shuffled.  Rows
    that repeat an id share its fold, by their first place.
    """
    rows = prompts.where(F.col("split") == train)
    order = F.col("position") if "position" in prompts.columns else id_sequence("id")
    rows = rows.withColumn("_seq", order)
    if max_source_len is not None:
        size = F.size(encoder(template.render(F.col("system"), F.col("user"))))
        rows = rows.select("id", "split", "variant", "_seq",
                           F.explode(F.filter(F.array(size), lambda n: n <= max_source_len)))
    ids = rows.groupBy("id", "split", "variant").agg(F.min("_seq").alias("_seq"))
    return kfold(ids, ["_seq", "id"], k, by="variant").select("id", "split", "variant", "fold")


def pad_batches(encoded: DataFrame, order: str | Sequence[str], batch_size: int, pad_id: int,
                mask_by: str = "value", unique: bool = False) -> DataFrame:
    """Cut examples into batches of ``batch_size`` in ``order`` and right-pad to the batch maximum.

    ``input_ids`` are padded with ``pad_id``, ``labels`` with -100.  The attention
    mask is ``input_ids != pad_id`` with ``mask_by="value"`` (so a real token equal
    to the pad id is masked too, as in the original collator) or marks the
    unpadded prefix with ``mask_by="length"``.

    Only the order and the length of an example are numbered, batched and compared
    (a batch window holds ``batch_size`` rows); the arrays are written once and meet
    their batch and width in one join.  ``unique=True`` says that the order has no ties.
    """
    if mask_by not in ("value", "length"):
        raise ValueError(f"mask_by must be 'value' or 'length', got {mask_by!r}")
    order = [order] if isinstance(order, str) else list(order)
    parts = max(num_partitions(encoded), int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = with_row_key(encoded, order, unique)
    narrow = rows.select(*dict.fromkeys([*order, "_tie", "_row"]), F.size("input_ids").alias("_len"))
    index = number_rows(narrow, [*order, "_tie"], "idx", None, parts).withColumn(
        "batch", F.floor(F.col("idx") / F.lit(batch_size)).cast("bigint"))
    index = index.select("_row", "idx", "batch", "_len",
                         F.max("_len").over(Window.partitionBy("batch")).alias("batch_len"))
    batched = rows.join(index, "_row")
    pad = F.col("batch_len") - F.col("_len")
    ids = F.concat("input_ids", F.array_repeat(F.lit(pad_id).cast("bigint"), pad))
    labels = F.concat("labels", F.array_repeat(F.lit(fixed.IGNORE_INDEX).cast("bigint"), pad))
    if mask_by == "value":
        mask = F.transform(ids, lambda x: x != F.lit(pad_id))
    else:
        mask = F.transform(F.sequence(F.lit(0), F.col("batch_len") - 1), lambda i: i < F.col("_len"))
    # One projection: every expression sees the unpadded arrays.
    others = [c for c in encoded.columns if c not in ("input_ids", "labels")]
    return batched.select(*others, "idx", "batch", "batch_len", ids.alias("input_ids"), labels.alias("labels"),
                          mask.alias("attention_mask"))
