"""Utterance-level operators: flatten, clean + drop empty, reference selection, run merging.

Two shapes of the same data are supported:

* the *nested* form, one row per example with ``conversation`` as an array of
  ``struct<speaker, utterance, utterance_id>``; everything is done with
  higher-order functions inside the row, no shuffle;
* the *long* form, one row per utterance; merging is a gaps-and-islands job
  over ``Window.partitionBy(key, chunk)``, where ``chunk`` cuts a very long
  conversation into bounded pieces so that one hot key never lands in a single
  task, and runs that cross a chunk boundary are stitched in a second, small step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialframe.functions.text import DEFAULT_CLEAN, CleanConfig, clean_utterance, strip_unicode
from dialframe.session import materialize, num_partitions

DEFAULT_CHUNK_ROWS = 1 << 16
# Rows of a key beyond which its sequence is cut into chunks.
HOT_ROWS = 1 << 16
# An input of so many bytes on disk is one task's work whatever its keys.
ONE_TASK_BYTES = 64 << 20
# Chunk summaries that are combined in one row of the tree over a long key's chunks.
FAN_OUT = 64


def _as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------------------
# nested form
# ---------------------------------------------------------------------------

def flatten_conversation(examples: DataFrame, keep: Sequence[str] = ("id",),
                         conversation: str = "conversation") -> DataFrame:
    """One row per utterance with its position ``pos`` (order is meaning)."""
    return examples.select(*keep, F.posexplode(conversation).alias("pos", "u")).select(
        *keep, "pos", F.col("u.speaker").alias("speaker"), F.col("u.utterance").alias("utterance"),
        F.col("u.utterance_id").alias("utterance_id"))


def clean_conversation(conversation: Column, cfg: CleanConfig = DEFAULT_CLEAN) -> Column:
    """Clean every utterance and drop the ones that clean to empty."""
    cleaned = F.transform(conversation, lambda u: u.withField("utterance", clean_utterance(u["utterance"], cfg)))
    return F.filter(cleaned, lambda u: u["utterance"] != F.lit(""))


def turn_count(conversation: Column) -> Column:
    """Number of utterances of an example."""
    return F.size(conversation).cast("bigint")


def total_characters(conversation: Column) -> Column:
    """Sum of code-point lengths of the utterances of an example; a null utterance counts as ``None`` (4)."""
    return F.aggregate(conversation, F.lit(0).cast("bigint"), lambda acc, u: acc + F.length(
        F.coalesce(u["utterance"].cast("string"), F.lit("None"))).cast("bigint"))


# ---------------------------------------------------------------------------
# long form
# ---------------------------------------------------------------------------

def clean_and_drop_empty(df: DataFrame, text: str = "text", cfg: CleanConfig = DEFAULT_CLEAN,
                         out: str | None = None) -> DataFrame:
    """Clean ``text`` and drop rows whose cleaned text is empty.

    ``explode(filter(array(clean), non-empty))`` keeps the regex chain in one
    projection; ``withColumn`` + ``filter`` would let the optimizer copy the chain
    into the filter and evaluate it twice.
    """
    out = out or text
    cols = [c for c in df.columns if c != out and c != text] + ([text] if out != text else [])
    cleaned = F.explode(F.filter(F.array(clean_utterance(F.col(text), cfg)), lambda x: x != F.lit("")))
    return df.select(*cols, cleaned.alias(out))


def _chunk_column(order: list[str], chunk: Column | int | None) -> Column:
    if isinstance(chunk, int):
        return F.floor(F.col(order[0]) / F.lit(chunk)).cast("bigint")
    if chunk is None:
        return F.lit(0).cast("bigint")
    return chunk.cast("bigint")


def _small(df: DataFrame) -> bool:
    """Whether all that ``df`` reads (from file sizes, no job) is one task's input."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except AttributeError:  # Spark Connect
        return False
    return sum(sizes) <= ONE_TASK_BYTES


def _split_hot(df: DataFrame, keys: list[str], hot_rows: int, counted: DataFrame
               ) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(rows of normal keys, rows of keys with more than ``hot_rows`` rows, how many those are); None: no such rows.

    One aggregate over the key columns of ``counted``, partial before its shuffle.  The
    table of hot keys is only made where both kinds exist; it has at most
    ``rows / hot_rows`` rows.
    """
    counts = counted.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_hot_n"))
    is_hot = F.col("_hot_n") > hot_rows
    found = counts.agg(F.count_if(is_hot).alias("hot"), F.count_if(~is_hot).alias("normal"),
                       F.sum(F.when(is_hot, F.col("_hot_n"))).alias("rows")).first()
    if not found["hot"]:
        return df, None, 0
    if not found["normal"]:
        return None, df, found["rows"]
    hot = materialize(counts.where(is_hot), "hot-keys")
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi"), found["rows"]


def merge_turns(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str],
                speaker: str = "speaker", text: str = "text", uid: str = "utterance_id",
                is_ref: str | None = "is_ref", chunk: Column | int | str | None = DEFAULT_CHUNK_ROWS,
                chunk_key: Column | None = None, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None,
                chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Merge consecutive same-speaker rows of the long form (gaps and islands).

    ``df`` holds the surviving rows (empty texts already dropped), one per
    utterance.  A run starts at the first row of a key, on a speaker change, at a
    reference row and right after one (``is_ref=None``: no reference rows).  Output: ``key``, the ``order`` values of
    the run's first row, ``speaker``, ``text`` (joined with one space, stripped),
    ``utterance_ids`` (array, in order), ``n_turns`` and ``is_ref`` (the run is a
    reference row; such a run is always a single row); blank runs are dropped.

    Keys of at most ``hot_rows`` rows take one exchange: a whole key is one window
    partition, nothing is materialized.  Only longer keys are cut: an ``int``
    chunk cuts the (integral) first order column into ranges of that many
    positions, and ``"quantile"`` range-partitions the long keys' rows by key,
    ``chunk_key`` (if given; it must not decrease along the order) and order into chunks of
    about ``chunk_rows`` rows.  A ``Column`` that never decreases along the order
    cuts every key, ``None`` none.

    Long keys are found by a count over ``counted``, rows that hold at least those of ``df`` (default:
    ``df``; the rows before an expensive cleaning spare a second one).  With the default
    ``hot_rows``, an input whose file sizes fit one task is not counted: no key can be too long.

    Runs of cut keys are first built per (key, chunk) with one window; the
    pieces are written once as Parquet to the checkpoint directory (lineage cut).
    What crosses a chunk border is found from one summary per chunk; summaries are
    combined :data:`FAN_OUT` at a time, level by level.  The result depends on none
    of these settings.
    """
    keys = _as_list(key)
    order = _as_list(order)
    names = (speaker, text, uid, is_ref)
    if chunk is None:
        return _merge(df, keys, order, *names, None)
    if isinstance(chunk, Column):
        return _merge(df, keys, order, *names, chunk)
    if chunk != "quantile":
        kind = df.schema[order[0]].dataType.typeName()
        if kind not in ("byte", "short", "integer", "long"):
            raise ValueError(f"chunk={chunk} cuts an integral position, but {order[0]!r} is {kind}; "
                             f"use chunk='quantile' (or a Column) for this order")
    counted = df if counted is None else counted
    if hot_rows >= HOT_ROWS and _small(counted):
        return _merge(df, keys, order, *names, None)
    normal, hot, n_hot = _split_hot(df, keys, hot_rows, counted)
    if hot is None:
        return _merge(normal, keys, order, *names, None)
    if chunk == "quantile":
        n = max(num_partitions(hot), -(-n_hot // chunk_rows))
        by = [*keys, *([chunk_key] if chunk_key is not None else []), *order]
        hot = hot.repartitionByRange(n, *by).withColumn("_qchunk", F.spark_partition_id())
        cut = F.col("_qchunk")
    else:
        cut = F.floor(F.col(order[0]) / F.lit(chunk)).cast("bigint")
    merged = _merge(hot, keys, order, *names, cut)
    return merged if normal is None else _merge(normal, keys, order, *names, None).unionByName(merged)


# ---- what crosses chunk borders

def _joined(a: Column, b: Column) -> Column:
    """Summary of two neighbouring ranges; associative.

    A summary holds the speaker and reference flag of a range's first and last run (fs, fr,
    ls, lr), whether the range is one run (one), and the place where its last run begins (head).
    """
    on = a["ls"].eqNullSafe(b["fs"]) & ~a["lr"] & ~b["fr"]
    through = b["one"] & on
    return F.struct(a["fs"].alias("fs"), a["fr"].alias("fr"), b["ls"].alias("ls"), b["lr"].alias("lr"),
                    (a["one"] & through).alias("one"),
                    F.when(through, a["head"]).otherwise(b["head"]).alias("head"))


def _states_before(summaries: DataFrame, keys: list[str], top: int) -> DataFrame:
    """(keys, _idx, before): the summary of all chunks of the key before each one, null for the first.

    ``summaries`` has (keys, _idx, s) with ``_idx`` from 0 to ``top``.  Up the tree, groups of :data:`FAN_OUT` neighbours are
    combined until one is left per key; down again, every group hands its children what stands
    before them.  A row holds at most :data:`FAN_OUT` summaries on every level.
    """
    # With more than one level the summaries are read on the way up and on the way down.
    levels, level = [], summaries if top < FAN_OUT else materialize(summaries, "merge-chunks")
    while True:
        kids = level.groupBy(*keys, F.floor(F.col("_idx") / FAN_OUT).cast("bigint").alias("_group")).agg(
            F.array_sort(F.collect_list(F.struct("_idx", "s"))).alias("kids"))
        levels.append(kids)
        top //= FAN_OUT
        if top == 0:
            break
        level = materialize(kids.select(*keys, F.col("_group").alias("_idx"), F.aggregate(
            F.slice("kids", 2, FAN_OUT), F.get("kids", 0)["s"], lambda a, x: _joined(a, x["s"])).alias("s")), "merge-level")
    kind = summaries.schema["s"].dataType.simpleString()
    before = None
    for kids in reversed(levels):
        if before is None:
            rows = kids.withColumn("before", F.lit(None).cast(kind))
        else:
            up = before.withColumnsRenamed({**{k: f"_up_{k}" for k in keys}, "_idx": "_up_idx"})
            same = [F.col(k).eqNullSafe(F.col(f"_up_{k}")) for k in keys] + [F.col("_group") == F.col("_up_idx")]
            rows = kids.join(up, same).select(*keys, "_group", "kids", "before")
        item = f"struct<_idx:bigint,before:{kind}>"
        start = F.struct(F.col("before").alias("now"), F.array().cast(f"array<{item}>").alias("out"))
        scan = F.aggregate("kids", start, lambda a, x: F.struct(
            F.when(a["now"].isNull(), x["s"]).otherwise(_joined(a["now"], x["s"])).cast(kind).alias("now"),
            F.array_append(a["out"], F.struct(x["_idx"].alias("_idx"), a["now"].alias("before")).cast(item)).alias("out")),
            lambda a: a["out"])
        before = rows.select(*keys, F.inline(scan))
    return before


def _merge(df: DataFrame, keys: list[str], order: list[str], speaker: str, text: str, uid: str, is_ref: str | None,
           chunk: Column | None) -> DataFrame:
    """:func:`merge_turns` with every key in one piece (``chunk=None``) or cut by ``chunk``."""
    chunk_col = F.lit(0).cast("bigint") if chunk is None else chunk.cast("bigint")
    rows = df.select(*keys, *order, F.col(speaker).alias("_spk"), F.col(text).cast("string").alias("_txt"),
                     F.col(uid).cast("string").alias("_uid"),
                     (F.coalesce(F.col(is_ref).cast("boolean"), F.lit(False)) if is_ref else F.lit(False))
                     .alias("_ref"),
                     chunk_col.alias("_chunk"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    brk = ((F.row_number().over(w) == 1)
           | ~F.col("_spk").eqNullSafe(F.lag("_spk").over(w))
           | F.col("_ref") | F.coalesce(F.lag("_ref").over(w), F.lit(False)))
    marked = rows.withColumn("_brk", brk.cast("int"))
    # Run number (running sum) and runs per chunk (whole-partition sum) come out of
    # the same window operator: one sort.
    marked = marked.select(
        "*", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
        F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_nrun"))

    ord_struct = F.struct(*[F.col(o) for o in order])
    # Only hash-friendly aggregates (collect_list, count, max of an int): no sort-based
    # aggregation; speaker, start and reference flags are read off the sorted parts.
    pieces = marked.groupBy(*keys, "_chunk", "_run").agg(
        F.array_sort(F.collect_list(F.struct(ord_struct.alias("o"), "_txt", "_uid", "_ref", "_spk"))).alias("_parts"),
        F.count(F.lit(1)).alias("_n"),
        F.max("_nrun").alias("_nrun"),
    ).select(*keys, "_chunk", "_run", "_nrun", "_parts", "_n",
             F.get("_parts", 0)["_spk"].alias("_spk"), F.get("_parts", 0)["o"].alias("_start"),
             F.get("_parts", 0)["_ref"].alias("_first_ref"), F.element_at("_parts", -1)["_ref"].alias("_last_ref"))

    def finish(p: DataFrame, parts: str = "_parts") -> DataFrame:
        joined = strip_unicode(F.array_join(F.transform(parts, lambda x: x["_txt"]), " "))
        # explode(filter(array(..))) drops blank runs with the text computed once.
        return p.select(
            *keys, *[F.col("_start")[o].alias(o) for o in order], F.col("_spk").alias(speaker),
            F.explode(F.filter(F.array(joined), lambda t: t != F.lit(""))).alias(text),
            F.transform(parts, lambda x: x["_uid"]).alias("utterance_ids"),
            F.col("_n").cast("bigint").alias("n_turns"),
            ((F.col("_n") == 1) & F.col("_first_ref")).alias("is_ref"))

    if chunk is None:
        return finish(pieces)

    # Materialize the pieces once (Parquet under the checkpoint dir): the boundary
    # table, the link join and the two output branches below all read them, none
    # recomputes scan + clean + window, and the boundary step reads no text.
    pieces = materialize(pieces, "merge-pieces")

    # First and last run of every chunk; all others are whole.
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_nrun"))
    least, most = (x or 0 for x in pieces.agg(F.min("_chunk"), F.max("_chunk")).first())
    idx = (F.col("_chunk") - F.lit(least)).alias("_idx")
    chunks = pieces.where(edge).groupBy(*keys, "_chunk").agg(
        F.min_by(F.struct("_spk", "_first_ref"), "_run").alias("f"),
        F.max_by(F.struct("_spk", "_last_ref", "_run"), "_run").alias("l"))
    summaries = chunks.select(*keys, idx, F.struct(
        F.col("f._spk").alias("fs"), F.col("f._first_ref").alias("fr"), F.col("l._spk").alias("ls"),
        F.col("l._last_ref").alias("lr"), (F.col("l._run") == 1).alias("one"),
        F.struct(F.col("_chunk").alias("c"), F.col("l._run").alias("r")).alias("head")).alias("s"))
    before = _states_before(summaries, keys, most - least).withColumnsRenamed({k: f"_link_{k}" for k in [*keys, "_idx"]})
    same = [F.col(k).eqNullSafe(F.col(f"_link_{k}")) for k in [*keys, "_idx"]]
    edges = pieces.where(edge).withColumn("_idx", idx).join(before, same)
    goes_on = ((F.col("_run") == 1) & F.col("before").isNotNull() & F.col("_spk").eqNullSafe(F.col("before.ls"))
               & ~F.col("before.lr") & ~F.col("_first_ref"))
    own = F.struct(F.col("_chunk").alias("c"), F.col("_run").alias("r"))
    stitched = edges.withColumn("_head", F.when(goes_on, F.col("before.head")).otherwise(own)).groupBy(
        *keys, "_head").agg(
        F.min("_spk").alias("_spk"),
        F.min("_start").alias("_start"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_parts"))),
                              lambda x: x["_parts"])).alias("_parts"),
        F.sum("_n").alias("_n"),
        F.min_by("_first_ref", "_chunk").alias("_first_ref"))
    return finish(pieces.where(~edge)).unionByName(finish(stitched))


def nest_turns(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], fields: Sequence[str],
               chunk: Column | int | None = DEFAULT_CHUNK_ROWS, out: str = "conversation") -> DataFrame:
    """Long form -> one row per key with ``out`` = ordered ``array<struct<fields>>``.

    Two-level: rows are first collected per (key, chunk) - bounded groups, with
    map-side partial aggregation - and the sorted pieces are then concatenated
    per key; ``chunk=None`` takes one level (one shuffle).  The output row holds
    the whole conversation by definition, so chunks only spread the sorting.
    """
    keys = _as_list(key)
    order = _as_list(order)
    item_fields = [F.struct(*order).alias("_o"), *fields]
    if chunk is None:
        whole = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*item_fields))).alias("_items"))
        return whole.select(*keys, F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
                            .alias(out))
    chunk_col = _chunk_column(order, chunk)
    item = F.struct(F.struct(*order).alias("_o"), *fields)
    pieces = df.groupBy(*keys, chunk_col.alias("_chunk")).agg(F.array_sort(F.collect_list(item)).alias("_part"))
    whole = pieces.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))), lambda x: x["_part"]))
        .alias("_items"))
    return whole.select(*keys, F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))


# ---------------------------------------------------------------------------
# nested form, DataFrame level
# ---------------------------------------------------------------------------

def merge_examples(examples: DataFrame, conversation: str = "conversation", reference_id: str = "reference_id",
                   ids_are_arrays: bool = True) -> DataFrame:
    """Merge runs in every example's conversation array, in time linear in its turns.

    The run starts are found with O(1) neighbour lookups and the runs are slices
    between consecutive starts.  Both arrays are staged as columns that the later
    expressions reference several times, so the optimizer keeps them computed
    once instead of inlining them into per-element lambdas.
    """
    c = F.col("_m_conv")
    refs = F.col(reference_id)
    n = F.size(c)

    def first_id(u: Column) -> Column:
        return F.get(u["utterance_id"], 0) if ids_are_arrays else u["utterance_id"]

    def last_id(u: Column) -> Column:
        return F.element_at(u["utterance_id"], -1) if ids_are_arrays else u["utterance_id"]

    def is_start(i: Column) -> Column:
        cur, prev = F.get(c, i), F.get(c, i - 1)
        return ((i == 0) | ~cur["speaker"].eqNullSafe(prev["speaker"])
                | F.coalesce(F.array_contains(refs, first_id(cur)), F.lit(False))
                | F.coalesce(F.array_contains(refs, last_id(prev)), F.lit(False)))

    staged = examples.withColumn("_m_conv", F.col(conversation))
    staged = staged.withColumn("_m_starts", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), is_start))
                               .otherwise(F.array().cast("array<int>")))
    st = F.col("_m_starts")

    def run(s: Column, k: Column) -> Column:
        part = F.slice(c, s + 1, F.coalesce(F.get(st, k + 1), n) - s)
        ids = (F.flatten(F.transform(part, lambda u: u["utterance_id"])) if ids_are_arrays
               else F.transform(part, lambda u: u["utterance_id"]))
        return F.struct(F.get(part, 0)["speaker"].alias("speaker"),
                        strip_unicode(F.array_join(F.transform(part, lambda u: u["utterance"].cast("string")), " "))
                        .alias("utterance"),
                        ids.alias("utterance_id"))

    merged = F.filter(F.transform(st, run), lambda u: u["utterance"] != F.lit(""))
    return staged.withColumn(conversation, merged).drop("_m_conv", "_m_starts")


def refine_examples(examples: DataFrame, cfg: CleanConfig = DEFAULT_CLEAN, ids_are_arrays: bool = True) -> DataFrame:
    """The refine job on nested examples: clean, drop empty, merge - all inside the row, no shuffle."""
    cleaned = examples.withColumn("conversation", clean_conversation(F.col("conversation"), cfg))
    return merge_examples(cleaned, ids_are_arrays=ids_are_arrays)


def example_lengths(examples: DataFrame, keep: Sequence[str] = ("id", "split")) -> DataFrame:
    """Turns and total characters per example (the length table)."""
    return examples.select(*keep, turn_count(F.col("conversation")).alias("n_turns"),
                           total_characters(F.col("conversation")).alias("total_utterance_length"))
