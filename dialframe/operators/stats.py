"""Corpus statistics: sizes, distributions, summaries, histograms, distinct texts, tokens, top-k.

Every operator aggregates first and joins only aggregated tables; nothing uses
an unpartitioned window over rows.  Grouping keys (``split``, ``lang``...) are
few, so per-group tables are small; where one could be large (the tokens of a
split) a partial top-k runs map-side before the group is brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialframe.functions import fixed
from dialframe.functions.text import split_on_space, squeeze_jamo_runs
from dialframe.session import materialize


def _as_list(x: str | Sequence[str] | None) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


# ---------------------------------------------------------------------------
# splits (A1, U1)
# ---------------------------------------------------------------------------

def with_combined_split(df: DataFrame, split: str = "split", members: Sequence[str] = ("train", "dev"),
                        name: str = "train+dev") -> DataFrame:
    """Also count every row of ``members`` under ``name`` (the train+dev union, in the same pass).

    A generator (``explode``), not a union: the input is read once.
    """
    expanded = F.when(F.col(split).isin(*members), F.array(F.col(split), F.lit(name))).otherwise(
        F.array(F.col(split)))
    others = [c for c in df.columns if c != split]
    return df.select(*others, F.explode(expanded).alias(split))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# distributions (A2, A3, A4, J8)
# ---------------------------------------------------------------------------

def value_counts(df: DataFrame, key: str, group: str | Sequence[str] | None = None) -> DataFrame:
    """Count of every value of ``key`` (per ``group``)."""
    return df.groupBy(*_as_list(group), key).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, key: str, group: str | Sequence[str] | None = None) -> DataFrame:
    """Count and percentage of every value of ``key``; percentage of all rows of the group.

    Group totals are summed from the aggregated counts (a per-group aggregate,
    or a scalar over partial sums without a group), so the input is read once
    and no task ever holds all values of a key; the unrounded percentage is
    returned (render ``%.2f`` at display).
    """
    g = _as_list(group)
    counts = value_counts(df, key, g)
    if g:
        totals = counts.groupBy(*g).agg(F.sum("n").alias("_total"))
        j = counts.join(totals, g)
    else:
        j = counts.withColumn("_total", counts.select(F.sum("n")).scalar())
    return j.select(*g, key, "n", (F.col("n") / F.col("_total") * F.lit(100.0)).alias("pct"))


def fixed_key_distribution(df: DataFrame, key: str, keys: Sequence[str], group: str | Sequence[str] | None = None,
                           ) -> DataFrame:
    """Counts for a fixed, ordered key list: missing keys give 0, other keys are hidden.

    The percentage still divides by all rows of the group, hidden keys included.
    One aggregate with a conditional count per key, then unpivoted: no join.
    """
    g = _as_list(group)
    aggs = [F.count(F.lit(1)).alias("_total")] + [
        F.count_if(F.col(key) == F.lit(k)).alias(f"_n{i}") for i, k in enumerate(keys)]
    wide = df.groupBy(*g).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias(key), F.lit(i).alias("key_pos"), F.col(f"_n{i}").alias("n"))
                     for i, k in enumerate(keys)])
    return wide.select(*g, "_total", F.inline(rows)).select(
        *g, key, "key_pos", "n", (F.col("n") / F.col("_total") * F.lit(100.0)).alias("pct"))


def percent_text(pct: Column | str) -> Column:
    """Display text of a percentage, two decimals and a percent sign (e.g. ``12.50%``).

    Half-way values go to the even digit, as printing a double does elsewhere
    (0.125 is ``0.12%``); ``format_string`` would round them up.
    """
    value = F.col(pct) if isinstance(pct, str) else pct
    return F.concat(F.call_function("format_number", value.cast("double"), F.lit("0.00")), F.lit("%"))


# Tokens that a summary keeps in one task and group, and candidates up to which they are sent to every task.
TRACKED_TOKENS = 10_000
BROADCAST_TOKENS = 1_000_000
# A frequent-items sketch with a map of m slots errs by at most 3.5 / m of what it has seen, m is at least
# tracked / 0.75, and a token is named if its count exceeds twice that error.
SUMMARY_ERROR = 2 * 3.5 * 0.75
# Empty bins that one row stands for on the way.
GAP_BINS = 1 << 12


# ---------------------------------------------------------------------------
# summaries and histograms (A5, A6, A7, A8)
# ---------------------------------------------------------------------------

def length_summary(df: DataFrame, value: str, group: str | Sequence[str] | None = None) -> DataFrame:
    """n, sum, exact mean (integer sum / count), min and max of an integral column."""
    v = F.col(value).cast("bigint")
    return df.groupBy(*_as_list(group)).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"),
        (F.sum(v) / F.count(v)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def histogram(df: DataFrame, value: str, step: int, group: str | Sequence[str] | None = None) -> DataFrame:
    """Fixed-width histogram with edges ``0, step, 2*step, ...`` up to the group maximum.

    ``nbins = ceil(max / step)`` (at least 1); the last bin is closed, so the
    maximum lands in it; empty bins are present with 0.  One linear chain over
    the input: values are counted per bin (a small table, clamped to the last bin), and every bin then
    also emits the empty bins up to the next one (``lead`` over the bins of its
    group).  A gap becomes rows of at most :data:`GAP_BINS` bins before it becomes
    bins, so a far outlier makes many rows, not one long array.
    """
    g = _as_list(group)
    v = F.col(value).cast("bigint")
    # Values below the first edge (0) fall outside every bin, as with numpy's histogram.
    raw = df.where(v >= 0).groupBy(*g, F.floor(v / F.lit(step)).cast("bigint").alias("_rb")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(v).alias("_mx"))
    wg = Window.partitionBy(*g)
    nb = F.greatest(F.ceil(F.max("_mx").over(wg) / F.lit(step)).cast("bigint"), F.lit(1).cast("bigint"))
    # The maximum of a whole number of steps has a raw bin of its own, which belongs to the last one.
    # (Grouped by the window's own partitions: no further exchange.)
    raw = raw.select(*g, "_rb", "_n", (nb - 1).alias("_last"))
    raw = raw.groupBy(*g, F.least("_rb", "_last").alias("_rb"), "_last").agg(F.sum("_n").alias("_n"))
    wo = wg.orderBy("_rb")
    # A bin stands for itself (with its count) and the empty bins after it up to the next one (or
    # the last); the first one of a group also for the bins before it.
    raw = raw.select(*g, "_rb", "_n", F.coalesce(F.lead("_rb").over(wo) - 1, "_last").alias("_stop"),
                     F.row_number().over(wo).alias("_first"))
    start = F.when(F.col("_first") == 1, F.lit(0).cast("bigint")).otherwise(F.col("_rb"))
    spans = raw.select(*g, "_rb", "_n", "_stop", F.explode(F.sequence(start, "_stop", F.lit(GAP_BINS).cast("bigint")))
                       .alias("_from"))
    bins = spans.select(*g, "_rb", "_n", F.explode(F.sequence(
        "_from", F.least(F.col("_from") + (GAP_BINS - 1), F.col("_stop")))).alias("bin"))
    n = F.when(F.col("bin") == F.col("_rb"), F.col("_n")).otherwise(F.lit(0).cast("bigint"))
    return bins.select(*g, "bin", (F.col("bin") * step).alias("bin_start"), ((F.col("bin") + 1) * step).alias("bin_end"),
                       n.alias("n"))


# ---------------------------------------------------------------------------
# texts and tokens (A9, A10, A11, U3, N1-N7, F3)
# ---------------------------------------------------------------------------

def distinct_texts(df: DataFrame, text: str = "text", group: str | Sequence[str] | None = None) -> DataFrame:
    """The set of texts per group (map-side partial dedup collapses hot copies early)."""
    return df.select(*_as_list(group), text).distinct()


def texts_with_groups(df: DataFrame, text: str = "text", group: str = "split", members: Sequence[str] = (),
                      combined: str | None = None, out: str = "groups") -> DataFrame:
    """One row per distinct text with the set of its groups (``array``), shuffled once by text.

    Texts of any of ``members`` are also in the group ``combined`` (the train+dev
    union), which costs an array element, not a second copy of the text.  A text
    has at most as many elements as there are groups.
    """
    groups = F.collect_set(group)
    if combined is not None:
        extra = F.when(F.arrays_overlap(groups, F.array(*[F.lit(m) for m in members])), F.array(F.lit(combined)))
        groups = F.concat(groups, F.coalesce(extra, F.array().cast("array<string>")))
    return df.groupBy(text).agg(groups.alias(out))


def token_rows(df: DataFrame, text: str = "text", group: str | Sequence[str] | None = None,
               distinct_first: bool = True, letters: Sequence[str] = fixed.SQUEEZED_JAMO,
               groups: str | None = None) -> DataFrame:
    """One row (``group``, ``token``) per token: split on single spaces, squeeze jamo runs, drop tokens of length <= 1.

    With ``distinct_first`` every distinct text of a group counts once (the
    word-cloud input is a set of texts).  ``groups`` names an array column of
    distinct texts instead (:func:`texts_with_groups`): each text is tokenized once
    and every token counts in each of its groups, as column ``group``.  Joining
    texts with a space and then splitting equals splitting every text, so no text
    is ever concatenated.  Tokens are exploded first so the normalisation is a
    top-level (code generated) expression, and the six squeezes only run on tokens
    holding one of the letters.
    """
    g = _as_list(group)
    if groups is not None:
        src, carried = df, [groups]
    else:
        src, carried = distinct_texts(df, text, g) if distinct_first else df.select(*g, text), g
    toks = src.select(*carried, F.explode(split_on_space(F.col(text))).alias("_tok"))
    # Squeezing never shortens a token below two code points when it holds one of the
    # letters and leaves other tokens unchanged, so the length rule is decided on the
    # raw token without any regex (a lone letter becomes a doubled one and is kept).
    tok = F.col("_tok")
    keep = (F.length(tok) >= 2) | tok.isin(*letters)
    has_jamo = tok.rlike("[" + "".join(letters) + "]")
    norm = F.when(has_jamo, squeeze_jamo_runs(tok, tuple(letters))).otherwise(tok)
    toks = toks.where(keep).select(*carried, norm.alias("token"))
    if groups is not None:
        name = g[0] if g else "group"
        toks = toks.select(F.explode(groups).alias(name), "token")
    return toks


def token_counts(df: DataFrame, text: str = "text", group: str | Sequence[str] | None = None,
                 distinct_first: bool = True, letters: Sequence[str] = fixed.SQUEEZED_JAMO,
                 groups: str | None = None) -> DataFrame:
    """Frequencies of the tokens of :func:`token_rows` per group."""
    toks = token_rows(df, text, group, distinct_first, letters, groups)
    return toks.groupBy(*toks.columns).agg(F.count(F.lit(1)).alias("n"))


def frequent_tokens(df: DataFrame, k: int, text: str = "text", group: str | Sequence[str] | None = None,
                    tracked: int = TRACKED_TOKENS) -> DataFrame:
    """:func:`top_tokens` of the distinct texts without a table of the whole vocabulary; the same exact rows.

    A mergeable summary per group (``approx_top_k``, at most ``tracked`` tokens in each task)
    names candidates; their counts are then taken exactly.  A token that is no candidate occurs at most
    ``SUMMARY_ERROR * tokens / tracked`` times, so a group whose k-th count is above
    that bound is proven; the vocabulary of any other group (few texts, or a flat
    distribution) is counted whole.  Shuffled are the distinct texts, a summary per task and
    group, and the candidates' partial counts.  Three small jobs run here.
    """
    g = _as_list(group)
    toks = token_rows(materialize(distinct_texts(df, text, g), "token-texts"), text, g, distinct_first=False)
    summary = toks.groupBy(*g).agg(F.count(F.lit(1)).alias("_total"), F.call_function(
        "approx_top_k", F.col("token"), F.lit(tracked), F.lit(tracked)).alias("_items"))
    summary = materialize(summary, "token-summary")
    items = summary.select(*g, F.inline("_items")).select(*g, F.col("item").alias("token"))

    def only(rows: DataFrame, keys: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
        named = keys.select(*[F.col(c).alias(f"_k_{c}") for c in columns])
        return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns], how)

    if items.count() <= BROADCAST_TOKENS:  # a checked size; else the join's own choice
        items = F.broadcast(items)
    by = [*g, "token"]
    counts = only(toks, items, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    top = materialize(top_tokens(counts, k, g or None), "token-top")
    bound = F.col("_total") * SUMMARY_ERROR / tracked
    if not g:  # one group: its total and its k rows
        total, found = summary.first()["_total"], [r["n"] for r in top.select("n").collect()]
        error = total * SUMMARY_ERROR / tracked
        if error < 1 or len(found) == k and min(found) > error:
            return top
        return top_tokens(toks.groupBy("token").agg(F.count(F.lit(1)).alias("n")), k)
    least = top.groupBy(*[F.col(c).alias(f"_l_{c}") for c in g]).agg(F.count(F.lit(1)).alias("_rows"), F.min("n").alias("_least"))
    checked = summary.select(*g, "_total").join(least, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in g], "left")
    proven = (bound < 1) | (F.col("_rows") == k) & (F.col("_least") > bound)
    open_groups = materialize(checked.where(~F.coalesce(proven, F.lit(False))).select(*g), "token-open")
    if not open_groups.limit(1).count():
        return top
    whole = only(toks, open_groups, g).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return only(top, open_groups, g, "left_anti").unionByName(top_tokens(whole, k, g))


def top_k(counts: DataFrame, k: int, order: Sequence[Column], group: str | Sequence[str] | None = None) -> DataFrame:
    """Exact top ``k`` rows per group under a total ``order``; ``rank`` is 1-based.

    Per group, ``row_number() <= k`` lets the optimizer put a partial window-group
    limit on the map side, so every input partition sends at most ``k`` rows per
    group to the final ranking.  Without a group the ``k`` first rows are taken
    before they are numbered.
    """
    g = _as_list(group)
    if not g:
        counts = counts.orderBy(*order).limit(k)
    w = Window.partitionBy(*g).orderBy(*order) if g else Window.orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def top_tokens(counts: DataFrame, k: int = fixed.TOP_TOKENS, group: str | Sequence[str] | None = None) -> DataFrame:
    """Most frequent tokens per group; ties by token (ascending) so the result is deterministic."""
    return top_k(counts, k, [F.col("n").desc(), F.col("token").asc()], group)
