"""URL filter: longest-match host/path rules, then gradient-boosted trees on lexical features.

Labelled URLs train the trees.  Features are lexical only: lengths, depth, digit
and hyphen counts, character entropy, parameter counts, and the smoothed share
of blocked URLs per host suffix and per path extension among the labelled URLs.

Training takes at most ``max_train_rows`` labelled URLs (the first by hash), so
its cost does not follow the input; suffix statistics cover all labelled URLs
and every URL is scored.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged on its (empty) features; repeated rows are judged one
by one; with labels of one class only there are no trees and every URL without a
rule gets that class (``allow`` without any label); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import pick

# Host, path prefix, verdict.
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Seed words of the weak labels: a host that holds one is taken as a block example.
SEED_WORDS = ("adult", "casino", "pills", "bets", "spam", "ads-")
MAX_TRAIN_ROWS = 5_000
FEATURES = ("url_chars", "host_chars", "path_chars", "host_labels", "path_depth", "digit_ratio", "hyphens_host",
            "hyphens_path", "entropy", "n_params", "query_chars", "has_fragment", "is_https", "suffix_rate",
            "extension_rate")
_PRIOR = 20.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # a later, longer one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features and the two suffix keys; needs url, host, path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.split(url, "")
    distinct = F.array_distinct(chars)
    share = F.transform(distinct, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))

    def count(text: Column, sign: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    columns = {
        "url_chars": F.length(url), "host_chars": F.length("host"), "path_chars": F.length("path"),
        "host_labels": count(F.col("host"), "."), "path_depth": count(F.col("path"), "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        "hyphens_host": count(F.col("host"), "-"), "hyphens_path": count(F.col("path"), "-"), "entropy": entropy,
        "n_params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_chars": F.length(query),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "is_https": F.startswith(url, F.lit("https:")).cast("int"),
        "suffix": F.substring_index("host", ".", -1),
        "extension": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1),
    }
    return df.withColumns({k: v if k in ("suffix", "extension") else v.cast("double") for k, v in columns.items()})


def _rates(labelled: DataFrame, key: str, name: str) -> DataFrame:
    """Smoothed share of blocked URLs per value of ``key``, over all labelled URLs."""
    return labelled.groupBy(key).agg(
        ((F.sum("label") + _PRIOR * 0.5) / (F.count("*") + _PRIOR)).alias(name))


def _with_rates(df: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for key, table in rates.items():
        name = f"{key}_rate"
        df = df.join(table, key, "left").withColumn(name, F.coalesce(name, F.lit(0.5)))
    return df


class UrlModel:
    """Trees and suffix statistics fitted on labelled URLs."""

    def __init__(self, trees: PipelineModel | None, rates: dict[str, DataFrame], only: str):
        self.trees, self.rates, self.only = trees, rates, only

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (probability of block) and ``model_verdict``; ``df`` has url, host, path."""
        if self.trees is None:
            return df.withColumns({"score": F.lit(None).cast("double"), "model_verdict": F.lit(self.only)})
        kept = df.columns
        scored = self.trees.transform(_with_rates(_lexical(df), self.rates))
        p = vector_to_array("probability")[1]
        return scored.select(*kept, p.alias("score"),
                             F.when(p >= 0.5, "block").otherwise("allow").alias("model_verdict"))


def weak_labels(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Labelled URLs (url, label) of a table with url, host, path: the rule's verdict, else the seed words'."""
    _, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    seeded = F.lit(False)
    for w in SEED_WORDS:
        seeded = seeded | F.contains("host", F.lit(w))
    return urls.where("url is not null").select(
        "url", F.coalesce(verdict == "block", seeded).cast("double").alias("label"))


def train(labelled: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> UrlModel:
    """Fit on labelled URLs: columns url and label (1.0 block, 0.0 allow)."""
    rows = pick(labelled, url="url", label="label").where("url is not null and label is not null")
    rows = _lexical(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
    rates = {"suffix": _rates(rows, "suffix", "suffix_rate"),
             "extension": _rates(rows, "extension", "extension_rate")}
    sample = rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_train_rows)
    sample = _with_rates(sample, rates).select("label", *FEATURES).coalesce(1).cache()
    classes = sorted(r.label for r in sample.select("label").distinct().collect())
    if len(classes) < 2:
        only = "block" if classes == [1.0] else "allow"
        sample.unpersist()
        return UrlModel(None, rates, only)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.3,
                          maxBins=32, seed=11)
    fitted = trees.fit(assembled.transform(sample))
    sample.unpersist()
    return UrlModel(PipelineModel([assembled, fitted]), rates, "allow")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None,
          key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; without ``labelled``, :func:`weak_labels` trains."""
    rows = pick(pages, page_id=key, url=url)
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    model = train(labelled if labelled is not None else weak_labels(rows, rules))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return model.verdicts(rows).select("page_id", "host", "path", rule.alias("rule"),
                                       F.coalesce(verdict, F.col("model_verdict")).alias("verdict"), "score")
