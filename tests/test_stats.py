from pyspark.sql import functions as F

from dialframe.operators.stats import (percent_text, distribution, fixed_key_distribution, histogram, length_summary,
                                       token_counts, top_tokens, with_combined_split)


def _hist(spark, values, step, group=True):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    out = histogram(df, "v", step, "g" if group else None).orderBy("bin").collect()
    return [r["n"] for r in out]


def test_histogram_fixture_rows(spark):
    assert _hist(spark, [3, 2, 3, 1], 1) == [0, 1, 3]
    assert _hist(spark, [100, 50, 49], 50) == [1, 2]
    assert _hist(spark, [101, 50], 50) == [0, 1, 1]
    assert _hist(spark, [101, 50], 50, group=False) == [0, 1, 1]


def test_histogram_reference_lengths(spark):
    # a 50-wide histogram keeps every value and ends at ceil(max / 50) bins
    vals = [91, 424, 1071, 1050, 1000, 0, 49, 50]
    got = _hist(spark, vals, 50)
    assert len(got) == 22 and sum(got) == len(vals) and got[-1] == 2 and got[0] == 2


def test_distribution_counts_hidden_keys_in_total(spark):
    df = spark.createDataFrame([("a", "inference_1"), ("a", ""), ("a", "inference_3"), ("a", "inference_3")],
                               "split string, output string")
    got = {r["output"]: (r["key_pos"], r["n"], r["pct"]) for r in
           fixed_key_distribution(df, "output", ["inference_1", "inference_2", "inference_3"], "split").collect()}
    assert got == {"inference_1": (0, 1, 25.0), "inference_2": (1, 0, 0.0), "inference_3": (2, 2, 50.0)}
    free = {r["output"]: r["pct"] for r in distribution(df, "output").collect()}
    assert free[""] == 25.0 and free["inference_3"] == 50.0


def test_summary_and_union(spark):
    df = spark.createDataFrame([("train", 3), ("dev", 5), ("test", 7)], "split string, v long")
    got = {r["split"]: (r["n"], r["mean"], r["min"], r["max"])
           for r in length_summary(with_combined_split(df), "v", "split").collect()}
    assert got["train+dev"] == (2, 4.0, 3, 5) and got["test"] == (1, 7.0, 7, 7)


def test_tokens_and_top_k(spark):
    df = spark.createDataFrame([("s", "ㅋ 좋아 좋아 a"), ("s", "ㅋ 좋아 좋아 a"), ("s", "ㅋㅋㅋ 너무 좋아")],
                               "split string, text string")
    counts = {r["token"]: r["n"] for r in token_counts(df, "text", "split").collect()}
    assert counts == {"ㅋㅋ": 2, "좋아": 3, "너무": 1}
    big = spark.range(0, 5000).select(F.lit("s").alias("split"), F.concat(F.lit("t"), (F.col("id") % 97).cast("string")).alias("token"),
                                      (F.col("id") % 13).alias("n"))
    top = top_tokens(big.groupBy("split", "token").agg(F.sum("n").alias("n")), 5, "split")
    exact = big.groupBy("split", "token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(5)
    assert [r["token"] for r in top.orderBy("rank").collect()] == [r["token"] for r in exact.collect()]


def test_percent_text(spark):
    df = spark.createDataFrame([(12.5,), (100.0 / 3,)], "p double")
    assert [r[0] for r in df.select(percent_text("p")).collect()] == ["12.50%", "33.33%"]


def test_histogram_ignores_negative_values(spark):
    df = spark.createDataFrame([("g", -5), ("g", 3), ("g", 1), ("g", None)], "g string, v long")
    # 1 and 3 remain: bins [0,1), [1,2), [2,3] with the top bin closed
    assert [r["n"] for r in histogram(df, "v", 1, "g").orderBy("bin").collect()] == [0, 1, 1]


def test_percentages_print_half_way_values_to_the_even_digit(spark):
    values = [0.125, 0.375, 2.675, 100.0, 0.0, 12.345, 1 / 3, 33.335, 0.005]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r[0] for r in df.select(percent_text("p")).collect()] == ["%.2f%%" % v for v in values]


def test_a_far_outlier_makes_rows_not_one_array(spark):
    from dialframe.operators import stats
    df = spark.createDataFrame([("a", 3), ("a", 10**9), ("b", 100), ("b", 7), ("b", 50), ("c", 0)], "g string, v long")
    out = histogram(df, "v", 50, "g")
    per = {r["g"]: (r["n_bins"], r["n"], r["top"]) for r in out.groupBy("g").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n"), F.max("bin").alias("top")).collect()}
    assert per == {"a": (20_000_000, 2, 19_999_999), "b": (2, 3, 1), "c": (1, 1, 0)}
    got = sorted((r["g"], r["bin"], r["n"]) for r in out.where("n > 0 or g <> 'a'").collect())
    assert got == [("a", 0, 1), ("a", 19_999_999, 1), ("b", 0, 1), ("b", 1, 2), ("c", 0, 1)]
    assert stats.GAP_BINS == 4096


def test_histograms_equal_numpy(spark, monkeypatch):
    import random
    import numpy as np
    from dialframe.operators import stats
    monkeypatch.setattr(stats, "GAP_BINS", 3)
    r, rows = random.Random(4), []
    for g in range(60):
        rows += [(g, r.choice([0, 1, 5, 10, 19, 20, 40, 41, 200, r.randint(0, 300)])) for _ in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "g int, v long")
    for step in (1, 10, 20):
        got = {}
        for x in histogram(df, "v", step, "g").collect():
            got.setdefault(x["g"], {})[x["bin"]] = x["n"]
        for g in range(60):
            v = [y for k, y in rows if k == g]
            bins = max(1, -(-max(v) // step))
            want = np.histogram(v, [step * i for i in range(bins + 1)])[0].tolist()
            assert [got[g][i] for i in sorted(got[g])] == want, (g, step, v)


def test_frequent_tokens_equal_the_whole_count(spark, monkeypatch):
    """A long-tailed group is proven by the summary's bound; a flat one is counted whole."""
    import random
    from dialframe.operators import stats
    r, rows = random.Random(2), []
    for i in range(400):
        rows.append(("zipf", " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(60))))
        rows.append(("flat", " ".join(f"f{r.randint(0, 20000)}" for _ in range(60))))
    rows += [(None, "aa bb aa"), (None, None), ("one", "x yy"), ("zipf", rows[0][1])]
    df = spark.createDataFrame(rows, "g string, text string").repartition(4)
    names, real = [], stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda d, n: names.append((n, real(d, n))) or names[-1][1])
    got = stats.frequent_tokens(df, 5, "text", "g", tracked=500)
    want = top_tokens(token_counts(df, "text", "g"), 5, "g")
    key = lambda d: sorted(((x["g"] or "", x["rank"], x["token"], x["n"]) for x in d.collect()))
    assert key(got) == key(want)
    made = dict(names)
    assert [x["g"] for x in made["token-open"].collect()] == ["flat"]
    # Shuffled for the proven group: its candidates, fewer than its vocabulary.
    held = made["token-summary"].where("g = 'zipf'").select(F.size("_items")).first()[0]
    assert held <= 500 < token_counts(df.where("g = 'zipf'"), "text", "g").count()
    for tracked in (500, 40):
        got = stats.frequent_tokens(df.where("g = 'zipf'"), 5, "text", tracked=tracked).collect()
        assert [(x["token"], x["n"], x["rank"]) for x in sorted(got, key=lambda x: x["rank"])] == [
            (t, n, k) for _, k, t, n in key(want) if _ == "zipf"]
    assert stats.frequent_tokens(df.where("g = 'none'"), 5, "text", "g").count() == 0
