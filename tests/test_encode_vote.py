import math

import pytest
from pyspark.sql import functions as F

from dialframe.functions.hangul import has_final_consonant
from dialframe.operators.encode import code_points, encode_examples, pad_batches, pandas_encoder
from dialframe.operators.folds import fold_roles, kfold, with_global_index
from dialframe.operators.prompts import gold_index
from dialframe.operators.score import argmax_first, predict_from_scores, score_batches, softmax
from dialframe.operators.vote import accuracy, attach_predictions, hard_vote, validate_prediction_sets


def _prompts(spark, rows):
    return spark.createDataFrame(rows, "id string, system string, user string, target string, label int")


def test_encode_source_target_and_mask(spark):
    df = _prompts(spark, [("x", None, "ab", "c", 0), ("y", None, "ab", "", None)])
    from dialframe.operators.encode import ChatTemplate
    enc = {r["id"]: r for r in encode_examples(df, template=ChatTemplate(turn_suffix="")).collect()}
    assert list(enc["x"]["input_ids"]) == [97, 98, 99] and list(enc["x"]["labels"]) == [-100, -100, 99]
    assert list(enc["y"]["input_ids"]) == [97, 98] and list(enc["y"]["labels"]) == [-100, -100]


def test_code_points_blank_and_astral(spark):
    df = spark.createDataFrame([("",), ("가😀",)], "t string")
    got = [list(r[0]) for r in df.select(code_points(F.col("t"))).collect()]
    assert got == [[], [44032, 128512]]


def test_length_filter_train_only(spark):
    df = _prompts(spark, [("a", None, "ab", "", None), ("b", None, "abc", "", None)])
    from dialframe.operators.encode import ChatTemplate
    t = ChatTemplate(turn_suffix="")
    assert sorted(r["id"] for r in encode_examples(df, template=t, mode="train", max_source_len=2).collect()) == ["a"]
    assert encode_examples(df, template=t, mode="eval", max_source_len=2).count() == 2


def test_padding_by_value_and_length(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 3]), (2, [4], [4])], "k long, input_ids array<bigint>, labels array<bigint>")
    out = {r["k"]: r for r in pad_batches(df, "k", 2, 0).collect()}
    assert list(out[2]["input_ids"]) == [4, 0, 0] and list(out[2]["labels"]) == [4, -100, -100]
    assert list(out[2]["attention_mask"]) == [True, False, False]
    df2 = spark.createDataFrame([(1, [1, 0], [1, 0]), (2, [4], [4])], "k long, input_ids array<bigint>, labels array<bigint>")
    by_value = {r["k"]: list(r["attention_mask"]) for r in pad_batches(df2, "k", 2, 0).collect()}
    by_len = {r["k"]: list(r["attention_mask"]) for r in pad_batches(df2, "k", 2, 0, mask_by="length").collect()}
    assert by_value == {1: [True, False], 2: [True, False]}
    assert by_len == {1: [True, True], 2: [True, False]}


def test_pandas_encoder_plugs_in(spark):
    enc = pandas_encoder(lambda texts: [list(t.encode("utf-8")) for t in texts])
    df = _prompts(spark, [("x", None, "é", "a", 0)])
    from dialframe.operators.encode import ChatTemplate
    r = encode_examples(df, encoder=enc, template=ChatTemplate(turn_suffix="")).first()
    assert list(r["input_ids"]) == [195, 169, 97]


def test_global_index_and_folds(spark):
    df = spark.range(0, 10).select((F.col("id") * 7 + 3).alias("key"))
    idx = sorted((r["key"], r["idx"]) for r in with_global_index(df, "key", partitions=3).collect())
    assert [i for _, i in idx] == list(range(10))
    # clustered keys (most of them in a narrow range) still get a dense, ordered index
    skew = spark.range(0, 2000).select(F.when(F.col("id") < 1900, F.col("id")).otherwise(F.col("id") * 1000000)
                                        .alias("key"))
    got = [r["idx"] for r in with_global_index(skew, "key", partitions=16).orderBy("key").collect()]
    assert got == list(range(2000))
    folds = {r["key"]: r["fold"] for r in kfold(df, "key", 3).collect()}
    sizes = [sum(1 for v in folds.values() if v == f) for f in (1, 2, 3)]
    assert sizes == [4, 3, 3] and folds[3] == 1 and folds[66] == 3
    roles = fold_roles(kfold(df, "key", 3), 3).groupBy("round", "role").count().collect()
    assert {(r["round"], r["role"]): r["count"] for r in roles}[(1, "validation")] == 4
    with pytest.raises(Exception):
        kfold(spark.range(0, 2).select(F.col("id").alias("key")), "key", 3).collect()


def test_votes_fixture_rows(spark):
    cases = {"clear": [1, 1, 2], "tie_first": [1, 2, 2, 1, 3], "tie_later": [3, 2, 2, 1, 1], "all_diff": [3, 2, 1]}
    rows = [(k, f"inference_{v}", r) for k, vs in cases.items() for r, v in enumerate(vs, start=1)]
    got = {r["id"]: r["output"] for r in hard_vote(spark.createDataFrame(rows, "id string, output string, rank int")).collect()}
    assert got == {"clear": "inference_1", "tie_first": "inference_1", "tie_later": "inference_2",
                   "all_diff": "inference_3"}


def test_vote_order_invariance_for_untied(spark):
    rows = [("a", "inference_2", 1), ("a", "inference_2", 2), ("a", "inference_1", 3)]
    swapped = [("a", "inference_2", 3), ("a", "inference_2", 2), ("a", "inference_1", 1)]
    for rs in (rows, swapped):
        assert hard_vote(spark.createDataFrame(rs, "id string, output string, rank int")).first()["output"] == "inference_2"


def test_attach_validate_accuracy(spark):
    sub = spark.createDataFrame([("a", ""), ("b", ""), ("c", "")], "id string, output string")
    pred = spark.createDataFrame([("a", "inference_1"), ("b", "inference_2")], "id string, output string")
    att = {r["id"]: r["output"] for r in attach_predictions(sub, pred).collect()}
    assert att == {"a": "inference_1", "b": "inference_2", "c": None}
    sets = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "z")], "model string, id string")
    v = validate_prediction_sets(sub, sets).first()
    assert (v["n_rows"], v["n_missing"], v["n_extra"], v["n_duplicate_ids"]) == (3, 2, 1, 1)
    gold = spark.createDataFrame([("a", "inference_1"), ("b", "inference_3")], "id string, output string")
    acc = accuracy(pred, gold).first()
    assert (acc["n"], acc["n_correct"], acc["accuracy"]) == (2, 1, 0.5)


def test_softmax_argmax(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, 0.0), (1.0, 3.0, 3.0), (float("nan"), 1.0, 2.0)],
                               "a double, b double, c double")
    out = df.select(softmax(F.array("a", "b", "c")).alias("p"), argmax_first(F.array("a", "b", "c")).alias("i")).collect()
    assert math.isclose(out[0]["p"][0], 0.5) and out[0]["i"] == 0
    assert out[1]["i"] == 1 and out[2]["i"] == 0
    pred = predict_from_scores(df.withColumn("k", F.lit(1)), ["a", "b", "c"], ["k"]).collect()
    assert [r["output"] for r in pred] == ["inference_1", "inference_2", "inference_1"]


def test_score_batches_scorer_runs_once_per_worker(spark):
    import numpy as np

    def factory():
        return lambda pdf: np.stack([pdf["x"], -pdf["x"], np.zeros(len(pdf))], axis=1)
    df = spark.range(0, 20).select(F.col("id").alias("k"), (F.col("id") - 10).cast("double").alias("x"))
    got = {r["k"]: r["s_a"] for r in score_batches(df, factory, ["k"]).collect()}
    assert got[0] == -10.0 and got[19] == 9.0
    # sub-batches of 3 rows give the same scores
    small = {r["k"]: r["s_a"] for r in score_batches(df, factory, ["k"], batch_rows=3).collect()}
    assert small == got


def test_particles(spark):
    cats = ["원인", "후행사건", "전제", "동기", "반응", "원인(cause)"]
    df = spark.createDataFrame([(c,) for c in cats], "c string")
    finals = [r[0] for r in df.select(has_final_consonant(F.col("c"))).collect()]
    assert finals == [True, True, False, False, True, True]   # ')' -> floored modulo 25 > 0


def test_gold_index_rejects_unknown(spark):
    df = spark.createDataFrame([("",), ("inference_3",)], "o string")
    assert [r[0] for r in df.select(gold_index(F.col("o"))).collect()] == [None, 2]
    with pytest.raises(Exception):
        spark.createDataFrame([("bogus",)], "o string").select(gold_index(F.col("o"))).collect()


def test_index_on_string_null_and_tied_keys(spark):
    rows = [(None, i) for i in range(900)] + [("b", i) for i in range(60)] + [("a" * (i % 5), i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, n int")
    first = with_global_index(df, "key", partitions=8).collect()
    got = [r["key"] for r in sorted(first, key=lambda r: r["idx"])]
    assert got == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or ""))
    assert sorted(r["idx"] for r in first) == list(range(1000))
    again = with_global_index(df.repartition(5), "key", partitions=3).collect()
    assert {(r["key"], r["n"]): r["idx"] for r in first} == {(r["key"], r["n"]): r["idx"] for r in again}
    assert with_global_index(df.limit(0), "key").count() == 0 and kfold(df.limit(0), "key", 2).count() == 0


def test_equal_keys_are_spread_over_ranges(spark):
    from dialframe.operators import folds
    df = spark.range(4000).select(F.lit(None).cast("string").alias("key"), F.col("id"))
    sizes = {}
    real = folds.materialize
    try:
        folds.materialize = lambda d, n: sizes.setdefault("df", real(d, n))
        with_global_index(df, "key", partitions=8)
    finally:
        folds.materialize = real
    counts = [r["count"] for r in sizes["df"].groupBy("_bucket").count().collect()]
    assert len(counts) >= 6 and max(counts) < 1500


def test_folds_per_group(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("x", 5), ("y", 7), (None, 2)) for i in range(n)], "g string, k long")
    got = {}
    for r in kfold(df, "k", 2, by="g").collect():
        got.setdefault(r["g"], []).append((r["k"], r["idx"], r["fold"]))
    assert {g: [f for *_, f in sorted(v)] for g, v in got.items()} == {
        "x": [1, 1, 1, 2, 2], "y": [1, 1, 1, 1, 2, 2, 2], None: [1, 2]}
    assert all([i for _, i, _ in sorted(v)] == list(range(len(v))) for v in got.values())


def test_source_is_encoded_once(spark):
    df = _prompts(spark, [("a", None, "ab", "x", None), ("b", None, "abc", "y", None)])
    native = encode_examples(df, mode="train", max_source_len=3)._jdf.queryExecution().optimizedPlan().toString()
    assert native.count("split(") == 2  # source and target
    enc = pandas_encoder(lambda texts: [list(t.encode()) for t in texts])
    plan = encode_examples(df, encoder=enc, mode="train", max_source_len=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_encode(") == 2 * plan.count("ArrowEvalPython [") or plan.count("ArrowEvalPython") == 2


def test_scorer_is_built_once_per_worker(spark, tmp_path):
    """16 tasks: as many factory calls as worker processes; two scorers of one session do not mix."""
    import os

    def factory(tag, value):
        def build():
            with open(tmp_path / f"{tag}-{os.getpid()}", "a") as f:
                f.write("x")
            return lambda pdf: [[value, float(os.getpid()), 0.0]] * len(pdf)
        return build

    df = spark.range(160).repartition(16)
    for _ in range(2):
        one = score_batches(df, factory("one", 1.0), ["id"], name="one").collect()
        two = score_batches(df, factory("two", 2.0), ["id"], name="two").collect()
        assert {r.s_a for r in one} == {1.0} and {r.s_a for r in two} == {2.0}
    for tag in ("one", "two"):
        calls = [p.read_text() for p in tmp_path.glob(f"{tag}-*")]
        assert calls and set(calls) == {"x"}


def test_messages_need_a_system_text(spark):
    from dialframe.operators.prompts import to_messages
    df = spark.createDataFrame([("s", "u"), (None, "u")], "system string, user string")
    rows = df.select(to_messages(F.col("system"), F.col("user")).alias("m"))
    assert [x["content"] for x in rows.limit(1).first()["m"]] == ["s", "u"]
    with pytest.raises(Exception, match="no system text"):
        rows.collect()


def test_arrays_are_shuffled_once_for_padding(spark):
    """Numbers are ranked and batched; the arrays only meet them in the join."""
    df = spark.range(200).select(F.col("id").alias("k"), F.array_repeat("id", (F.col("id") % 7 + 1).cast("int")).alias("input_ids"))
    df = df.withColumn("labels", F.col("input_ids"))
    out = pad_batches(df, "k", 8, 0, unique=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "xxhash64" not in plan       # offsets to ranges, widths to rows
    bare = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = pad_batches(df, "k", 8, 0, unique=True)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bare)
    with_arrays = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(_row" in x]
    assert len(with_arrays) == 2 and sum("Exchange" in x for x in lines) <= 7
    got = sorted((r["k"], r["batch"], r["batch_len"], len(r["input_ids"]), len(r["attention_mask"])) for r in out.collect())
    for k, batch, width, n, m in got:
        assert batch == k // 8 and n == m == width == max(i % 7 + 1 for i in range(batch * 8, min(200, batch * 8 + 8)))


def test_wide_rows_are_numbered_by_their_order_alone(spark):
    rows = [(f"k{i % 50:02d}", "text " * 20 + str(i), [i]) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, text string, ids array<int>")
    got = with_global_index(df, "key", total="n", partitions=5).collect()
    assert sorted(r["idx"] for r in got) == list(range(300)) and {r["n"] for r in got} == {300}
    assert [r["key"] for r in sorted(got, key=lambda r: r["idx"])] == sorted(k for k, _, _ in rows)
    again = with_global_index(df.repartition(3), "key", partitions=2).collect()
    assert {r["text"]: r["idx"] for r in got} == {r["text"]: r["idx"] for r in again}


def test_dropped_rows_are_counted_as_they_are_encoded(spark, tmp_path, capsys):
    import json
    from pyspark.sql import Observation
    from dialframe.cli import main
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return [[ord(c) for c in t] for t in texts]

    rows = [("a", "s", "x" * n, "t", 0, v) for n in (5, 50, 500) for v in ("v1", "v4")]
    df = spark.createDataFrame(rows, "id string, system string, user string, target string, label int, variant string")
    seen = Observation()
    enc = encode_examples(df, ("id", "variant"), pandas_encoder(counted), mode="train", max_source_len=100, observation=seen)
    assert len(enc.collect()) == 4 and calls.value == 6 + 4           # every source once, the targets that are left
    assert (seen.get["n_kept"], seen.get["n_dropped"], seen.get["n_dropped_v1"], seen.get["n_kept_v4"]) == (4, 2, 1, 2)
    with pytest.raises(ValueError):
        encode_examples(df, ("id",), observation=Observation())

    def example(i, n):
        return {"id": i, "input": {"conversation": [{"speaker": 1, "utterance": "글" * n, "utterance_id": "u"}], "reference_id": ["u"],
                                   "category": "원인", "inference_1": "가", "inference_2": "나", "inference_3": "다"},
                "output": "inference_1"}

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "train.json").write_text(json.dumps([example(f"t{i}", 3000 if i == 1 else 9) for i in range(5)]))
    for flags in ([], ["--k-folds", "2"]):
        main(["prompts", str(tmp_path / "src"), str(tmp_path / "out"), "--variant", "v1", "v2", "--mode", "train",
              "--max-source-len", "1500", *flags], spark=spark)
        said = capsys.readouterr().out
        assert "2 of 10 examples dropped" in said and "v2: 1 dropped, 4 kept" in said
        assert spark.read.parquet(str(tmp_path / "out")).count() == 8
