import glob
import json
import os
import tempfile

import pytest

from dialframe.operators.prompts import build_prompts
from dialframe.operators.turns import example_lengths, refine_examples
from dialframe.operators.vote import hard_vote
from dialframe.sources.jsonio import (fold_prediction_paths, prediction_set_name, read_examples,
                                      read_fold_predictions, read_prediction_sets, recipe_frame,
                                      write_examples_json, write_if_absent, write_lengths_csv)
from dialframe.streaming.refine_stream import start_refine


def _example(i, conv, refs, output="inference_1", category="원인"):
    return {"id": f"t-train-{i:06d}", "input": {
        "conversation": [{"speaker": s, "utterance": u, "utterance_id": uid} for s, u, uid in conv],
        "reference_id": refs, "category": category, "inference_1": "가", "inference_2": "나", "inference_3": "다"},
        "output": output}


EXAMPLES = [
    _example(1, [(2, "ㅇㅇ 좋아", "a.1"), (1, "^^", "a.2"), (2, "진짜?????", "a.3"), (2, "name1 최고", "a.4")], ["a.4"]),
    _example(2, [(1, "안녕하세요", "b.1"), (1, "오늘 비 와", "b.2"), (1, "우산 챙겨", "b.3")], ["b.3"], "",
             "동기"),
]


@pytest.fixture()
def src_dir():
    d = tempfile.mkdtemp(prefix="dialframe-io-", dir="/tmp")
    with open(os.path.join(d, "train.json"), "w", encoding="utf-8") as f:
        json.dump(EXAMPLES[:1], f, ensure_ascii=False, indent=4)
    with open(os.path.join(d, "dev.json"), "w", encoding="utf-8") as f:
        json.dump(EXAMPLES[1:], f, ensure_ascii=False, indent=4)
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not an example file")
    return d


def test_read_refine_write_roundtrip(spark, src_dir):
    ex = read_examples(spark, src_dir)
    assert sorted(r["split"] for r in ex.collect()) == ["dev", "train"]
    refined = refine_examples(ex)
    out = tempfile.mkdtemp(prefix="dialframe-out-", dir="/tmp")
    write_examples_json(refined, out + "/refined")
    lines = [json.loads(x) for f in glob.glob(out + "/refined/split=train/*.json") for x in open(f, encoding="utf-8")]
    conv = lines[0]["input"]["conversation"]
    assert conv == [{"speaker": 2, "utterance": "응 좋아 진짜??", "utterance_id": ["a.1", "a.3"]},
                    {"speaker": 2, "utterance": "화자1 최고", "utterance_id": "a.4"}]
    # the refined JSON Lines read back with list-or-string ids normalised to arrays
    back = read_examples(spark, out + "/refined/split=train", multi_line=False).first()
    assert [(u["utterance"], list(u["utterance_id"])) for u in back["conversation"]] == [
        ("응 좋아 진짜??", ["a.1", "a.3"]), ("화자1 최고", ["a.4"])]
    lens = {r["id"]: (r["n_turns"], r["total_utterance_length"]) for r in example_lengths(refined).collect()}
    assert lens["t-train-000001"] == (2, len("응 좋아 진짜??") + len("화자1 최고"))
    write_lengths_csv(example_lengths(refined), out + "/lengths")
    rows = [x for f in glob.glob(out + "/lengths/*.csv") for x in open(f, encoding="utf-8")]
    assert rows[0].strip() == "id,total_utterance_length"


def test_prompts_on_read_examples(spark, src_dir):
    ex = refine_examples(read_examples(spark, src_dir))
    p = {r["id"]: r for r in build_prompts(ex, ["v1"], keep=("id",), ids_are_arrays=True).collect()}
    dev = p["t-train-000002"]["user"]
    # 동기 ends without a final consonant: the question collapses to the bare particle (reference mode)
    assert "\n\n로 올바른 지문은?\n\n" in dev
    assert dev.startswith("[Conversation]\n화자1: 오늘 비 와\n화자1: 우산 챙겨\n\n[Utterance References]\n화자1: 우산 챙겨")
    assert p["t-train-000001"]["target"] == "A. 가</s>" and p["t-train-000002"]["label"] is None


def test_prediction_sets_and_votes(spark):
    d = tempfile.mkdtemp(prefix="dialframe-pred-", dir="/tmp")
    votes = {"m1": ["inference_1", "inference_2"], "m2": ["inference_2", "inference_2"],
             "m3": ["inference_2", "inference_1"], "m4": ["inference_1", "inference_3"]}
    for name, outs in votes.items():
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            json.dump([{"id": f"q{i}", "output": o} for i, o in enumerate(outs)], f)
    preds = read_prediction_sets(spark, d, ["m1", "m2.json", "m3", "m4"])
    got = {r["id"]: r["output"] for r in hard_vote(preds).collect()}
    # q0: 1,2,2,1 -> tie between 1 and 2, first vote (m1) wins; q1: 2,2,1,3 -> 2
    assert got == {"q0": "inference_1", "q1": "inference_2"}
    with pytest.raises(FileNotFoundError):
        read_prediction_sets(spark, d, ["m1", "missing"])
    stem = os.path.join(d, "out.json")
    for i, p in enumerate(fold_prediction_paths(stem, 3), start=1):
        with open(p, "w") as f:
            json.dump([{"id": "q0", "output": "inference_3" if i > 1 else "inference_1"}], f)
    folds = read_fold_predictions(spark, stem, 3)
    assert sorted(r["rank"] for r in folds.collect()) == [1, 2, 3]
    assert hard_vote(folds).first()["output"] == "inference_3"


def test_write_if_absent_keeps_existing(spark):
    d = tempfile.mkdtemp(prefix="dialframe-ign-", dir="/tmp") + "/p"
    write_if_absent(spark.createDataFrame([("a", "inference_1")], "id string, output string"), d)
    write_if_absent(spark.createDataFrame([("b", "inference_2")], "id string, output string"), d)
    assert [r["id"] for r in spark.read.json(d).collect()] == ["a"]


def test_recipe_names(spark):
    names = [r["name"] for r in recipe_frame(spark).orderBy("rank").collect()]
    assert len(names) == 11 and names[1].startswith("Refined_") and names[0].endswith("-QLoRA_2e-4")
    assert prediction_set_name("v1", "org/some-model", "LoRA", "1e-4", False) == "CustomRefDataset-some-model-LoRA_1e-4"


def test_streaming_refine_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="dialframe-src-", dir="/tmp")
    with open(os.path.join(src, "part-0.json"), "w", encoding="utf-8") as f:
        for e in EXAMPLES:
            f.write(json.dumps(e, ensure_ascii=False) + "\n")
    sink = tempfile.mkdtemp(prefix="dialframe-sink-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="dialframe-sckpt-", dir="/tmp")
    q = start_refine(spark, src, sink, ckpt)
    q.awaitTermination(120)
    rows = [json.loads(x) for f in glob.glob(sink + "/*.json") for x in open(f, encoding="utf-8")]
    by_id = {r["id"]: r for r in rows}
    assert by_id["t-train-000001"]["input"]["conversation"][0]["utterance"] == "응 좋아 진짜??"
    # the greeting-only turn is dropped; the reference turn stays a run of its own
    assert [(u["utterance"], u["utterance_id"]) for u in by_id["t-train-000002"]["input"]["conversation"]] == [
        ("오늘 비 와", "b.2"), ("우산 챙겨", "b.3")]


def test_ensemble_modes_and_errors(spark):
    from dialframe.plans.ensemble import ensemble
    d = tempfile.mkdtemp(prefix="dialframe-ens-", dir="/tmp")
    sub = spark.createDataFrame([("q0", ""), ("q1", "")], "id string, output string")
    for name, outs in {"a": ["inference_1", "inference_2"], "b": ["inference_3", "inference_2"],
                       "c": ["inference_3", "inference_1"]}.items():
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            json.dump([{"id": f"q{i}", "output": o} for i, o in enumerate(outs)], f)
    got = {r["id"]: r["output"] for r in ensemble(spark, sub, base_dir=d, names=["a", "b", "c"]).collect()}
    assert got == {"q0": "inference_3", "q1": "inference_2"}
    with pytest.raises(ValueError):
        ensemble(spark, sub, base_dir=d, names=["a"])
    with open(os.path.join(d, "short.json"), "w") as f:
        json.dump([{"id": "q0", "output": "inference_1"}], f)
    with pytest.raises(ValueError, match="missing"):
        ensemble(spark, sub, base_dir=d, names=["a", "short"])
    stem = os.path.join(d, "m.json")
    for i, p in enumerate(fold_prediction_paths(stem, 2), start=1):
        with open(p, "w") as f:
            json.dump([{"id": "q0", "output": "inference_2"}, {"id": "q1", "output": f"inference_{i}"}], f)
    got = {r["id"]: r["output"] for r in ensemble(spark, sub, k_folds=2, output=stem).collect()}
    assert got == {"q0": "inference_2", "q1": "inference_1"}


def test_source_only_scoring_input(spark):
    from dialframe.operators.score import source_only
    df = spark.createDataFrame([("x", [1, 2, 3, 4], 2)], "id string, input_ids array<bigint>, n_source int")
    assert list(source_only(df, ["id"]).first()["input_ids"]) == [1, 2]


def test_ingest_and_split_pruning(spark, src_dir):
    from dialframe.sources.jsonio import ingest_examples, read_ingested
    dest = tempfile.mkdtemp(prefix="dialframe-ing-", dir="/tmp") + "/examples"
    ingest_examples(spark, src_dir, dest)
    dev = read_ingested(spark, dest, ["dev"])
    assert [r["id"] for r in dev.collect()] == ["t-train-000002"]
    plan = dev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "dev" in plan


def test_streaming_clean_of_utterances(spark):
    from dialframe.streaming.refine_stream import clean_utterance_stream
    src = tempfile.mkdtemp(prefix="dialframe-us-", dir="/tmp")
    spark.createDataFrame([(1, 0, "ㅇㅇ 좋아"), (1, 1, "^^"), (2, 0, "name1 왔어")],
                          "conv_id long, turn long, text string").write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(src + "/in")
    q = (clean_utterance_stream(stream).writeStream.format("memory").queryName("clean_stream_test")
         .option("checkpointLocation", src + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted((r["conv_id"], r["turn"], r["text"]) for r in spark.sql("SELECT * FROM clean_stream_test").collect())
    assert got == [(1, 0, "응 좋아"), (2, 0, "화자1 왔어")]


def test_fold_prediction_sets_resume(spark):
    from dialframe.sources.jsonio import write_fold_predictions
    d = tempfile.mkdtemp(prefix="dialframe-fold-", dir="/tmp")
    stem = os.path.join(d, "model.json")
    first = spark.createDataFrame([("q0", "inference_1", 1), ("q0", "inference_2", 2)], "id string, output string, fold int")
    write_fold_predictions(first, stem, 2)
    second = spark.createDataFrame([("q0", "inference_3", 1), ("q0", "inference_3", 2)], "id string, output string, fold int")
    write_fold_predictions(second, stem, 2)          # both folds exist: nothing is redone
    got = sorted((r["rank"], r["output"]) for r in read_fold_predictions(spark, stem, 2).collect())
    assert got == [(1, "inference_1"), (2, "inference_2")]


def test_cli_commands(spark, src_dir):
    from dialframe.cli import main
    from dialframe.sources.jsonio import id_sequence
    out = tempfile.mkdtemp(prefix="dialframe-cli-", dir="/tmp")
    main(["refine", src_dir, out + "/refined"], spark=spark)
    assert len(glob.glob(out + "/refined/split=train/*.json")) >= 1
    main(["eda", src_dir, out + "/eda"], spark=spark)
    sizes = {r["split"]: int(r["n"]) for r in spark.read.option("header", True).csv(out + "/eda/split_sizes").collect()}
    assert sizes == {"train": 1, "dev": 1, "train+dev": 2}
    main(["prompts", src_dir, out + "/prompts", "--variant", "v1", "CustomRefInstructionDataset"], spark=spark)
    enc = spark.read.parquet(out + "/prompts")
    assert sorted(r["variant"] for r in enc.select("variant").distinct().collect()) == ["v1", "v4"]
    assert enc.where("n_source > 0").count() == 4
    ids = spark.createDataFrame([("x-dev-000042",), ("nope",)], "id string")
    assert [r[0] for r in ids.select(id_sequence("id")).collect()] == [42, None]


def test_cli_eda_on_refined_output(spark, src_dir):
    from dialframe.cli import main
    out = tempfile.mkdtemp(prefix="dialframe-cli2-", dir="/tmp")
    main(["refine", src_dir, out + "/refined"], spark=spark)
    main(["eda", out + "/refined", out + "/eda", "--json-lines"], spark=spark)
    sizes = {r["split"]: int(r["n"]) for r in spark.read.option("header", True).csv(out + "/eda/split_sizes").collect()}
    assert sizes == {"train": 1, "dev": 1, "train+dev": 2}
    lens = {r["id"]: int(r["total_utterance_length"])
            for r in spark.read.option("header", True).csv(out + "/eda/total_utterance_lengths").collect()}
    assert lens["t-train-000001"] == len("응 좋아 진짜??") + len("화자1 최고")


def test_cli_vote(spark):
    from dialframe.cli import main
    d = tempfile.mkdtemp(prefix="dialframe-cli3-", dir="/tmp")
    with open(os.path.join(d, "submission.json"), "w") as f:
        json.dump([{"id": "q0", "output": ""}, {"id": "q1", "output": ""}], f)
    for name, outs in {"a": ["inference_1", "inference_2"], "b": ["inference_2", "inference_3"],
                       "c": ["inference_2", "inference_1"]}.items():
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            json.dump([{"id": f"q{i}", "output": o} for i, o in enumerate(outs)], f)
    main(["vote", "--submission", os.path.join(d, "submission.json"), "--output", d + "/final",
          "--predictions-dir", d, "a", "b", "c"], spark=spark)
    got = {r["id"]: r["output"] for r in spark.read.json(d + "/final").collect()}
    # q0: 1,2,2 -> 2; q1: 2,3,1 -> all different, the first set wins
    assert got == {"q0": "inference_2", "q1": "inference_2"}
    with pytest.raises(ValueError):
        main(["vote", "--submission", os.path.join(d, "submission.json"), "--output", d + "/x",
              "--predictions-dir", d, "a"], spark=spark)


def _write_array(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)


def test_fold_round_trip_from_score_to_submission(spark, tmp_path, monkeypatch):
    """score -> fold sets -> ensemble -> submission, from ``./dir`` and from a name with a space."""
    from pyspark.sql import functions as F

    from dialframe.operators.score import predict_from_scores, score_batches
    from dialframe.plans.ensemble import ensemble
    from dialframe.sources.jsonio import write_fold_predictions
    monkeypatch.chdir(tmp_path)
    ids = [f"q{i:02d}" for i in range(12)]
    enc = spark.createDataFrame([(q, f, [i + f]) for i, q in enumerate(ids) for f in (1, 2, 3)],
                                "id string, fold int, input_ids array<bigint>").repartition(5)

    def factory():
        def score(pdf):
            return [[float(x[0] % 3 == 0), float(x[0] % 3 == 1), float(x[0] % 3 == 2)] for x in pdf["input_ids"]]
        return score

    preds = predict_from_scores(score_batches(enc, factory, ["id", "fold"]), ["s_a", "s_b", "s_c"], ["id", "fold"])
    sub = spark.createDataFrame([(q, "") for q in ids], "id string, output string")
    # The three folds of an id vote for three labels: fold 1 wins the tie.
    want = {q: f"inference_{(i + 1) % 3 + 1}" for i, q in enumerate(ids)}
    for name in (f"{tmp_path}/a b/model.json", f"{tmp_path}/./plain/model.json"):
        paths = write_fold_predictions(preds.select("id", "output", "fold"), name, 3)
        assert len(paths) == 3
        got = {r["id"]: r["output"] for r in ensemble(spark, sub, k_folds=3, output=name).collect()}
        assert got == want
    base = f"{tmp_path}/./a b"
    got = ensemble(spark, sub, base_dir=base, names=["model_fold_1", "model_fold_2.json", "model_fold_3"])
    assert {r["id"]: r["output"] for r in got.collect()} == want
    with pytest.raises(Exception, match="missing|no rows"):
        write_fold_predictions(preds.select("id", "output", (F.col("fold") + 1).alias("fold")), f"{tmp_path}/late.json", 4)
        ensemble(spark, sub, k_folds=4, output=f"{tmp_path}/late.json")


def test_prefix_names_do_not_mix(spark, tmp_path):
    for name, label in (("X", "inference_1"), ("Refined_X", "inference_2")):
        _write_array(tmp_path / f"{name}.json", [{"id": "q0", "output": label}])
    got = read_prediction_sets(spark, str(tmp_path), ["X", "Refined_X"]).collect()
    assert {(r["rank"], r["model"], r["output"]) for r in got} == {(1, "X", "inference_1"), (2, "Refined_X", "inference_2")}


def test_empty_set_and_broken_input_raise(spark, tmp_path):
    from dialframe.plans.ensemble import ensemble
    sub = spark.createDataFrame([("q0", "")], "id string, output string")
    _write_array(tmp_path / "a.json", [{"id": "q0", "output": "inference_1"}])
    _write_array(tmp_path / "empty.json", [])
    with pytest.raises(ValueError, match="empty: no rows"):
        ensemble(spark, sub, base_dir=str(tmp_path), names=["a", "empty"])
    (tmp_path / "cut.json").write_text('[{"id": "q0", "output": "inf')
    with pytest.raises(Exception):
        read_prediction_sets(spark, str(tmp_path), ["a", "cut"]).collect()
    (tmp_path / "ex").mkdir()
    (tmp_path / "ex" / "train.json").write_text('[{"id": "x", "input": {"conversation": [{"speaker": "one"}]}}]')
    with pytest.raises(Exception):
        read_examples(spark, str(tmp_path / "ex")).collect()


def test_interrupted_write_is_done_again(spark, tmp_path):
    left = tmp_path / "p"
    left.mkdir()
    (left / "part-00000.json").write_text('{"id": "old", "output": "inference_1"}\n')
    write_if_absent(spark.createDataFrame([("new", "inference_2")], "id string, output string"), str(left))
    assert [r["id"] for r in spark.read.json(str(left)).collect()] == ["new"]


def test_null_utterance_counts_as_its_printed_form(spark):
    from dialframe.operators.turns import example_lengths
    df = spark.createDataFrame([("x", "train", [("a", 1), (None, 2)])],
                               "id string, split string, conversation array<struct<utterance:string,speaker:int>>")
    assert example_lengths(df).first()["total_utterance_length"] == 5


def test_cli_folds_train_rows_that_fit(spark, tmp_path):
    """One over-long train row and one dev row get no fold; variants are folded on their own."""
    from dialframe.cli import main

    def example(i, text):
        turn = {"speaker": 1, "utterance": text, "utterance_id": f"{i}.1"}
        return {"id": i, "input": {"conversation": [turn], "reference_id": [f"{i}.1"], "category": "원인",
                                   "inference_1": "가", "inference_2": "나", "inference_3": "다"},
                "output": "inference_1"}

    src = tmp_path / "src"
    src.mkdir()
    _write_array(src / "train.json", [example(f"t-{i:03d}", "긴" * (5000 if i == 2 else 10)) for i in range(5)])
    _write_array(src / "dev.json", [example("d-000", "짧은 글")])
    out = str(tmp_path / "out")
    main(["ingest", str(src), out + "/ex"], spark=spark)
    main(["prompts", out + "/ex", out + "/p", "--ingested", "--variant", "v1", "v2", "--mode", "train",
          "--max-source-len", "2000", "--k-folds", "2"], spark=spark)
    rows = spark.read.parquet(out + "/p").collect()
    want = {"t-000": 1, "t-001": 1, "t-003": 2, "t-004": 2, "d-000": None}
    for v in ("v1", "v2"):
        assert {r["id"]: r["fold"] for r in rows if r["variant"] == v} == want
    assert len(glob.glob(out + "/p/split=train/variant=v1/fold=2/*.parquet")) >= 1
    main(["eda", out + "/ex", out + "/eda", "--ingested"], spark=spark)
    sizes = {r["split"]: int(r["n"]) for r in spark.read.option("header", True).csv(out + "/eda/split_sizes").collect()}
    assert sizes == {"train": 5, "dev": 1, "train+dev": 6}
    main(["refine", out + "/ex", out + "/refined", "--ingested"], spark=spark)
    assert read_examples(spark, out + "/refined/split=dev", multi_line=False).count() == 1


def test_materialized_folders_are_released(spark):
    from dialframe.session import materialize, release_materialized
    df = materialize(spark.range(10), "release-test")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    release_materialized(df)
    assert not os.path.exists(folder)


def test_folds_go_by_place_in_the_file(spark, tmp_path):
    """Ids without a number, in no order: the folds are those of the file, from arrays, Parquet and refined output."""
    from dialframe.cli import main
    names = ["pear", "apple", "fig", "kiwi", "date", "lime", "plum"]
    src, out = tmp_path / "src", str(tmp_path)
    src.mkdir()
    rows = [_example(0, [(1, "오늘 비 와", f"{n}.1")], [f"{n}.1"]) | {"id": n} for n in names]
    _write_array(src / "train.json", rows)
    _write_array(src / "dev.json", rows[:2])
    want = dict(zip(names, [1, 1, 1, 2, 2, 3, 3]))
    main(["ingest", str(src), out + "/ex"], spark=spark)
    main(["refine", out + "/ex", out + "/refined", "--ingested"], spark=spark)
    for place, flags in ((str(src), []), (out + "/ex", ["--ingested"]), (out + "/refined", ["--json-lines"])):
        main(["prompts", place, out + "/p", *flags, "--variant", "v1", "v2", "--k-folds", "3"], spark=spark)
        got = spark.read.parquet(out + "/p").where("split = 'train'").collect()
        assert {(r["id"], r["variant"]): r["fold"] for r in got} == {
            (n, v): f for n, f in want.items() for v in ("v1", "v2")}


def test_positions_of_examples(spark, src_dir):
    got = {(r["split"], r["id"]): r["position"] for r in read_examples(spark, src_dir).collect()}
    assert got == {("train", "t-train-000001"): 0, ("dev", "t-train-000002"): 0}
    odd = os.path.join(src_dir, "a +b%41.json")
    _write_array(odd, EXAMPLES)
    got = {(r["split"], r["id"]): r["position"] for r in read_examples(spark, odd).collect()}
    assert got == {("a +b%41", "t-train-000001"): 0, ("a +b%41", "t-train-000002"): 1}


def test_cli_from_files_to_submission(spark, tmp_path):
    """prompts -> score (one model, a model per fold) -> vote; prompts -> pad; the recipe's sets by name."""
    from dialframe.cli import main
    from dialframe.sources.jsonio import recipe_names
    src, out = tmp_path / "src", str(tmp_path)
    src.mkdir()
    rows = [_example(0, [(1, "비" * (i + 1), "u")], ["u"], "") | {"id": f"n{9 - i}"} for i in range(7)]
    _write_array(src / "test.json", rows)
    _write_array(src / "train.json", rows[:2])
    _write_array(tmp_path / "submission.json", [{"id": r["id"], "output": ""} for r in rows])
    main(["prompts", str(src), out + "/enc", "--variant", "v1", "v2"], spark=spark)
    enc = spark.read.parquet(out + "/enc").where("split = 'test' and variant = 'v2'")
    size = {r["id"]: r["n_source"] for r in enc.collect()}
    chosen = ["--split", "test", "--variant", "v2"]
    main(["score", out + "/enc", out + "/one.json", "--scorer", "tests.scorers:by_length", *chosen], spark=spark)
    got = {r["id"]: r["output"] for r in spark.read.json(out + "/one.json").collect()}
    assert got == {i: f"inference_{n % 3 + 1}" for i, n in size.items()}
    main(["score", out + "/enc", out + "/m.json", "--scorer", "tests.scorers:by_fold", "--k-folds", "3", *chosen], spark=spark)
    main(["vote", "--submission", out + "/submission.json", "--output", out + "/final", "--k-folds", "3",
          "--fold-output", out + "/m.json"], spark=spark)
    got = {r["id"]: r["output"] for r in spark.read.json(out + "/final").collect()}
    assert got == {i: f"inference_{(n + 1) % 3 + 1}" for i, n in size.items()}  # three labels: fold 1 wins
    main(["pad", out + "/enc", out + "/padded", "--batch-size", "3", *chosen], spark=spark)
    got = sorted((r["idx"], r["id"], r["batch"], len(r["input_ids"])) for r in spark.read.parquet(out + "/padded").collect())
    assert [(i, d, b) for i, d, b, _ in got] == [(k, f"n{9 - k}", k // 3) for k in range(7)]
    assert all(n == max(m for _, _, c, m in got if c == b) for _, _, b, n in got)
    for name in recipe_names():
        _write_array(tmp_path / f"{name}.json", [{"id": r["id"], "output": "inference_2"} for r in rows])
    main(["vote", "--submission", out + "/submission.json", "--output", out + "/recipe", "--predictions-dir", out,
          "--recipe"], spark=spark)
    assert {r["output"] for r in spark.read.json(out + "/recipe").collect()} == {"inference_2"}
