"""Fold scoring in one pass, and prediction sets that are published whole."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dialframe.operators import score as score_module
from dialframe.plans.ensemble import ensemble, predict_folds
from dialframe.sources import commit
from dialframe.sources.jsonio import fold_prediction_paths, read_fold_predictions, unfinished_folds, write_if_absent

ROWS = 100
FOLDS = 5


def rows(spark, n=ROWS):
    return spark.range(n).select(F.concat(F.lit("q"), F.col("id")).alias("id"), F.col("id").alias("x")).repartition(7)


def counting(folder):
    """A factory whose scorers note every build and every row they see in files of their own."""
    def factory(fold):
        import uuid
        import numpy as np
        Path(folder, f"built-{fold}-{uuid.uuid4().hex}").touch()

        def score(pdf):
            with open(os.path.join(folder, f"rows-{fold}-{uuid.uuid4().hex}"), "w") as f:
                f.write("\n".join(pdf["id"]))
            return np.stack([(pdf["x"] + fold + i) % 3 == 0 for i in range(3)], axis=1).astype(float)
        return score
    return factory


def seen(folder):
    out = {}
    for p in Path(folder).glob("rows-*"):
        out.setdefault(int(p.name.split("-")[1]), []).extend(p.read_text().split("\n"))
    return {k: sorted(v) for k, v in out.items()}


def label(x, fold):
    return f"inference_{next(i for i in range(3) if (x + fold + i) % 3 == 0) + 1}"


def test_each_row_is_scored_once_per_unfinished_fold(spark, tmp_path):
    notes, output = tmp_path / "notes", str(tmp_path / "sets" / "model.json")
    notes.mkdir()
    done = spark.createDataFrame([(f"q{i}", "inference_3") for i in range(ROWS)], "id string, output string")
    paths = fold_prediction_paths(output, FOLDS)
    assert write_if_absent(done, paths[1])                       # fold 2 is finished
    os.makedirs(paths[3])                                        # fold 4 was interrupted: no marker
    Path(paths[3], "part-0.json").write_text('{"id": "q0", "output": "old"}\n')
    assert unfinished_folds(spark, output, FOLDS) == [1, 3, 4, 5]
    assert predict_folds(rows(spark), counting(str(notes)), output, FOLDS, batch_rows=8) == paths
    ids = sorted(f"q{i}" for i in range(ROWS))
    assert seen(notes) == {f: ids for f in (1, 3, 4, 5)}          # rows x unfinished folds, each once
    got = {(r["id"], r["rank"]): r["output"] for r in read_fold_predictions(spark, output, FOLDS).collect()}
    assert got == {(f"q{x}", f): "inference_3" if f == 2 else label(x, f) for x in range(ROWS) for f in range(1, 6)}
    # everything is finished: nothing is scored
    predict_folds(rows(spark), counting(str(notes)), output, FOLDS)
    assert seen(notes) == {f: ids for f in (1, 3, 4, 5)}
    # a fold that is taken away is scored alone
    Path(paths[0], "_SUCCESS").unlink()
    predict_folds(rows(spark), counting(str(notes)), output, FOLDS)
    assert seen(notes) == {f: sorted(ids * (2 if f == 1 else 1)) for f in (1, 3, 4, 5)}
    sub = spark.createDataFrame([(i, "") for i in ids], "id string, output string")
    assert ensemble(spark, sub, k_folds=FOLDS, output=output).count() == ROWS


def test_a_task_holds_rows_of_one_fold(spark):
    def factory(fold):
        import numpy as np

        def score(pdf):
            assert set(pdf["fold"]) == {fold}
            return np.zeros((len(pdf), 3))
        return score
    out = score_module.score_folds(rows(spark), factory, [2, 5], ["id"], partitions=7)
    found = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("fold").alias("n"), F.min("fold"))
    assert {r["n"] for r in found.collect()} == {1}
    assert out.count() == 2 * ROWS and out.rdd.getNumPartitions() == 8
    with pytest.raises(ValueError):
        score_module.score_folds(rows(spark), factory, [], ["id"])


def test_a_worker_holds_one_fold_model(monkeypatch):
    monkeypatch.setattr(score_module, "_SCORERS", {})
    for f in (1, 1, 2, 3):
        score_module.worker_scorer(f"m/{f}", lambda: object(), most=1)
        assert list(score_module._SCORERS) == [f"m/{f}"]


def test_no_rows_give_empty_complete_sets(spark, tmp_path):
    output = str(tmp_path / "m.json")
    predict_folds(rows(spark).where("x < 0"), counting(str(tmp_path)), output, 2)
    assert unfinished_folds(spark, output, 2) == [] and read_fold_predictions(spark, output, 2).count() == 0


def names(folder):
    return sorted(p.name for p in Path(folder).iterdir())


def test_a_failing_writer_leaves_nothing(spark, tmp_path):
    bad = spark.range(50).select(F.when(F.col("id") < 40, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id"))
    with pytest.raises(Exception, match="stop"):
        write_if_absent(bad.repartition(5), str(tmp_path / "p"))
    assert names(tmp_path) == []
    parts = bad.withColumn("fold", F.lit(1))
    with pytest.raises(Exception, match="stop"):
        commit.write_parts_if_absent(parts, "fold", {1: str(tmp_path / "a"), 2: str(tmp_path / "b")})
    assert names(tmp_path) == []
    assert write_if_absent(spark.range(3), str(tmp_path / "p"))
    assert names(tmp_path) == ["p"] and spark.read.json(str(tmp_path / "p")).count() == 3


def staged(spark, tmp_path, n):
    """A second writer that has finished its staging folder and is about to publish."""
    path = commit.staging_path(str(tmp_path / "p"))
    spark.range(n).write.json(path)
    return path


def test_of_two_writers_one_whole_set_stays(spark, tmp_path):
    target = str(tmp_path / "p")
    a, b = staged(spark, tmp_path, 3), staged(spark, tmp_path, 5)
    assert commit.publish(spark, a, target) and not commit.publish(spark, b, target)
    assert spark.read.json(target).count() == 3 and names(tmp_path) == ["p"]


def test_a_writer_that_died_before_its_marker_is_set_aside(spark, tmp_path):
    target = tmp_path / "p"
    os.rename(staged(spark, tmp_path, 3), target)
    (target / "_SUCCESS").unlink()
    assert not commit.is_complete(spark, str(target))
    assert commit.publish(spark, staged(spark, tmp_path, 5), str(target))
    assert spark.read.json(str(target)).count() == 5 and names(tmp_path) == ["p"]


def test_a_marker_never_makes_the_folder(spark, tmp_path):
    fs, hp = commit.file_system(spark, str(tmp_path / "gone"))
    assert not commit._mark(fs, hp) and names(tmp_path) == []


def test_the_second_writer_between_rename_and_marker(spark, tmp_path, monkeypatch):
    """The first writer has moved its set in; before it marks it, a second one publishes."""
    target, second, real = str(tmp_path / "p"), staged(spark, tmp_path, 5), commit._mark

    def mark(fs, hp):
        monkeypatch.setattr(commit, "_mark", real)
        assert commit.publish(spark, second, target)
        return real(fs, hp)

    monkeypatch.setattr(commit, "_mark", mark)
    commit.publish(spark, staged(spark, tmp_path, 3), target)
    assert commit.is_complete(spark, target)
    assert spark.read.json(target).count() == 5 and names(tmp_path) == ["p"]


def test_a_complete_target_is_not_computed(spark, tmp_path):
    target = tmp_path / "set.json"
    target.write_text(json.dumps([{"id": 1}]))
    boom = spark.range(1).select(F.raise_error(F.lit("computed")).cast("long").alias("id"))
    assert not write_if_absent(boom, str(target))
    assert commit.write_parts_if_absent(boom.withColumn("fold", F.lit(1)), "fold", {1: str(target)}) == []


def test_a_checked_vote_reads_every_set_once(spark, tmp_path, monkeypatch):
    from dialframe.plans import ensemble as plan
    votes = {"a": [1, 2, 3], "b": [3, 2, 2], "c": [3, 1, 1]}
    for name, labels in votes.items():
        Path(tmp_path, f"{name}.json").write_text(json.dumps([{"id": f"q{i}", "output": f"inference_{x}"}
                                                              for i, x in enumerate(labels)]))
    sub = spark.createDataFrame([(f"q{i}", "") for i in range(3)], "id string, output string")
    seen, real = [], plan.materialize
    monkeypatch.setattr(plan, "materialize", lambda d, n: seen.append(d) or real(d, n))
    out = ensemble(spark, sub, base_dir=str(tmp_path), names=["a", "b", "c"])
    assert {r["id"]: r["output"] for r in out.collect()} == {"q0": "inference_3", "q1": "inference_2", "q2": "inference_3"}
    assert len(seen) == 1 and seen[0]._jdf.queryExecution().executedPlan().toString().count("FileScan json") == 3
    assert "FileScan json" not in out._jdf.queryExecution().executedPlan().toString()
    Path(tmp_path, "d.json").write_text(json.dumps([{"id": f"q{i}", "output": "inference_1"} for i in (0, 0, 1, 7)]))
    with pytest.raises(ValueError, match="d: 1 missing, 1 extra, 1 duplicated ids"):
        ensemble(spark, sub, base_dir=str(tmp_path), names=["a", "d"])
