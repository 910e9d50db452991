"""Byte-range reading of JSON arrays and JSON Lines against the standard parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dialframe.sources.json_array import parse_records, read_array_records, read_line_records

SCHEMA = "id string, text string, tags array<string>, deep struct<a: array<struct<b: string>>>, n long"


@pytest.fixture()
def ranges(spark):
    """Cut files into ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)
        spark.conf.set(names[2], 1)
    yield cut
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


PIECES = ["}", "{", "[", "]", '"', "\\", "\\\\", "\n", ",", ":", "가나다", "😀", "é", "a b", "},\n  {", '\\"}', " ", "/", "\t", "}]"]


def random_record(r, i):
    def text():
        return "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))
    return {"id": f"q{i}", "text": text(), "tags": [text() for _ in range(r.randint(0, 3))],
            "deep": {"a": [{"b": text()} for _ in range(r.randint(0, 3))]}, "n": r.randint(0, 9)}


def plain(rows):
    return [json.loads(r) for r in rows]


def read(spark, path):
    df = parse_records(read_array_records(spark, str(path)), SCHEMA)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    out = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["position"])):
        out.setdefault(r.pop("file").rsplit("/", 1)[1], []).append(r)
    for name, rows in out.items():
        assert [r.pop("position") for r in rows] == list(range(len(rows))), name
    return out


@pytest.mark.parametrize("size", [7, 90, 1 << 20])
def test_arrays_equal_the_standard_parser(spark, tmp_path, ranges, size):
    r = random.Random(size)
    want = {}
    for k in range(5):
        rows = [random_record(r, i) for i in range(1 if size < 10 else r.choice([1, 2, 7]))]
        style = [dict(indent=4, ensure_ascii=False), dict(ensure_ascii=True), dict(separators=(",", ":"), ensure_ascii=False)][k % 3]
        text = json.dumps(rows, **style)
        if k == 4:
            text = "﻿ \n" + text + " \n\n"
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
        want[f"f{k}.json"] = rows
    (tmp_path / "none.json").write_text(" [ \n ] ")
    (tmp_path / "other.txt").write_text("[{]")
    ranges(size)
    assert read(spark, tmp_path) == want


def test_one_file_is_many_tasks_and_equals_the_one_task_reader(spark, tmp_path, ranges):
    r = random.Random(5)
    rows = [random_record(r, i) for i in range(400)]
    path = tmp_path / "train.json"
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=4), encoding="utf-8")
    one_task = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(str(path))
    assert one_task.rdd.getNumPartitions() == 1
    ranges(4096)
    found = read_array_records(spark, str(path))
    assert found.where("position < 400").select(F.spark_partition_id()).distinct().count() > 8
    got = parse_records(found, SCHEMA).drop("file", "position")
    assert sorted(map(str, got.collect())) == sorted(map(str, one_task.collect()))


def test_a_record_longer_than_many_ranges(spark, tmp_path, ranges):
    rows = [{"id": "a", "text": "}" * 300 + '"\\' * 50, "tags": [], "deep": {"a": []}, "n": 1},
            {"id": "b", "text": "x" * 5000, "tags": ["{["] * 40, "deep": {"a": [{"b": "}"}] * 30}, "n": 2},
            {"id": "c", "text": "", "tags": [], "deep": {"a": []}, "n": 3}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    ranges(300)
    assert read(spark, tmp_path) == {"f.json": rows}


@pytest.mark.parametrize("text", ['[{"id": "a"}', '[{"id": "a', '[{"id": "a"}, {"id": ', '{"id": "a"}', '[{"id": "a"} {"id": "b"}]',
                                  '[{"id": "a"},]', '[1, {"id": "a"}]', '[{"id": "a"}] x', '[{"n": "one"}]'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception):
        parse_records(read_array_records(spark, str(tmp_path)), SCHEMA).collect()


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_lines_keep_their_place(spark, tmp_path, ranges, size):
    r = random.Random(2)
    for folder in ("split=a", "split=b"):
        (tmp_path / folder).mkdir()
    want = {}
    for k, name in enumerate(("split=a/part-1.json", "split=a/part-2.json", "split=b/part-1.json")):
        rows = [random_record(r, f"{k}-{i}") for i in range(9)]
        (tmp_path / name).write_text("\n".join(json.dumps(x) + ("\r\n \n" if i % 4 == 0 else "")
                                               for i, x in enumerate(rows)) + "\n" * (k % 2))
        want.setdefault(name[:7], []).extend(rows)
    ranges(size)
    df = parse_records(read_line_records(spark, str(tmp_path)), SCHEMA)
    got = {}
    for x in sorted((x.asDict(recursive=True) for x in df.collect()), key=lambda x: (x["file"], x["position"])):
        folder = x.pop("file").split("/")[-2].replace("%3D", "=")
        assert x.pop("position") == len(got.setdefault(folder, []))
        got[folder].append(x)
    assert got == want


def test_conditions_stay_above_the_parser(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"id": "a", "tags": ["x"]}, {"id": "b", "tags": []}]))
    df = parse_records(read_array_records(spark, str(tmp_path)), SCHEMA).select("id", F.explode("tags")).where("id > ''")
    assert [tuple(r) for r in df.collect()] == [("a", "x")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_array_sink_writes_arrays(spark, tmp_path):
    from dialframe.sources.jsonio import read_examples, write_examples_array
    turn = "conversation array<struct<speaker:int,utterance:string,utterance_id:array<string>>>"
    rows = [(f"q{i}", "train" if i % 3 else "dev", [(1, "}]\n\"", ["u"]), (2, None, ["v", "w"])], ["u"], "원인", "a", "b",
             None, "") for i in range(40)]
    df = spark.createDataFrame(rows, f"id string, split string, {turn}, reference_id array<string>, category string, "
                                     "inference_1 string, inference_2 string, inference_3 string, output string")
    write_examples_array(df.repartition(3), str(tmp_path / "x"))
    files = list((tmp_path / "x").glob("split=*/*.txt"))
    found = [json.loads(f.read_text()) for f in files]
    assert len(files) == 6 and sum(map(len, found)) == 40
    assert found[0][0]["input"]["conversation"][1]["utterance_id"] == ["v", "w"]
    back = read_examples(spark, str(tmp_path / "x"), glob="*.txt")
    assert sorted(map(str, back.drop("position").collect())) == sorted(map(str, df.select(back.drop("position").columns).collect()))
