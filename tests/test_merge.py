import pytest
from pyspark.sql import functions as F

from dialframe.operators.turns import clean_and_drop_empty, merge_examples, merge_turns, refine_examples

# (rows as (speaker, text, id), refs, expected [(speaker, text, [ids])]) derived by hand
MERGE_CASES = [
    ([(1, "a", "u1"), (1, "b", "u2"), (2, "c", "u3")], [], [(1, "a b", ["u1", "u2"]), (2, "c", ["u3"])]),
    ([(1, "a", "u1"), (1, "b", "u2"), (1, "c", "u3")], ["u2"],
     [(1, "a", ["u1"]), (1, "b", ["u2"]), (1, "c", ["u3"])]),
    ([(1, "a", "u1"), (1, "b", "u2"), (1, "c", "u3")], ["u1"], [(1, "a", ["u1"]), (1, "b c", ["u2", "u3"])]),
    ([(1, "a", "u1"), (2, "", "u2"), (1, "c", "u3")], [], [(1, "a c", ["u1", "u3"])]),
    ([(1, "a", "u1"), (1, "", "u2"), (1, "c", "u3")], ["u2"], [(1, "a c", ["u1", "u3"])]),
]


def _long(spark, cases):
    rows = []
    for k, (turns, refs, _) in enumerate(cases):
        for pos, (spk, txt, uid) in enumerate(turns):
            rows.append((k, pos, spk, txt, uid, uid in refs))
    return spark.createDataFrame(rows, "k int, pos int, speaker int, text string, utterance_id string, is_ref boolean")


def _expected(cases):
    return {k: exp for k, (_, _, exp) in enumerate(cases)}


@pytest.mark.parametrize("chunk", [None, 1, 2, 1 << 16])
def test_merge_long_matches_fixture(spark, chunk):
    df = _long(spark, MERGE_CASES).where(F.col("text") != "")
    out = merge_turns(df, "k", "pos", chunk=chunk, hot_rows=1).orderBy("k", "pos").collect()
    got = {}
    for r in out:
        got.setdefault(r["k"], []).append((r["speaker"], r["text"], list(r["utterance_ids"])))
    assert got == _expected(MERGE_CASES)


def test_merge_nested_matches_fixture(spark):
    rows = [(k, [{"speaker": s, "utterance": t, "utterance_id": u} for s, t, u in turns], refs)
            for k, (turns, refs, _) in enumerate(MERGE_CASES)]
    df = spark.createDataFrame(
        rows, "k int, conversation array<struct<speaker:int,utterance:string,utterance_id:string>>, refs array<string>")
    conv = F.filter("conversation", lambda u: u["utterance"] != "")
    nested = df.select("k", conv.alias("conversation"), F.col("refs").alias("reference_id"))
    out = merge_examples(nested, ids_are_arrays=False).select("k", F.col("conversation").alias("m")).collect()
    for r in out:
        got = [(u["speaker"], u["utterance"], list(u["utterance_id"])) for u in r["m"]]
        assert got == _expected(MERGE_CASES)[r["k"]]


def test_chunking_does_not_change_result(spark):
    # long same-speaker stretches with scattered references, cut in many ways
    import random
    rnd = random.Random(7)
    rows = []
    for k in range(4):
        for pos in range(300):
            spk = 1 if (pos // rnd.choice([1, 5, 40])) % 2 == 0 else 2
            rows.append((k, pos, spk, f"t{pos}", f"{k}.{pos}", rnd.random() < 0.03))
    df = spark.createDataFrame(rows, "k int, pos int, speaker int, text string, utterance_id string, is_ref boolean")

    def norm(chunk, hot_rows=0):
        return sorted((r["k"], r["pos"], r["speaker"], r["text"], tuple(r["utterance_ids"]), r["n_turns"])
                      for r in merge_turns(df, "k", "pos", chunk=chunk, hot_rows=hot_rows).collect())

    base = norm(None)
    for c in (1, 3, 7, 64, 1000):
        assert norm(c) == base


def test_hot_threshold_does_not_change_result(spark):
    """Keys of 10, 100 and 1000 rows and a null key, cut or not by every threshold."""
    rows = [(k, pos, 1 + pos // 7 % 2, f"t{pos}", f"{k}.{pos}", pos % 31 == 5)
            for k, n in ((1, 10), (2, 100), (3, 1000), (None, 50)) for pos in range(n)]
    df = spark.createDataFrame(rows, "k int, pos int, speaker int, text string, utterance_id string, is_ref boolean")

    def norm(**kw):
        return sorted((str(r["k"]), r["pos"], r["text"], tuple(r["utterance_ids"]), r["is_ref"])
                      for r in merge_turns(df, "k", "pos", **kw).collect())

    base = norm(chunk=None)
    for hot_rows in (0, 20, 100, 999, 1000):
        assert norm(chunk=16, hot_rows=hot_rows) == base
        assert norm(chunk="quantile", hot_rows=hot_rows) == base


def test_normal_keys_take_one_exchange(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("is_ref", F.lit(False))
    out = merge_turns(ev, "user_id", ["ts", "event_id"], speaker="event_type", text="props", uid="event_id",
                      chunk="quantile", chunk_key=F.unix_micros(F.col("ts").cast("timestamp")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "merge-pieces" not in plan


def test_empty_frames(spark):
    schema = "k int, pos long, speaker int, text string, utterance_id string, is_ref boolean"
    empty = spark.createDataFrame([], schema)
    for kw in ({"chunk": "quantile"}, {"chunk": 5}, {"chunk": None}, {"chunk": "quantile", "hot_rows": 0}):
        assert merge_turns(empty, "k", "pos", **kw).count() == 0
    from dialframe.operators.folds import quantile_buckets
    nulls = spark.createDataFrame([(None,), (None,)], "pos long")
    assert [r.b for r in quantile_buckets(nulls, F.col("pos"), "b").collect()] == [-1, -1]


def test_refine_nested_cleans_and_merges(spark):
    conv = [{"speaker": 2, "utterance": "ㅇㅇ 좋아", "utterance_id": "x.1"},
            {"speaker": 1, "utterance": "^^", "utterance_id": "x.2"},
            {"speaker": 2, "utterance": "진짜?????", "utterance_id": "x.3"},
            {"speaker": 2, "utterance": "name1 최고", "utterance_id": "x.4"}]
    df = spark.createDataFrame([(conv, ["x.4"])], "conversation array<struct<speaker:int,utterance:string,"
                               "utterance_id:string>>, reference_id array<string>")
    m = refine_examples(df, ids_are_arrays=False).first()["conversation"]
    assert [(u["speaker"], u["utterance"], list(u["utterance_id"])) for u in m] == [
        (2, "응 좋아 진짜??", ["x.1", "x.3"]), (2, "화자1 최고", ["x.4"])]


def test_clean_and_drop_empty_single_chain(spark):
    df = spark.createDataFrame([(1, "^^"), (2, "좋아")], "k int, text string")
    out = clean_and_drop_empty(df)
    assert [r["k"] for r in out.collect()] == [2]
    # the chain holds 8 regex replacements; a copy pushed into a filter would double them
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 8


def test_quantile_chunks_do_not_change_result(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for k in range(3):
        for pos in range(400 if k == 0 else 40):   # key 0 is the hot one
            rows.append((k, pos * 10 + k, 1 if (pos // rnd.choice([1, 3, 30])) % 2 == 0 else 2, f"t{pos}",
                         f"{k}.{pos}", rnd.random() < 0.05))
    df = spark.createDataFrame(rows, "k int, pos long, speaker int, text string, utterance_id string, is_ref boolean")

    def norm(**kw):
        return sorted((r["k"], r["pos"], r["text"], tuple(r["utterance_ids"]))
                      for r in merge_turns(df, "k", "pos", **kw).collect())

    assert norm(chunk="quantile", hot_rows=50) == norm(chunk=None)
    from dialframe.operators.folds import quantile_buckets
    sizes = quantile_buckets(df, F.col("pos"), "b", buckets=16).groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 520 / 16 + 2


def test_quantile_chunks_bound_a_key_holding_every_row(spark):
    from dialframe.operators.folds import quantile_buckets
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("ts", "event_id")
    n = ev.count()
    b = quantile_buckets(ev, F.unix_micros(F.col("ts").cast("timestamp")), "chunk", buckets=64)
    sizes = [r["count"] for r in b.groupBy("chunk").count().collect()]
    assert len(sizes) >= 32 and sum(sizes) == n
    assert max(sizes) <= 3 * n / 64        # about rows / buckets each, never the whole key


def test_merge_without_reference_column(spark):
    df = spark.createDataFrame([(1, 0, 1, "a", "u0"), (1, 1, 1, "b", "u1"), (1, 2, 2, "c", "u2")],
                               "k int, pos int, speaker int, text string, utterance_id string")
    got = [(r["text"], list(r["utterance_ids"])) for r in merge_turns(df, "k", "pos", is_ref=None).orderBy("pos").collect()]
    assert got == [("a b", ["u0", "u1"]), ("c", ["u2"])]


def test_integral_chunk_needs_integral_order(spark):
    import pytest
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "a", "u")], "k int, ts string, speaker int, text string, utterance_id string")
    with pytest.raises(ValueError, match="quantile"):
        merge_turns(df, "k", "ts", is_ref=None, chunk=10)


@pytest.mark.parametrize("fan_out", [2, 3, 64])
def test_borders_of_many_chunks_meet_in_a_tree(spark, monkeypatch, fan_out):
    """1,500 rows in chunks of one and of seven rows; long runs, reference rows and gaps cross many chunks."""
    import random
    from dialframe.operators import turns
    monkeypatch.setattr(turns, "FAN_OUT", fan_out)
    r, rows = random.Random(fan_out), []
    for key, n in (("a", 1500), ("b", 40), (None, 90)):
        pos = -20
        for _ in range(n):
            pos += r.choice([1, 1, 1, 30])
            rows.append((key, pos, 1 if key == "b" or 200 < pos < 900 else r.choice([1, 2]), f"t{pos}", f"u{pos}",
                         r.random() < 0.02))
    df = spark.createDataFrame(rows, "k string, pos long, speaker int, text string, utterance_id string, is_ref boolean")

    def norm(**kw):
        return sorted(((x["k"] or "", x["pos"], x["speaker"], x["text"], tuple(x["utterance_ids"]), x["n_turns"], x["is_ref"])
                       for x in merge_turns(df, "k", "pos", **kw).collect()))

    base = norm(chunk=None)
    for kw in (dict(chunk=1), dict(chunk=7), dict(chunk="quantile", chunk_rows=40)):
        assert norm(hot_rows=0, **kw) == base
    assert norm(chunk=5, hot_rows=100) == base  # one key is cut, the others are not


def test_long_keys_are_found_without_cleaning(spark):
    """A small input starts no job while its plan is built; a count goes over the rows given for it."""
    from dialframe.sources.tables import noise_utterances
    from tests.conftest import SF_CHECK
    view = noise_utterances(spark, SF_CHECK)
    spark.sparkContext.setJobGroup("planning", "planning")
    merge_turns(clean_and_drop_empty(view, "text"), "conv_id", "turn", counted=view)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext._jsc.clearJobGroup()
    raw = spark.createDataFrame([("k", i, 1, "x", f"u{i}", False) for i in range(30)],
                                "k string, pos long, speaker int, text string, utterance_id string, is_ref boolean")
    out = merge_turns(raw.where("pos < 20"), "k", "pos", chunk=4, hot_rows=25, counted=raw)
    assert out.first()["n_turns"] == 20


def test_event_stream_in_a_thousand_chunks(spark):
    from tests.conftest import SF_CHECK
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet").withColumn("k", F.lit("all"))
    kw = dict(speaker="event_type", text="props", uid="event_id", is_ref=None)
    whole = merge_turns(ev, "k", ["ts", "event_id"], chunk=None, **kw)
    n = ev.count()
    # Cut by position of the id, which the order here is.
    cut = merge_turns(ev, "k", ["event_id"], chunk=max(1, n // 1000), hot_rows=10, **kw)
    want = merge_turns(ev, "k", ["event_id"], chunk=None, **kw)
    assert cut.exceptAll(want).count() == 0 and cut.count() == want.count() > 1000
    assert whole.count() > 1000
