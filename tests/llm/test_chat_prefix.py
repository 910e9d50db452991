"""Prefix-target expansion: round trip, spans, edge cases, oracle."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dialframe.llm import chat_prefix as cp
from tests.conftest import SF_CHECK
from tests.parity import compare, duck

SCHEMA = "conv_id long, turn long, role string, text string, piece string"
ROWS = [
    (1, 0, "system", "be <|im_start|> nice \\", "x"),
    (1, 1, "user", "a\\<|b\\\\|<", "x"),
    (1, 2, "assistant", "<|im_end|>\n<|im_start|>assistant ok<", "x"),
    (1, 3, "user", None, "x"),
    (1, 4, "assistant", "", "x"),
    (1, 4, "assistant", "", "x"),
    (2, 0, "user", "only a question", None),
    (3, None, None, "\\", None),
    (3, 7, "assi\nstant\\", "x" * 200_000, None),
    (None, 0, "assistant", "no id é😀", None),
]


@pytest.fixture(scope="module")
def examples(spark):
    return cp.prefix_targets(cp.format_turns(spark.createDataFrame(ROWS, SCHEMA)))


def test_round_trip(examples):
    got = {r.conv_id: r for r in cp.read_back(examples).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        rows = sorted((x for x in ROWS if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1]))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in rows)
        loss = "".join(x[3] or "" for x in rows if x[2] == "assistant")
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_expanded_examples_hold_every_turn_before(examples):
    rows = cp.expand_examples(examples).where("conv_id = 1").orderBy("context_turns").collect()
    stream = "".join(r.piece for r in examples.where("conv_id = 1").orderBy("ordinal").collect())
    assert [r.context_turns for r in rows] == [2, 4, 5]
    spans = examples.where("conv_id = 1 and target_start is not null").orderBy("ordinal").collect()
    for r, s in zip(rows, spans):
        assert r.context == stream[:s.context_chars]
        assert r.target == stream[s.target_start:s.target_start + s.target_chars]
        assert r.context.endswith("<|im_start|>assistant\n")
        assert "<|" not in r.target


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cp.read_back(cp.prefix_targets(cp.format_turns(empty))).count() == 0


def test_query_matches_oracle(spark):
    res = compare(spark, duck(SF_CHECK), "op4_chat_prefix", SF_CHECK)
    assert res.get("match"), res
    assert "type_mismatch" not in res, res
    assert entry.queries()["op4_chat_prefix"](spark, SF_CHECK).where("conv_id = -1 and n_turns = 2").count() == 1


def test_read_back_reads_the_written_out_examples(examples):
    """Sizes and trainable text come from the examples, not from the offsets kept beside them."""
    want = cp.read_back(examples).collect()
    got = cp.read_back(examples.withColumn("context_chars", F.lit(-1).cast("long"))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    sizes = cp.expand_examples(examples).groupBy("conv_id").agg(F.sum(F.length("context") + F.length("target")).alias("n"))
    assert {r.conv_id: r.n for r in sizes.collect()} == {r.conv_id: r.expanded_chars for r in want if r.n_examples}
