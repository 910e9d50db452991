"""Driver contract: entry smoke, every query against its DuckDB oracle at sf0.01, plan properties."""

import pytest

import __spark_entry__ as entry
from dialframe.plans.registry import all_queries
from tests.parity import compare, duck
from tests.plan_audit import audit

SF = "/root/testdata/sf0.01"
NAMES = sorted(all_queries())
# Global aggregates end in one partition by definition (a handful of rows).
GLOBAL_AGG = {"role_distribution", "validate_predictions"}
# Queries on the row index: its offsets, one row per range, are summed in one partition.
INDEXED = {"padded_batches", "padded_arrays", "kfold_assignments", "kfold_roles", "event_index"}
# Python runs in the scorer plug-in (mapInPandas) and where byte ranges of a JSON array are put together.
PYTHON_BOUNDARY = {"batch_scores", "variant_vote", "example_files"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "start_turn", "speaker", "text", "utterance_ids", "n_turns"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    missing = set(NAMES) - set(entry.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF)
    assert res.get("match"), res
    assert "type_mismatch" not in res, res


@pytest.mark.parametrize("name", [n for n in NAMES if n not in PYTHON_BOUNDARY])
def test_native_plan(spark, name):
    a = audit(entry.queries()[name](spark, SF))
    assert a["python"] == 0, a
    if name not in GLOBAL_AGG:
        if name in INDEXED:  # the running offsets: one row per range of the index
            assert a["single_partition"] <= 2, a
        else:
            assert a["single_partition"] == 0, a
