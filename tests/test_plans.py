"""What the planner makes of the queries: native nodes, pruned scans, few shuffles."""

import re

import pytest

from palaver.plans import registry
from palaver.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_native(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|MapInArrow|ArrowEval|CartesianProduct|ExistingRDD", text)


@pytest.mark.parametrize("name, exchanges", [
    ("label_turns", 1), ("turn_spans", 1), ("context_matrix", 1), ("since_last_turn", 1), ("mix_offsets", 1), ("turn_schedule", 1), ("detect_duplicate_docs", 1),
    ("quality_by_scenario", 1), ("suppress_state", 1), ("split_assign", 0), ("speaking_rate", 0), ("topk_checkpoints", 1),
])
def test_shuffles(spark, name, exchanges):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", text)) == exchanges


@pytest.mark.parametrize("name, columns", [
    ("label_balance", {"conv_id", "turn", "role", "text"}), ("stable_order", {"o_orderkey"}), ("topk_checkpoints", {"o_custkey", "o_orderkey", "o_totalprice"}),
    ("speaker_frequency", {"conv_id", "role"}), ("usage_concentration", {"l_suppkey", "l_orderkey"}), ("split_assign", {"doc_id", "source", "lang"}),
])
def test_scans_are_pruned(spark, name, columns):
    text = plan(registry.queries()[name](spark, FOLDER))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "c", True, 1), ("b", "d", False, 2)], "id string, category string, has_va boolean, n int").write.parquet(str(tmp_path / "t"))
    rows = tables.wanted_rows(spark.read.parquet(str(tmp_path / "t")), category="c", ids=["a"], has_va=True)
    text = plan(rows.select("n"))
    pushed = text.split("PushedFilters:")[1]
    assert "EqualTo(category,c)" in pushed and "EqualTo(id,a)" in pushed and "Equal" in pushed.split("EqualTo(id,a)")[1] and rows.count() == 1


def test_group_limit_cuts_before_the_shuffle(spark):
    text = plan(registry.queries()["topk_checkpoints"](spark, FOLDER))
    assert text.count("WindowGroupLimit") == 2


def test_errors_scan_and_shuffle_once(spark):
    query = registry.queries()["error_summary"](spark, FOLDER)
    query.collect()
    final = plan(query).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


@pytest.mark.parametrize("name", ["ensemble_sweep", "release_collect", "mix_offsets"])
def test_each_table_is_scanned_once(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    scans = re.findall(r"FileScan parquet", text)
    assert len(scans) == (4 if name == "release_collect" else 1)
