"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from tessera.plans.catalogue import QUERIES
from tessera.plans.oracles import ORACLES

DIRECTORY = "/root/testdata/sf0.001"
# Joins of every row with every row, and rows handed to Python.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"]
WITHOUT_SQL = {
    "q46_complexity_table",
    "q46_tree_nodes",
    "q46_left_out_error",
    "q46_tree_predictions",
    "q46_forest_predictions",
    "q46_logistic_predictions",
    "q46_model_accuracy",
    "q46_logistic_coefficients",
    "q46_prior_logistic_coefficients",
    "q46_importances",
    "q46_tree_sizes",
    "q46_resampled_accuracy",
    "q48_model_gain_lift",
    "q49_model_auc",
}


@pytest.fixture(scope="module")
def connection():
    return connect(DIRECTORY)


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_every_query_but_the_models_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, connection, name):
    found = QUERIES[name](spark, DIRECTORY)
    assert differences(found, connection, ORACLES[name]) == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    for word in UNWANTED:
        assert word not in plan


def test_model_accuracy(spark):
    found = QUERIES["q46_model_accuracy"](spark, DIRECTORY).collect()
    assert {r["MODELS"] for r in found} == {"tree", "forest", "logistic"}
    larger = _larger_class(spark)
    assert all(larger + 0.1 < r["ACCURACY"] <= 1 for r in found)


def _larger_class(spark):
    """Share of the larger class, which a guess without a model reaches."""
    churned = QUERIES["q44_churn_labels"](spark, DIRECTORY).agg({"CHURN": "avg"}).first()[0]
    return max(churned, 1 - churned)


def test_terms_without_the_window_are_usable(spark):
    found = QUERIES["q46_prior_logistic_coefficients"](spark, "/root/testdata/sf0.01").collect()
    assert all(0 < r["std_error"] < 100 for r in found)


def test_tree_reports(spark):
    weights = QUERIES["q46_importances"](spark, DIRECTORY).groupBy("MODEL").sum("IMPORTANCE").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in weights) and len(weights) == 2
    sizes = QUERIES["q46_tree_sizes"](spark, DIRECTORY).orderBy("MAX_DEPTH").collect()
    assert all(a["LEAVES"] <= b["LEAVES"] and a["TRAIN_ERROR"] >= b["TRAIN_ERROR"] for a, b in zip(sizes, sizes[1:]))
    assert sizes[-1]["TRAIN_ERROR"] < 0.02 and sizes[-1]["TEST_ERROR"] < 1 - _larger_class(spark) - 0.1


def test_pruned_tree_and_left_out_rows(spark):
    table = QUERIES["q46_complexity_table"](spark, DIRECTORY).collect()
    cps, splits = [r["CP"] for r in table], [r["NSPLIT"] for r in table]
    assert cps == sorted(cps, reverse=True) and splits == sorted(splits) and splits[0] == 0
    assert table[0]["REL_ERROR"] == 1 and cps[-1] == 0.01 and all(r["XERROR"] < 1.2 for r in table)
    nodes = {r["NODE"]: r for r in QUERIES["q46_tree_nodes"](spark, DIRECTORY).collect()}
    for r in nodes.values():
        if r["LEFT_CHILD"] >= 0:
            children = [nodes[r["LEFT_CHILD"]], nodes[r["RIGHT_CHILD"]]]
            assert [sum(c[n] for c in children) for n in ("N_0", "N_1")] == [r["N_0"], r["N_1"]]
    rows = {r["CHURN"]: r for r in QUERIES["q46_left_out_error"](spark, DIRECTORY).collect()}
    assert rows[None]["N_ROWS"] == rows[0]["N_ROWS"] + rows[1]["N_ROWS"] and rows[None]["ERROR"] < 0.3


def test_resamples(spark):
    found = QUERIES["q46_resampled_accuracy"](spark, DIRECTORY).collect()
    assert len(found) == 5 and len({r["LEFT_OUT"] for r in found}) > 1
    assert all(r["ACCURACY"] > _larger_class(spark) + 0.1 for r in found)


def test_model_gain_and_auc(spark):
    gain = QUERIES["q48_model_gain_lift"](spark, DIRECTORY).collect()
    assert len(gain) == 30
    assert all(abs(r["GAIN"] - 100) < 1e-9 for r in gain if r["POPULATION"] == 100)
    area = QUERIES["q49_model_auc"](spark, DIRECTORY).collect()
    assert all(0.75 < r["AUC"] <= 1 for r in area) and len(area) == 2


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["Segment", "Count"] and found.count() > 0
