"""Every query of the package with SQL, against that SQL; the others return rows."""

import pytest
from compare import connect, differences

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
WITHOUT_SQL = {"op5_feistel_shards", "op6_attention_quality", "op7_simhash_trie", "op10_best_fit", "op12_field_secrets", "op13_token_alignment"}


@pytest.fixture(scope="module")
def connection():
    return connect(DIRECTORY)


def test_which_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, DIRECTORY), connection, ORACLES[name]) == []


def test_chat_runs_without_python(spark):
    plan = QUERIES["op3_chat_collapse"](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "InArrow", "InPandas", "Cartesian", "NestedLoop"):
        assert word not in plan
