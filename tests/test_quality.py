"""Presence of keys over several tables, and dominance of levels."""

from helpers import rows

from tessera.operators import quality


def test_presence_holds_every_pair(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"),
        "b": spark.createDataFrame([(2,), (3,)], "k long"),
        "c": spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (None,)], "k int"),
    }
    found = quality.key_presence([("k", name, df) for name, df in tables.items()])
    held = {r["TABLES"]: r["TOT_KEYS"] for r in found.collect()}
    assert held == {"a,c": 2, "a,b,c": 1, "b,c": 1, "c": 1}
    for left, right in (("a", "b"), ("a", "c"), ("b", "c")):
        overlap = quality.key_overlap(tables[left].selectExpr("cast(k as long) k"), tables[right].selectExpr("cast(k as long) k"), "k", ("L", "R"))
        for r in overlap.collect():
            names = [(left in t.split(","), right in t.split(","), n) for t, n in held.items()]
            assert r["TOT_KEYS"] == sum(n for x, y, n in names if (x, y) == (bool(r["L"]), bool(r["R"])))


def test_keys_of_several_kinds(spark):
    events = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "cli long, camp string")
    camps = spark.createDataFrame([("y",), ("z",)], "camp string")
    found = quality.key_presence([("cli", "events", events), ("camp", "events", events), ("camp", "camps", camps)])
    assert rows(found) == [("camp", "camps", 1), ("camp", "events", 1), ("camp", "events,camps", 1), ("cli", "events", 2)]
    assert quality.key_presence([("camp", "camps", camps.where("false"))]).collect() == []


def test_presence_shuffles_keys_once(spark):
    one = spark.range(50).selectExpr("id as k")
    plan = quality.key_presence([("k", str(i), one) for i in range(5)])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(") == 2 and "partial_bit_or" in plan


def test_dominance(spark):
    data = [("a", 1, None), ("a", 2, None), ("b", 3, None), (None, 4, None), (None, 5, None)]
    df = spark.createDataFrame(data, "x string, y int, z string")
    assert rows(quality.level_dominance(df)) == [
        ("x", 3, "a", 2, 2, 0.4, 1.0), ("y", 5, "1", 1, 1, 0.2, 1.0), ("z", 1, None, 5, None, 1.0, None)
    ]
    assert rows(quality.level_dominance(df.where("false"))) == []


def test_low_variance(spark):
    df = spark.range(1000).selectExpr("id", "if(id = 7, 'x', 'y') as rare", "id % 2 as even", "1 as same")
    assert quality.low_variance_columns(df) == ["rare", "same"]
