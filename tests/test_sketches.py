"""States of distinct counts and quantiles: errors, merges, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import sketches
from tessera.operators import distribution

NAMES = {"IDS": "id"}


def _counts(states):
    return {tuple(r)[:-1]: r["IDS"] for r in sketches.distinct_estimates(states, ["IDS"]).collect()}


def test_distinct_states_merge_at_any_grain(spark):
    # an id comes on two days and in two groups, so counts of days do not add up
    rows = spark.range(60_000).selectExpr("id % 20000 AS id", "id % 30 AS day", "id div 10000 % 2 AS g")
    daily = sketches.distinct_states(rows, ["day", "g"], NAMES, log_registers=14)
    by_group = sketches.merged_distinct_states(daily, ["g"], ["IDS"])
    everything = sketches.merged_distinct_states(by_group, [], ["IDS"])
    for (g,), n in _counts(by_group).items():
        assert n == pytest.approx(rows.where(f"g = {g}").select("id").distinct().count(), rel=0.04)
    assert _counts(everything)[()] == pytest.approx(20_000, rel=0.04)
    assert _counts(sketches.distinct_states(rows, [], NAMES, 14))[()] == pytest.approx(20_000, rel=0.04)


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "date", "decimal(9,2)", "double"])
def test_distinct_states_count_nulls_and_take_any_type(spark, kind):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), ("b", None), (None, 2)], "g string, n int")
    value = F.date_add(F.lit("2020-01-01").cast("date"), "n") if kind == "date" else F.col("n").cast(kind)
    states = sketches.distinct_states(rows.withColumn("id", value), ["g"], NAMES)
    assert _counts(states) == {("a",): 2, ("b",): 1, (None,): 1}
    assert _counts(sketches.merged_distinct_states(states, [], ["IDS"])) == {(): 3}


def test_states_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, id int, v double")
    assert _counts(sketches.distinct_states(empty, ["g"], NAMES)) == {}
    assert _counts(sketches.distinct_states(empty, [], NAMES)) == {(): 0}
    states = sketches.quantile_states(empty, ["g"], ["v"])
    assert sketches.quantile_estimates(states, ["v"], {"M": 0.5}).collect() == []
    nulls = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, v double")
    states = sketches.merged_quantile_states(sketches.quantile_states(nulls, ["g"], ["v"]), ["g"], ["v"])
    assert [tuple(r) for r in sketches.quantile_estimates(states, ["v"], {"M": 0.5}).collect()] == [("a", "v", 0, None)]


def test_quantiles_of_merged_states_keep_their_rank_error(spark):
    # half of the values are one tie, days are of very different sizes
    rows = spark.range(100_000).selectExpr(
        "CAST(IF(id % 2 = 0, 7, id * 7919 % 100003) AS DOUBLE) AS v", "CAST(sqrt(id) AS INT) % 40 AS day", "-id AS w"
    )
    daily = sketches.quantile_states(rows, ["day"], ["v", "w"])
    points = {"A": 0.1, "B": 0.5, "C": 0.75, "D": 0.99}
    merged = sketches.merged_quantile_states(daily, [], ["v", "w"])
    for r in sketches.quantile_estimates(merged, ["v", "w"], points).collect():
        values = sorted(x[0] for x in rows.select(F.col(r["MEASURE"]).cast("double")).collect())
        assert r["N_VALUES"] == len(values)
        for name, p in points.items():
            below = sum(x < r[name] for x in values) / len(values)
            up_to = sum(x <= r[name] for x in values) / len(values)
            assert below - sketches.RANK_ERROR <= p <= up_to + sketches.RANK_ERROR


def test_approximate_shares_are_exact_on_few_ids(spark):
    df = spark.createDataFrame(
        [("p", "a", 1), ("p", "b", 1), ("p", None, 2), (None, "a", 3), (None, "a", None)], "p string, c string, ID_CLI int"
    )
    for share, args in ((distribution.share_of_parent, ("p", "c")), (distribution.share_of_overall, (["p", "c"],))):
        rough, exact = (share(df, *args, {"CLIs": "ID_CLI"}, approx=a).collect() for a in (True, False))
        assert sorted(map(str, rough)) == sorted(map(str, exact))
