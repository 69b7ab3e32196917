import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessera.functions.nulls import n_distinct, null_safe_join
from tessera.functions.ordered import approx_value_summary, running_total, value_summary
from tessera.functions.times import EVENT_TIME, TICKET_TIME, parse_date, parse_timestamp


def test_n_distinct_counts_null_once(spark):
    df = spark.createDataFrame([(None,), ("x",), (None,), ("x",)], "v string")
    assert rows(df.agg(n_distinct("v"), n_distinct("v", approx=True))) == [(2, 2)]
    assert rows(df.where("false").agg(n_distinct("v"), n_distinct("v", approx=True))) == [(0, 0)]


def test_n_distinct_of_composite(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (None, 2)], "a int, b int")
    assert rows(df.agg(n_distinct(F.struct("a", "b")))) == [(3,)]


@pytest.mark.parametrize(
    "how, expected",
    [
        ("inner", [(2, "b", "B"), (None, "n", "N")]),
        ("left", [(1, "a", None), (2, "b", "B"), (None, "n", "N")]),
        ("full", [(1, "a", None), (2, "b", "B"), (3, None, "C"), (None, "n", "N")]),
    ],
)
def test_null_key_matches_null_key(spark, how, expected):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, r string")
    assert rows(null_safe_join(left, right, ["k"], how)) == expected


def test_join_refuses_shared_names(spark):
    left = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        null_safe_join(left, left, ["k"])


def test_text_times(spark):
    df = spark.createDataFrame(
        [
            ("2018-10-05T10:11:12.000Z", "2018-10-05T101112"),
            ("2018-10-05T23:30:00-05:00", "2018-10-05T233000.5"),
            ("2018-10-05T10:11:12", "2018-10-05T1011"),
            ("2018-10-05T10:11:12 and more", "2018-10-05T101112x"),
            ("junk", "junk"),
            (None, None),
        ],
        "e string, t string",
    )
    parsed = df.select(
        parse_timestamp("e", EVENT_TIME).cast("string"),
        parse_timestamp("t", TICKET_TIME).cast("string"),
    )
    assert rows(parsed) == [
        ("2018-10-05 10:11:12", "2018-10-05 10:11:12"),
        ("2018-10-05 10:11:12", None),
        ("2018-10-06 04:30:00", "2018-10-05 23:30:00.5"),
        (None, None),
        (None, None),
        (None, None),
    ]


def test_text_dates(spark):
    df = spark.createDataFrame([("2019-01-01", "1/1/2019"), ("x", "01/10/2018")], "a string, b string")
    parsed = df.select(
        parse_date("a").cast("string"), parse_date("b", "d/M/yyyy").cast("string")
    ).collect()
    assert [tuple(r) for r in parsed] == [("2019-01-01", "2019-01-01"), (None, "2018-10-01")]


def test_running_total_over_many_partitions(spark):
    generator = random.Random(1)
    values = [(i, generator.randint(1, 9)) for i in range(5000)]
    shuffled = values[:]
    generator.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(running_total(df, ["k DESC"], {"upto": "n"}), "k", "upto", "upto_ALL")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total, expected = 0, []
    for k, n in reversed(values):
        total += n
        expected.append((k, total))
    assert [(k, u) for k, u, _ in found] == sorted(expected)
    assert {a for _, _, a in found} == {total}


def test_running_total_by_two_columns_with_nulls(spark):
    keys = [(k % 3 if k % 7 else None, f"n{k:03}" if k % 50 else None) for k in range(300)]
    keys = list(dict.fromkeys(keys))
    df = spark.createDataFrame([(*k, 1) for k in keys], "a int, b string, n int").repartition(5)
    found = running_total(df, ["a DESC", "b"], {"upto": "n"}).orderBy("upto").collect()
    ordered_keys = sorted(keys, key=lambda k: (k[0] is None, -(k[0] or 0), k[1] is None, k[1] or ""))
    assert [(r["a"], r["b"]) for r in found] == ordered_keys
    assert [r["upto"] for r in found] == list(range(1, len(keys) + 1))
    assert rows(running_total(df.where("false"), ["a"], {"upto": "n"})) == []


def _interpolated(values, p):
    values = sorted(values)
    position = p * (len(values) - 1)
    low = int(position)
    high = min(low + 1, len(values) - 1)
    return values[low] + (position - low) * (values[high] - values[low])


def test_value_summary_small(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "v double")
    found = value_summary(df, ["v"], {"a": 0.2, "b": 0.4, "c": 0.6, "d": 0.8}).collect()[0]
    assert found["N_ROWS"] == 5 and found["N_MISSING"] == 1
    assert [round(found[c], 9) for c in "abcd"] == [1.6, 2.4, 3.6, 6.4]
    assert (found["MIN_VALUE"], found["MEAN_VALUE"], found["MAX_VALUE"]) == (1.0, 4.25, 10.0)


def test_value_summary_per_group_with_null_group_and_empty_column(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 3, None), (None, 5, None), (None, 6, None), (None, 10, None)],
        "g string, v int, w int",
    )
    found = value_summary(df, ["v", "w"], {"med": 0.5}, by=["g"])
    assert rows(found, "g", "MEASURE", "N_ROWS", "N_MISSING", "med") == [
        ("a", "v", 2, 0, 2.0),
        ("a", "w", 2, 2, None),
        (None, "v", 3, 0, 6.0),
        (None, "w", 3, 3, None),
    ]


def test_value_summary_of_large_skewed_column(spark):
    # a third of the rows share one value, and the column is large enough to use the sketch
    df = spark.range(300_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 500.0D ELSE pmod(xxhash64(id), 1000000) / 1000.0D END AS v",
        "CAST(id % 7 AS DOUBLE) AS w",
    )
    points = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.9999, "f": 1.0, "g": 0.0}
    found = {r["MEASURE"]: r for r in value_summary(df, ["v", "w"], points).collect()}
    for column in ("v", "w"):
        values = [r[0] for r in df.select(column).collect()]
        for name, p in points.items():
            assert found[column][name] == pytest.approx(_interpolated(values, p), abs=1e-9)
        assert found[column]["MEAN_VALUE"] == pytest.approx(sum(values) / len(values))


def test_approximate_summary_is_close(spark):
    df = spark.range(1001).selectExpr("CAST(id AS DOUBLE) AS v")
    found = approx_value_summary(df, ["v"], {"med": 0.5}).collect()[0]
    assert abs(found["med"] - 500) <= 1 and found["N_ROWS"] == 1001
