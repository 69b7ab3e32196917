import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessera.operators import customers, distribution, quality

SUBSCRIPTION = (
    "ID_CLI long, ID_FID long, COD_FID string, TYP_CLI_FID string, STATUS_FID string,"
    " ID_NEG long, DT_ACTIVE date"
)


@pytest.fixture
def subscriptions(spark, day):
    return spark.createDataFrame(
        [
            (1, 10, "A", "0", "1", 5, day("2018-01-01")),
            (1, 11, "B", "0", "1", 6, day("2018-01-01")),
            (1, 12, "C", "0", "1", 7, day("2018-03-01")),
            (1, 13, "D", "0", "1", 8, day("2018-03-01")),
            (2, 20, "A", "0", "1", 5, None),
            (2, 21, "B", "0", "0", 6, day("2018-02-01")),
            (3, 30, "A", "0", "1", 5, None),
        ],
        SUBSCRIPTION,
    )


def test_snapshot_takes_first_and_last(subscriptions):
    found = {r["ID_CLI"]: r for r in customers.customer_snapshot(subscriptions).collect()}
    assert set(found) == {1, 2}
    one = found[1]
    assert (one["FIRST_ID_NEG"], str(one["FIRST_DT_ACTIVE"])) == (5, "2018-01-01")
    assert (one["ID_FID"], one["LAST_COD_FID"], str(one["LAST_DT_ACTIVE"])) == (13, "D", "2018-03-01")
    assert one["NUM_FIDs"] == 4
    assert str(found[2]["FIRST_DT_ACTIVE"]) == str(found[2]["LAST_DT_ACTIVE"]) == "2018-02-01"
    assert found[2]["NUM_FIDs"] == 2


def test_snapshot_strict(subscriptions):
    assert rows(customers.customer_snapshot(subscriptions, strict_na=True), "ID_CLI") == [(1,)]


def test_key_overlap_matches_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (None,), (None,)], "k int")
    found = rows(quality.key_overlap(a, b, "k", ("in_a", "in_b")), "in_a", "in_b", "TOT_KEYS")
    assert found == [(0, 1, 1), (1, 0, 1), (1, 1, 2)]


def test_key_check(subscriptions):
    found = quality.key_check(subscriptions, ["ID_CLI"], ["ID_FID"], ["ID_CLI", "DT_ACTIVE"])
    assert rows(found) == [
        ("ID_CLI", 3, 7, False),
        ("ID_CLI-DT_ACTIVE", 5, 7, False),
        ("ID_FID", 7, 7, True),
    ]


def test_multiplicity(subscriptions):
    counts = {"NUM_FIDs": "ID_FID", "NUM_DATEs": "DT_ACTIVE"}
    found = rows(quality.multiplicity_distribution(subscriptions, "ID_CLI", counts))
    assert [(a, b, n, round(s, 6)) for a, b, n, s in found] == [
        (1, 1, 1, 0.333333),
        (2, 2, 1, 0.333333),
        (4, 2, 1, 0.333333),
    ]


def test_structure_lists_types(subscriptions):
    found = {r["COLUMN_NAME"]: r for r in quality.structure(subscriptions).collect()}
    assert found["DT_ACTIVE"]["TYPE"] == "date" and found["DT_ACTIVE"]["N_DISTINCT"] == 4
    assert found["ID_CLI"]["N_ROWS"] == 7
    rough = {r["COLUMN_NAME"]: r for r in quality.structure(subscriptions, approx=True).collect()}
    assert rough["ID_FID"]["N_DISTINCT"] == 7


def test_top_levels_and_summaries(spark, subscriptions):
    found = quality.top_levels(subscriptions, ["COD_FID", "ID_NEG"], k=2)
    assert rows(found, "COLUMN_NAME", "POSITION", "LEVEL", "N_ROWS") == [
        ("COD_FID", 1, "A", 3),
        ("COD_FID", 2, "B", 2),
        ("ID_NEG", 1, "5", 3),
        ("ID_NEG", 2, "6", 2),
    ]
    dates = quality.date_summary(subscriptions, ["DT_ACTIVE"]).collect()[0]
    assert (str(dates["MIN_VALUE"]), str(dates["MEDIAN"])) == ("2018-01-01", "2018-02-01")
    assert dates["N_MISSING"] == 2
    rough = quality.numeric_summary(subscriptions, ["ID_FID"], approx=True).collect()[0]
    assert rough["MAX_VALUE"] == 30


def test_missing_pattern_and_address_cleaning(spark):
    df = spark.createDataFrame(
        [
            (1, "00100", "RM", "LAZIO"),
            (1, "00100", "RM", "LAZIO"),
            (2, "80100", "NA", "CAMPANIA"),
            (3, None, "MI", "LOMBARDIA"),
            (4, "20100", None, "LOMBARDIA"),
        ],
        "ID_ADDRESS long, CAP string, PRV string, REGION string",
    )
    pattern = quality.missing_pattern(df, ["CAP", "PRV", "REGION"], "ID_ADDRESS")
    assert rows(pattern) == [(0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 2)]
    assert rows(customers.clean_addresses(df), "ID_ADDRESS", "PRV") == [(1, "RM"), (2, "NA")]


def test_drop_constant_columns(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (2, "x", None, None)], "a int, b string, c int, d int")
    assert quality.drop_constant_columns(df).columns == ["a", "d"]


def test_clean_accounts(spark):
    df = spark.createDataFrame([(None, None, None), ("1", "p", "j")], "W_PHONE string, EMAIL_PROVIDER string, TYP_JOB string")
    assert rows(customers.clean_accounts(df)) == [("0", "(missing)", "(missing)"), ("1", "p", "j")]


def _levels(spark, **counts):
    data = [(i, level) for level, n in counts.items() for i in range(n)]
    return spark.createDataFrame(
        [(n, None if level == "missing" else level) for n, (_, level) in enumerate(data)],
        "ID_CLI int, P string",
    )


def _clean(df, strict=False):
    levels = distribution.level_coverage(df, "P")
    bucketed = distribution.bucket_levels(levels, "P", strict=strict)
    return {r["P"]: r["P_CLEAN"] for r in bucketed.collect()}


def test_bucketing_keeps_the_level_that_crosses(spark):
    assert _clean(_levels(spark, a=70, b=20, c=10)) == {"a": "a", "b": "b", "c": "others"}


def test_bucketing_at_the_exact_coverage(spark):
    df = _levels(spark, a=60, b=25, c=10, d=5)
    assert _clean(df) == {"a": "a", "b": "b", "c": "others", "d": "others"}
    assert _clean(df, strict=True) == {"a": "a", "b": "others", "c": "others", "d": "others"}


def test_bucketing_when_the_first_level_is_enough(spark):
    df = _levels(spark, a=90, b=10)
    assert _clean(df) == {"a": "a", "b": "others"}
    assert _clean(df, strict=True) == {"a": None, "b": "others"}


def test_bucketing_always_keeps_missing(spark):
    df = _levels(spark, a=90, b=7, missing=3)
    assert _clean(df) == {"a": "a", "b": "others", "(missing)": "(missing)"}
    bucketed = distribution.bucket_top_coverage(df, "P")
    found = distribution.distribution(bucketed, "P_CLEAN")
    assert rows(found) == [("(missing)", 3, 0.03), ("a", 90, 0.9), ("others", 7, 0.07)]


def test_merge_levels(spark):
    df = _levels(spark, X=5, **{"Non Dichiara": 3, "missing": 92})
    merged = distribution.merge_levels(df, "P", "(missing)", "Non Dichiara")
    assert rows(distribution.distribution(merged, "P")) == [("Non Dichiara", 95, 0.95), ("X", 5, 0.05)]
    assert rows(distribution.declared_distribution(merged, "P", "Non Dichiara")) == [("X", 5, 1.0)]


def test_distribution_orders_and_counts_null_level(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, None), (3, "b")], "ID_CLI int, g string")
    found = [tuple(r) for r in distribution.distribution(df, "g").collect()]
    assert found == [(None, 2, 0.5), ("a", 1, 0.25), ("b", 1, 0.25)]
    assert sum(r[2] for r in found) == pytest.approx(1.0)


def test_share_of_overall_may_exceed_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, None)], "ID_CLI int, g string")
    found = distribution.share_of_overall(df, ["g"], {"CLIs": "ID_CLI"})
    assert rows(found) == [("a", 1, 0.5), ("b", 2, 1.0), (None, 1, 0.5)]


def test_share_of_parent_with_null_levels(spark):
    df = spark.createDataFrame(
        [("p", "a", 1), ("p", "b", 1), ("p", None, 2), (None, "a", 3)], "p string, c string, ID_CLI int"
    )
    found = distribution.share_of_parent(df, "p", "c", {"CLIs": "ID_CLI"})
    assert rows(found) == [
        ("p", "a", 1, 0.5),
        ("p", "b", 1, 0.5),
        ("p", None, 1, 0.5),
        (None, "a", 1, 1.0),
    ]


def test_empty_input_gives_no_rows_or_null_shares(spark):
    empty = spark.createDataFrame([], "ID_CLI int, g string")
    assert rows(distribution.distribution(empty, "g")) == []
    assert rows(distribution.share_of_overall(empty, ["g"], {"CLIs": "ID_CLI"})) == []


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-5.0,), (-4.9,), (0.0,), (5.0,), (5.1,), (15.0,), (None,)], "x double")
    found = rows(distribution.histogram(df, "x", 10), "BIN_CENTER", "N")
    assert found == [(-10.0, 1), (0.0, 3), (10.0, 2)]
    left = rows(distribution.histogram(df, "x", 10, closed="left"), "BIN_CENTER", "N")
    assert left == [(0.0, 3), (10.0, 2), (20.0, 1)]
    on_multiples = rows(distribution.histogram(df, "x", 10, center=5, closed="left"), "BIN_CENTER", "N")
    assert on_multiples == [(-5.0, 2), (5.0, 3), (15.0, 1)]


def test_histogram_by_number_of_bins(spark):
    df = spark.range(30).selectExpr("CAST(id AS DOUBLE) AS x")
    found = rows(distribution.histogram_by_bins(df, "x", 30), "BIN", "BIN_CENTER", "N")
    assert found == [(i, float(i), 1) for i in range(30)]
    single = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(distribution.histogram_by_bins(single, "x", 30), "BIN", "BIN_CENTER", "N") == [(0, 2.0, 2)]


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, v int")
    assert rows(quality.first_per_key(df, ["k"], [F.desc("v")])) == [(1, 7), (2, 1)]
