"""Plans and results that must hold when one key has a third of the rows."""

import re

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tessera.functions import ordered
from tessera.operators import baskets, campaigns, churn, customers, distribution, quality, rfm, tickets
from tessera.plans.catalogue import QUERIES
from tessera.sources import views

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture
def settings(spark):
    changed = {}

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_funnel_splits_a_message_with_very_many_sends(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="10KB",
        adaptive__coalescePartitions__enabled="false",
    )
    day = "CAST('2018-05-01' AS TIMESTAMP) + make_dt_interval(CAST(id % 5 AS INT))"
    client = "IF(id % 3 = 0, 7L, id)"
    sends = spark.range(0, 60_000, 1, 16).selectExpr(
        "id AS ID_EVENT", f"{client} AS ID_CLI", "1L AS ID_CAMP", "1L AS ID_DELIVERY",
        "'S' AS TYP_EVENT", f"{day} AS EVENT_DATETIME",
    )
    opens = spark.range(100_000, 103_000).selectExpr(
        "id AS ID_EVENT", "IF(id % 2 = 0, 7L, id - 100000) AS ID_CLI", "1L AS ID_CAMP",
        "1L AS ID_DELIVERY", "'V' AS TYP_EVENT", "CAST('2018-05-03' AS TIMESTAMP) AS EVENT_DATETIME",
    )
    types = spark.createDataFrame([(1, "PROMO")], "ID_CAMP long, TYP_CAMP string")
    funnel = campaigns.email_funnel(sends.unionByName(opens), types)
    assert "skew=true" in plan(funnel)
    # days 3 and 4 of the hot message lie after its first open, which drops those sends
    hot = funnel.where("ID_CLI = 7 AND ID_EVENT_S % 3 = 0")
    assert hot.count() == sends.where("ID_CLI = 7 AND ID_EVENT % 3 = 0 AND ID_EVENT % 5 <= 2").count()
    assert rows(hot.agg(F.min("NUM_OPENs"), F.max("NUM_OPENs"))) == [(1501, 1501)]


def test_first_per_key_ranks_before_the_shuffle(spark):
    df = spark.range(0, 10_000, 1, 4).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS v")
    found = quality.first_per_key(df, ["k"], [F.desc("v")])
    text = plan(found)
    assert re.search(r"Exchange hashpartitioning[\s\S]*WindowGroupLimit[^\n]*Partial", text)
    assert rows(found.where("k = 0")) == [(0, 9999)]


def test_top_levels_rank_before_the_shuffle(spark):
    df = spark.range(0, 10_000, 1, 4).selectExpr("CAST(id % 2000 AS STRING) AS a")
    assert "Partial" in plan(quality.top_levels(df, ["a"], 3))


def test_gaps_of_one_customer_are_counted_per_day_first(spark):
    lines = spark.range(0, 30_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 1L, id) AS ID_CLI", "id AS ID_SCONTRINO", "1 AS DIREZIONE",
        "date_add(DATE'2018-01-01', CAST(id % 10 AS INT)) AS TIC_DATE",
    )
    found = tickets.next_purchase_gaps(lines)
    text = plan(found)
    # what reaches the window is already one row per customer and day
    assert re.search(r"Window[\s\S]*HashAggregate\(keys=\[ID_CLI", text)
    assert rows(found) == [(0, 10_001 - 10), (1, 9)]


def test_snapshot_and_overlap_of_a_hot_customer(spark):
    subs = spark.range(0, 30_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 1L, id) AS ID_CLI", "id AS ID_FID", "CAST(id AS STRING) AS COD_FID",
        "'0' AS TYP_CLI_FID", "'1' AS STATUS_FID", "id % 50 AS ID_NEG",
        "date_add(DATE'2018-01-01', CAST(id % 1000 AS INT)) AS DT_ACTIVE",
    )
    hot = customers.customer_snapshot(subs).where("ID_CLI = 1").collect()[0]
    newest = max(i for i in range(0, 30_000, 3) if i % 1000 == 999)
    assert hot["ID_FID"] == newest and hot["NUM_FIDs"] == 10_001
    overlap = quality.key_overlap(subs, subs.limit(0), "ID_CLI", ("a", "b"))
    assert rows(overlap) == [(1, 0, subs.select("ID_CLI").distinct().count())]


def test_basket_with_a_third_of_the_lines(spark):
    lines = spark.range(0, 9_000, 1, 4).selectExpr(
        "IF(id % 3 = 0, 0L, id) AS ID_CLI", "TIMESTAMP'2018-01-01 00:00:00' AS TIC_DATETIME",
        "id % 20 AS ID_ARTICOLO", "1.0D AS IMPORTO_LORDO",
    )
    sizes = baskets.basket_sizes(baskets.basket_items(lines))
    assert rows(sizes) == [(1, 6000), (20, 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 700, 5000])
def test_quantiles_of_any_size(spark, n):
    values = [(k, float(k * 37 % 101) if k % 5 else 3.0) for k in range(n)]
    table = spark.createDataFrame(values, "k int, v double")
    points = {"A": 0.01, "B": 0.25, "C": 0.5, "D": 0.999}
    (found,) = ordered.value_summary(table, ["v"], points).collect()
    known = np.quantile([v for _, v in values], list(points.values()))
    assert np.allclose([found[p] for p in points], known)


def test_a_missed_interval_is_widened(spark, monkeypatch):
    table = spark.range(3000).selectExpr("id % 3 AS g", "CAST(id * 7 % 1000 AS DOUBLE) AS v")
    points = {"A": 0.1, "B": 0.5}
    expected = rows(ordered.value_summary(table, ["v"], points, ["g"]))
    sketched, levels = ordered._brackets, []

    def wrong(df, columns, by, quantiles, level):
        levels.append(level)
        ends = sketched(df, columns, by, quantiles, level)
        return ends if level > 1 else ends.withColumn("ENDS", F.array(*[F.lit(5e3 + k) for k in range(4)]))

    monkeypatch.setattr(ordered, "_brackets", wrong)
    assert rows(ordered.value_summary(table, ["v"], points, ["g"])) == expected
    assert levels == [0, 1, 2]


def initial(df):
    return plan(df).split("== Initial Plan ==")[-1]


def fact_scans(df, name):
    return len(re.findall(rf"FileScan parquet [^\n]*{name}\.parquet", initial(df)))


def test_shares_scan_once(spark):
    for found in (
        distribution.distribution(views.privacy(spark, DIRECTORY), "FLAG_PRIVACY_1"),
        quality.multiplicity_distribution(
            views.fidelity(spark, DIRECTORY), "ID_CLI", {"a": "ID_FID", "b": "DT_ACTIVE"}
        ),
    ):
        assert "ReusedExchange" in plan(found)
    for name in ("q30_hour_share_by_direction", "q31_department_share", "q32_day_type_share"):
        assert fact_scans(QUERIES[name](spark, DIRECTORY), "lineitem") == 1
    assert fact_scans(QUERIES["q30_hour_share_by_event_type"](spark, DIRECTORY), "events") == 1


def test_running_totals_shuffle_rows_once(spark):
    rows_in = spark.range(5000).selectExpr("id AS k", "id % 7 AS n")
    found = initial(ordered.running_total(rows_in, ["k DESC"], {"upto": "n"}))
    assert "rangepartitioning" not in found
    # the rows, and the sums per stretch
    assert len(re.findall(r"Exchange hashpartitioning\(__part", found)) <= 2


def test_only_items_read_the_article_table(spark):
    for name in ("q33_purchases_per_customer", "q38_next_purchase_curve", "q39_rfm_table"):
        assert fact_scans(QUERIES[name](spark, DIRECTORY), "part") == 0
    assert fact_scans(QUERIES["q31_department_share"](spark, DIRECTORY), "part") == 1


def test_filters_and_columns_reach_the_scan(spark):
    found = tickets.purchases_per_customer(views.ticket(spark, DIRECTORY))
    text = plan(found)
    assert "l_extendedprice" not in text and "o_totalprice" not in text
    active = churn.active_customers(views.ticket(spark, DIRECTORY), "2001-05-01", "2001-08-01")
    assert re.search(r"PushedFilters: \[[^\]]*o_orderdate[^\]]*\]", plan(active))
    # the label comes from the pass that sums up the customers
    lines = views.ticket(spark, DIRECTORY)
    label = rfm.rfm_customer_table(lines, active=churn.active_line("2001-05-01", "2001-08-01"))
    assert fact_scans(label, "lineitem") == 1 and "CHURN" in label.columns


def test_event_type_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(100).selectExpr(
        "id AS ID_EVENT", "id % 9 AS ID_CLI", "1L AS ID_CAMP", "1L AS ID_DELIVERY",
        "IF(id % 2 = 0, 'S', 'V') AS TYP_EVENT", "TIMESTAMP'2018-05-01 00:00:00' AS EVENT_DATETIME",
    ).write.parquet(path)
    types = spark.createDataFrame([(1, "PROMO")], "ID_CAMP long, TYP_CAMP string")
    text = plan(campaigns.email_funnel(spark.read.parquet(path), types))
    assert "EqualTo(TYP_EVENT,S)" in text and "In(TYP_EVENT, [" in text
