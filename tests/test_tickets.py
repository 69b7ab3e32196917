import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessera.operators import days, tickets

LINE = (
    "ID_SCONTRINO long, ID_CLI long, ID_ARTICOLO long, COD_REPARTO string, DIREZIONE int,"
    " IMPORTO_LORDO double, SCONTO double, TIC_DATE date"
)


@pytest.fixture
def lines(spark, day):
    def build(*data):
        return spark.createDataFrame([(*row[:-1], day(row[-1])) for row in data], LINE)

    return build


@pytest.fixture
def sample(lines):
    return lines(
        (1, 1, 10, "a", 1, 10.0, 1.0, "2018-01-01"),
        (1, 1, 11, "b", 1, 20.0, 0.0, "2018-01-01"),
        (2, 1, 10, "a", 1, 5.0, 0.0, "2018-01-05"),
        (3, 2, 10, "a", -1, -10.0, 0.0, "2018-01-10"),
        (4, 2, 12, "b", 1, 40.0, 4.0, "2018-01-10"),
    )


def test_day_types(spark, day):
    expected = {
        "2018-10-05": "weekend",
        "2018-10-06": "weekend",
        "2018-10-07": "holiday",
        "2018-10-08": "weekday",
        "2018-11-01": "holiday",
        "2018-04-02": "holiday",
        "2019-04-22": "holiday",
        None: "other",
    }
    df = spark.createDataFrame([(day(d),) for d in expected], "TIC_DATE date")
    found = {
        None if r["TIC_DATE"] is None else str(r["TIC_DATE"]): r["TIC_DATE_TYP"]
        for r in days.classify_day(df).collect()
    }
    assert found == expected


def test_calendar_weekend_and_own_holidays(spark, day):
    df = spark.createDataFrame(
        [(day("2018-10-05"),), (day("2018-10-07"),), (day("2018-10-08"),)], "TIC_DATE date"
    )
    own = spark.createDataFrame([(day("2018-10-08"),), (day("2018-10-08"),)], "HOLIDAY_DATE date")
    typed = days.classify_day(df, weekend=(1, 7), holidays=own, weekend_is_holiday=False)
    assert rows(typed, "TIC_DATE", "TIC_DATE_TYP") == [
        (day("2018-10-05"), "weekday"),
        (day("2018-10-07"), "weekend"),
        (day("2018-10-08"), "holiday"),
    ]


def test_easter(spark):
    known = {
        1961: "1961-04-02",
        1999: "1999-04-04",
        2000: "2000-04-23",
        2008: "2008-03-23",
        2011: "2011-04-24",
        2019: "2019-04-21",
        2024: "2024-03-31",
        2038: "2038-04-25",
    }
    years = spark.createDataFrame([(y,) for y in known], "y int")
    found = {r[0]: str(r[1]) for r in years.select("y", days.easter_sunday(F.col("y"))).collect()}
    assert found == known


def test_holiday_list(spark):
    found = {str(r[0]) for r in days.italian_holidays(spark, 1999, 2000).collect()}
    assert "1999-12-31" in found and "2000-12-31" not in found
    assert "1999-06-02" not in found and "2000-06-02" in found
    assert "2000-04-24" in found


def test_holidays_of_any_year(spark):
    dates = ["1850-12-25", "2300-12-25", "2300-12-24", "1850-04-01", "2285-03-23", None]
    typed = days.classify_day(
        spark.createDataFrame([(d,) for d in dates], "d string").selectExpr("CAST(d AS DATE) AS TIC_DATE"),
        weekend_is_holiday=False,
        weekend=(),
    )
    found = {str(r["TIC_DATE"]): r["TIC_DATE_TYP"] for r in typed.collect()}
    assert found == {
        "1850-12-25": "holiday", "2300-12-25": "holiday", "2300-12-24": "weekday",
        "1850-04-01": "holiday", "2285-03-23": "holiday", "None": "other",
    }


def test_overview_and_direction(sample, day):
    assert rows(tickets.ticket_overview(sample)) == [(day("2018-01-01"), day("2018-01-10"), 4, 2)]
    assert rows(tickets.direction_shares(sample)) == [(-1, 1, 1, 0.25, 0.5), (1, 3, 2, 0.75, 1.0)]


def test_share_by_direction(sample):
    found = tickets.share_by_direction(sample, "COD_REPARTO")
    assert rows(found, "DIREZIONE", "COD_REPARTO", "TOT_TICs", "PERCENT_CLIs") == [
        (-1, "a", 1, 1.0),
        (1, "a", 2, 0.5),
        (1, "b", 2, 1.0),
    ]


def test_average_amounts(sample):
    assert rows(tickets.average_amounts(sample, "ID_SCONTRINO")) == [
        (-1, -10.0, 0.0),
        (1, 25.0, pytest.approx(5 / 3)),
    ]


def test_popularity_and_purchases(sample):
    assert rows(tickets.article_popularity(sample)) == [(1, 2), (3, 1)]
    assert rows(tickets.article_popularity(sample, below=3)) == [(1, 2)]
    found = [tuple(r) for r in tickets.purchases_per_customer(sample).collect()]
    assert found == [(1, 2), (2, 1)]


def test_next_purchase_curve(lines):
    df = lines(
        *[(i, 1, 1, "a", 1, 1.0, 0.0, f"2018-01-{d:02d}") for i, d in enumerate([1, 1, 5, 10])],
        (9, 1, 1, "a", -1, -1.0, 0.0, "2018-01-07"),
        (10, 1, 1, "a", 1, 1.0, 0.0, None),
    )
    assert rows(tickets.next_purchase_gaps(df)) == [(0, 1), (4, 1), (5, 1)]
    assert rows(tickets.next_purchase_curve(df)) == [(4, 1, 0.5), (5, 1, 0.5)]


def test_next_purchase_by_ticket(lines):
    df = lines(
        (1, 1, 1, "a", 1, 1.0, 0.0, "2018-01-01"),
        (1, 1, 2, "a", 1, 1.0, 0.0, "2018-01-01"),
        (2, 1, 2, "a", 1, 1.0, 0.0, "2018-01-03"),
        (3, 1, 2, "a", 1, 1.0, 0.0, "2018-01-07"),
    )
    assert rows(tickets.next_purchase_gaps(df, "ticket")) == [(2, 1), (4, 1)]
    assert rows(tickets.next_purchase_curve(df, "ticket")) == [(4, 1, 1.0)]
