import pytest
from helpers import rows

from tessera.operators import campaigns

EVENT = (
    "ID_EVENT long, ID_CLI long, ID_CAMP long, ID_DELIVERY long, TYP_EVENT string,"
    " EVENT_DATETIME timestamp"
)


@pytest.fixture
def funnel(spark, time):
    types = spark.createDataFrame([(1, "PROMO", "EMAIL")], "ID_CAMP long, TYP_CAMP string, C string")

    def build(*events, strict_na=False):
        data = [
            (i, client, camp, 1, kind, time(at))
            for i, (client, camp, kind, at) in enumerate(events, 1)
        ]
        df = spark.createDataFrame(data, EVENT)
        return campaigns.email_funnel(df, types, strict_na=strict_na)

    return build


def _short(df):
    return rows(df, "ID_EVENT_S", "OPENED", "DAYS_TO_OPEN", "NUM_OPENs", "CLICKED", "NUM_CLICKs", "FAILED")


def at(n, hour=12):
    return f"2018-05-{n:02d}T{hour:02d}:00:00"


def test_open_and_click(funnel):
    found = funnel((1, 1, "S", at(1)), (1, 1, "V", at(2)), (1, 1, "V", at(3)), (1, 1, "C", at(2)))
    assert _short(found) == [(1, True, 1, 2, True, 1, False)]


def test_first_open_before_send_drops_the_send(funnel):
    assert _short(funnel((1, 1, "S", at(2)), (1, 1, "V", at(1)))) == []


def test_click_without_open_drops_the_send(funnel):
    assert _short(funnel((1, 1, "S", at(1)), (1, 1, "C", at(1)))) == []


@pytest.mark.parametrize("kind", ["B", "E"])
def test_bounce_and_error_are_failures(funnel, kind):
    found = funnel((1, 1, "S", at(1)), (1, 1, kind, at(1)))
    assert _short(found) == [(1, False, None, None, False, None, True)]


def test_two_sends_share_reactions(funnel):
    found = funnel((1, 1, "S", at(1)), (1, 1, "S", at(3)), (1, 1, "V", at(2)))
    assert _short(found) == [(1, True, 1, 1, False, None, False)]


def test_dates_are_compared_not_times(funnel):
    found = funnel((1, 1, "S", at(1, 12)), (1, 1, "V", at(1, 8)))
    assert _short(found) == [(1, True, 0, 1, False, None, False)]


def test_failure_before_send_drops_the_send(funnel):
    assert _short(funnel((1, 1, "E", at(1)), (1, 1, "S", at(2)))) == []


def test_null_client_matches_null_client(funnel):
    found = funnel((None, 1, "S", at(1)), (None, 1, "V", at(2)))
    assert _short(found) == [(1, True, 1, 1, False, None, False)]


def test_unknown_campaign_has_no_type(funnel):
    assert rows(funnel((1, 9, "S", at(1))), "ID_CAMP", "TYP_CAMP") == [(9, None)]


def test_untimed_open(funnel):
    events = [(1, 1, "S", at(1)), (1, 1, "V", None), (1, 1, "V", at(2))]
    assert _short(funnel(*events)) == [(1, True, 1, 2, False, None, False)]
    assert _short(funnel(*events, strict_na=True)) == [(1, False, None, None, False, None, False)]


@pytest.fixture
def sample(funnel):
    return funnel(
        (1, 1, "S", at(1)),
        (1, 1, "V", at(2)),
        (1, 1, "V", at(4)),
        (1, 1, "C", at(2)),
        (2, 1, "S", at(1)),
        (2, 1, "V", at(6)),
        (3, 9, "S", at(3)),
        (3, 9, "B", at(3)),
    )


def test_overview_has_a_total_and_a_null_type(sample):
    found = rows(campaigns.campaign_overview(sample), "TYP_CAMP", "TOT_EVENTs", "TOT_CLIs")
    assert found == [("ALL", 3, 3), ("PROMO", 2, 2), (None, 1, 1)]


def test_rates(sample):
    overall = rows(campaigns.outcome_rate(sample, "OPENED"), "OPENED", "TOT_EVENTs", "PERCENT_CLIs")
    assert [(o, n, round(s, 6)) for o, n, s in overall] == [(False, 1, 0.333333), (True, 2, 0.666667)]
    typed = campaigns.outcome_rate(sample, "CLICKED", by_type=True)
    assert rows(typed, "TYP_CAMP", "CLICKED", "PERCENT_EVENTs") == [
        ("PROMO", False, 0.5),
        ("PROMO", True, 0.5),
        (None, False, 1.0),
    ]


def test_per_customer_distributions(sample):
    assert rows(campaigns.days_to_open_distribution(sample)) == [(1, 1), (5, 1)]
    curve = rows(campaigns.days_to_open_curve(sample))
    assert curve == [(1, 1, 0.5), (5, 1, 1.0)]
    assert rows(campaigns.days_to_open_curve(sample, before_days=5)) == [(1, 1, 0.5)]
    assert rows(campaigns.opens_per_customer(sample)) == [(1, 1), (2, 1)]
    assert rows(campaigns.clicks_per_customer(sample)) == [(1, 1)]
    assert rows(campaigns.clicks_per_customer(sample, aggregate="mean")) == [(1, 1)]
