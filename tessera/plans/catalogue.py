"""Named queries: each takes (spark, directory of parquet tables) and returns a DataFrame.

Dates and arrays are returned as text, sums and means of money rounded, so that results compare
across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sketches
from tessera.functions.materialize import checkpointed
from tessera.functions.times import year_text
from tessera.operators import (
    baskets,
    campaigns,
    churn,
    customers,
    days,
    distribution,
    evaluation,
    quality,
    rfm,
    tickets,
    trees,
)
from tessera.sources import views

Query = Callable[[SparkSession, str], DataFrame]

# The test tickets run from 1995-01-01 to 2001-08-01.
RFM_END = "2001-12-31"
CHURN_START, CHURN_END = "2001-05-01", "2001-08-01"
# Item groups make long rules; of single articles, pairs bought more than once are mined.
RULE_ITEM = "ITEM_GROUP"
RULE_SUPPORT, RULE_CONFIDENCE = 0.001, 0.3
ARTICLE_SUPPORT, ARTICLE_CONFIDENCE = 0.0001, 0.05
FREQUENT_ARTICLE = 0.002
TRIPLE_SUPPORT, TRIPLE_CONFIDENCE = 0.00002, 0.5
# A label that any model can learn without a mistake.
RULE_SEGMENTS = ("At Risk", "Lost", "About To Sleep")

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def joined_items(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


# ---- profiling and data quality ----


@query
def q01_structure(spark: SparkSession, directory: str) -> DataFrame:
    return quality.structure(views.account(spark, directory)).drop("TYPE")


@query
def q01_numeric_summary(spark: SparkSession, directory: str) -> DataFrame:
    columns = ["ID_SCONTRINO", "ID_CLI", "ID_ARTICOLO", "DIREZIONE", "IMPORTO_LORDO", "SCONTO"]
    summary = quality.numeric_summary(views.ticket(spark, directory), columns)
    exact = rounded(summary, 6, "Q1", "MEDIAN", "Q3")
    return rounded(exact, 4, "MIN_VALUE", "MEAN_VALUE", "MAX_VALUE")


@query
def q01_date_summary(spark: SparkSession, directory: str) -> DataFrame:
    summary = quality.date_summary(views.fidelity(spark, directory), ["DT_ACTIVE"])
    return as_text(summary, "MIN_VALUE", "Q1", "MEDIAN", "MEAN_VALUE", "Q3", "MAX_VALUE")


@query
def q02_top_levels(spark: SparkSession, directory: str) -> DataFrame:
    columns = ["EMAIL_PROVIDER", "W_PHONE", "TYP_CLI_ACCOUNT", "TYP_JOB"]
    return as_long(quality.top_levels(views.account(spark, directory), columns), "POSITION")


@query
def q03_key_check_subscriptions(spark: SparkSession, directory: str) -> DataFrame:
    return quality.key_check(
        views.fidelity(spark, directory),
        ["ID_CLI"],
        ["ID_FID"],
        ["ID_CLI", "ID_FID"],
        ["ID_CLI", "DT_ACTIVE"],
        ["COD_FID"],
    )


@query
def q03_key_check_addresses(spark: SparkSession, directory: str) -> DataFrame:
    return quality.key_check(views.address(spark, directory), ["ID_ADDRESS"], ["PRV"])


@query
def q03_key_check_events(spark: SparkSession, directory: str) -> DataFrame:
    return quality.key_check(
        views.event(spark, directory), ["ID_EVENT"], ["ID_CLI", "ID_CAMP", "ID_DELIVERY"]
    )


@query
def q04_multiplicity(spark: SparkSession, directory: str) -> DataFrame:
    return quality.multiplicity_distribution(
        views.fidelity(spark, directory), "ID_CLI", {"NUM_FIDs": "ID_FID", "NUM_DATEs": "DT_ACTIVE"}
    )


@query
def q04_same_day_subscribers(spark: SparkSession, directory: str) -> DataFrame:
    per_client = quality.key_multiplicity(
        views.fidelity(spark, directory), "ID_CLI", {"NUM_FIDs": "ID_FID", "NUM_DATEs": "DT_ACTIVE"}
    )
    return per_client.where("NUM_DATEs < NUM_FIDs")


@query
def q05_missing_pattern(spark: SparkSession, directory: str) -> DataFrame:
    pattern = quality.missing_pattern(
        views.address(spark, directory), ["CAP", "PRV", "REGION"], "ID_ADDRESS"
    )
    return as_long(pattern, "W_CAP", "W_PRV", "W_REGION")


@query
def q05_complete_cases(spark: SparkSession, directory: str) -> DataFrame:
    return quality.complete_cases(views.account(spark, directory), ["EMAIL_PROVIDER", "TYP_JOB"])


def _overlap(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    return as_long(quality.key_overlap(left, right, key, names), *names)


@query
def q06_subscriber_account_overlap(spark: SparkSession, directory: str) -> DataFrame:
    fidelity, account = views.fidelity(spark, directory), views.account(spark, directory)
    return _overlap(fidelity, account, "ID_CLI", ("IS_IN_FIDELITY", "IS_IN_ACCOUNT"))


@query
def q06_subscriber_privacy_overlap(spark: SparkSession, directory: str) -> DataFrame:
    fidelity, privacy = views.fidelity(spark, directory), views.privacy(spark, directory)
    return _overlap(fidelity, privacy, "ID_CLI", ("IS_IN_FIDELITY", "IS_IN_PRIVACY"))


@query
def q06_subscriber_event_overlap(spark: SparkSession, directory: str) -> DataFrame:
    fidelity, event = views.fidelity(spark, directory), views.event(spark, directory)
    return _overlap(fidelity, event, "ID_CLI", ("IS_IN_FIDELITY", "IS_IN_EVENT"))


@query
def q06_subscriber_ticket_overlap(spark: SparkSession, directory: str) -> DataFrame:
    fidelity, ticket = views.fidelity(spark, directory), views.ticket(spark, directory)
    return _overlap(fidelity, ticket, "ID_CLI", ("IS_IN_FIDELITY", "IS_IN_TICKET"))


@query
def q07_campaign_event_overlap(spark: SparkSession, directory: str) -> DataFrame:
    campaign, event = views.campaign(spark, directory), views.event(spark, directory)
    return _overlap(campaign, event, "ID_CAMP", ("IS_IN_CAMPAIGN", "IS_IN_EVENT"))


@query
def q07_account_address_overlap(spark: SparkSession, directory: str) -> DataFrame:
    account = views.account(spark, directory)
    address = customers.clean_addresses(views.address(spark, directory))
    return _overlap(account, address, "ID_ADDRESS", ("IS_IN_ACCOUNT", "IS_IN_ADDRESS"))


@query
def q08_clean_addresses(spark: SparkSession, directory: str) -> DataFrame:
    return customers.clean_addresses(views.address(spark, directory))


@query
def q07_key_presence(spark: SparkSession, directory: str) -> DataFrame:
    """Which of the seven tables hold a customer, campaign or address."""
    tables = {
        name: getattr(views, name)(spark, directory)
        for name in ("fidelity", "account", "address", "privacy", "campaign", "event", "ticket")
    }
    held = {
        "ID_CLI": ("fidelity", "account", "privacy", "event", "ticket"),
        "ID_CAMP": ("campaign", "event"),
        "ID_ADDRESS": ("account", "address"),
    }
    return quality.key_presence([(key, t, tables[t]) for key, names in held.items() for t in names])


@query
def q09_level_dominance(spark: SparkSession, directory: str) -> DataFrame:
    """The most frequent level of each account column and its weight."""
    columns = ["EMAIL_PROVIDER", "W_PHONE", "TYP_CLI_ACCOUNT", "TYP_JOB"]
    return quality.level_dominance(views.account(spark, directory), columns)


@query
def q09_drop_constant_columns(spark: SparkSession, directory: str) -> DataFrame:
    return quality.drop_constant_columns(views.campaign(spark, directory))


# ---- customers ----


@query
def q10_customer_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    snapshot = customers.customer_snapshot(views.fidelity(spark, directory))
    return as_text(snapshot, "LAST_DT_ACTIVE", "FIRST_DT_ACTIVE")


@query
def q11_clean_accounts(spark: SparkSession, directory: str) -> DataFrame:
    return as_long(customers.clean_accounts(views.account(spark, directory)), "TYP_CLI_ACCOUNT")


def _snapshot(spark: SparkSession, directory: str) -> DataFrame:
    return customers.customer_snapshot(views.fidelity(spark, directory))


@query
def q12_last_code_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.distribution(_snapshot(spark, directory), "LAST_COD_FID")


@query
def q12_last_status_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.distribution(_snapshot(spark, directory), "LAST_STATUS_FID")


@query
def q12_subscription_count_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.distribution(_snapshot(spark, directory), "NUM_FIDs")


@query
def q13_last_year_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.distribution(
        _snapshot(spark, directory), year_text("LAST_DT_ACTIVE"), name="YEAR"
    )


@query
def q13_first_year_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.distribution(
        _snapshot(spark, directory), year_text("FIRST_DT_ACTIVE"), name="YEAR"
    )


def _address_distribution(spark: SparkSession, directory: str, by: str) -> DataFrame:
    cleaned = customers.clean_addresses(views.address(spark, directory))
    return distribution.distribution(cleaned, by, "ID_ADDRESS", "TOT_ADDs")


@query
def q14_region_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return _address_distribution(spark, directory, "REGION")


@query
def q14_province_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return _address_distribution(spark, directory, "PRV")


@query
def q14_postal_code_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return _address_distribution(spark, directory, "CAP")


def _privacy_distribution(spark: SparkSession, directory: str, flag: str) -> DataFrame:
    return as_long(distribution.distribution(views.privacy(spark, directory), flag), flag)


@query
def q15_privacy_1_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return _privacy_distribution(spark, directory, "FLAG_PRIVACY_1")


@query
def q15_privacy_2_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return _privacy_distribution(spark, directory, "FLAG_PRIVACY_2")


@query
def q15_direct_marketing_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return _privacy_distribution(spark, directory, "FLAG_DIRECT_MKT")


@query
def q16_provider_distribution(spark: SparkSession, directory: str) -> DataFrame:
    accounts = customers.clean_accounts(views.account(spark, directory))
    return distribution.distribution(accounts, "EMAIL_PROVIDER")


@query
def q16_top_providers(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 most frequent providers with their running share."""
    levels = distribution.level_coverage(views.account(spark, directory), "EMAIL_PROVIDER")
    return levels.orderBy(F.desc("TOT_CLIs"), "EMAIL_PROVIDER").limit(20)


@query
def q16_bucketed_providers(spark: SparkSession, directory: str) -> DataFrame:
    levels = distribution.level_coverage(views.account(spark, directory), "EMAIL_PROVIDER")
    return distribution.bucket_levels(levels, "EMAIL_PROVIDER").select(
        "EMAIL_PROVIDER", "EMAIL_PROVIDER_CLEAN"
    )


@query
def q16_clean_provider_distribution(spark: SparkSession, directory: str) -> DataFrame:
    bucketed = distribution.bucket_top_coverage(views.account(spark, directory), "EMAIL_PROVIDER")
    return distribution.distribution(bucketed, "EMAIL_PROVIDER_CLEAN")


def _merged_jobs(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.merge_levels(
        views.account(spark, directory), "TYP_JOB", "(missing)", "Non Dichiara"
    )


@query
def q17_job_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.distribution(_merged_jobs(spark, directory), "TYP_JOB")


@query
def q17_declared_job_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return distribution.declared_distribution(
        _merged_jobs(spark, directory), "TYP_JOB", "Non Dichiara"
    )


# ---- campaigns ----


def _typed_tickets(spark: SparkSession, directory: str) -> DataFrame:
    return days.classify_day(views.ticket(spark, directory))


@query
def q20_day_types(spark: SparkSession, directory: str) -> DataFrame:
    """Ticket lines per date with its weekday, holiday flag and type."""
    typed = _typed_tickets(spark, directory)
    counts = typed.groupBy(
        "TIC_DATE", "TIC_DATE_WEEKDAY", "TIC_DATE_HOLIDAY", "TIC_DATE_TYP"
    ).agg(F.count(F.lit(1)).alias("N_LINES"))
    return as_long(as_text(counts, "TIC_DATE"), "TIC_DATE_WEEKDAY", "TIC_DATE_HOLIDAY")


@query
def q20_calendar_day_types(spark: SparkSession, directory: str) -> DataFrame:
    """Ticket lines per day type with a Saturday and Sunday weekend."""
    typed = days.classify_day(
        views.ticket(spark, directory),
        weekend=(days.SUNDAY, days.SATURDAY),
        weekend_is_holiday=False,
    )
    return typed.groupBy("TIC_DATE_TYP").agg(F.count(F.lit(1)).alias("N_LINES"))


def _funnel(spark: SparkSession, directory: str) -> DataFrame:
    return campaigns.email_funnel(views.event(spark, directory), views.campaign(spark, directory))


@query
def q21_email_funnel(spark: SparkSession, directory: str) -> DataFrame:
    funnel = as_text(_funnel(spark, directory), "SEND_DATE", "OPEN_DATE", "CLICK_DATE")
    return as_long(funnel, "OPENED", "CLICKED", "FAILED", "DAYS_TO_OPEN")


@query
def q22_campaign_overview(spark: SparkSession, directory: str) -> DataFrame:
    overview = campaigns.campaign_overview(_funnel(spark, directory))
    return as_text(overview, "MIN_DATE", "MAX_DATE")


@query
def q23_open_rate(spark: SparkSession, directory: str) -> DataFrame:
    return as_long(campaigns.outcome_rate(_funnel(spark, directory), "OPENED"), "OPENED")


def _rate_by_type(spark: SparkSession, directory: str, flag: str) -> DataFrame:
    return as_long(campaigns.outcome_rate(_funnel(spark, directory), flag, by_type=True), flag)


@query
def q24_open_rate_by_type(spark: SparkSession, directory: str) -> DataFrame:
    return _rate_by_type(spark, directory, "OPENED")


@query
def q24_click_rate_by_type(spark: SparkSession, directory: str) -> DataFrame:
    return _rate_by_type(spark, directory, "CLICKED")


@query
def q24_fail_rate_by_type(spark: SparkSession, directory: str) -> DataFrame:
    return _rate_by_type(spark, directory, "FAILED")


@query
def q25_stacked_open_share(spark: SparkSession, directory: str) -> DataFrame:
    rates = _rate_by_type(spark, directory, "OPENED").select("TYP_CAMP", "OPENED", "TOT_EVENTs")
    return distribution.share_within(rates, "TYP_CAMP", "TOT_EVENTs")


@query
def q26_days_to_open(spark: SparkSession, directory: str) -> DataFrame:
    return campaigns.days_to_open_distribution(_funnel(spark, directory))


@query
def q27_days_to_open_curve(spark: SparkSession, directory: str) -> DataFrame:
    return campaigns.days_to_open_curve(_funnel(spark, directory), before_days=14)


@query
def q28_opens_per_customer(spark: SparkSession, directory: str) -> DataFrame:
    return campaigns.opens_per_customer(_funnel(spark, directory))


@query
def q28_clicks_per_customer(spark: SparkSession, directory: str) -> DataFrame:
    return campaigns.clicks_per_customer(_funnel(spark, directory))


# ---- tickets ----


@query
def q29_ticket_overview(spark: SparkSession, directory: str) -> DataFrame:
    return as_text(tickets.ticket_overview(views.ticket(spark, directory)), "MIN_DATE", "MAX_DATE")


@query
def q29_direction_shares(spark: SparkSession, directory: str) -> DataFrame:
    return as_long(tickets.direction_shares(views.ticket(spark, directory)), "DIREZIONE")


@query
def q29_direction_counts_from_daily_states(spark: SparkSession, directory: str) -> DataFrame:
    """Exact counts per direction, and whether merged states of single days are within 2 % of them."""
    lines = views.ticket(spark, directory)
    counts = {"TICs": "ID_SCONTRINO", "CLIs": "ID_CLI"}
    daily = sketches.distinct_states(lines, ["TIC_DATE", "DIREZIONE"], counts, log_registers=16)
    merged = sketches.merged_distinct_states(daily, ["DIREZIONE"], list(counts))
    near = sketches.distinct_estimates(merged, list(counts))
    exact = tickets.direction_shares(lines).select("DIREZIONE", "TOT_TICs", "TOT_CLIs")
    within = [(F.abs(F.col(n) / F.col(f"TOT_{n}") - 1) <= 0.02).alias(f"{n}_WITHIN") for n in counts]
    return as_long(exact.join(near, "DIREZIONE").select(*exact.columns, *within), "DIREZIONE")


@query
def q29_amount_edges_from_daily_states(spark: SparkSession, directory: str) -> DataFrame:
    """Amounts per direction, and whether edges from merged states of days have the rank they state."""
    lines = views.ticket(spark, directory)
    points = {f"P{i}0": i / 10 for i in (2, 4, 5, 6, 8)}
    daily = sketches.quantile_states(lines, ["TIC_DATE", "DIREZIONE"], ["IMPORTO_LORDO"])
    merged = sketches.merged_quantile_states(daily, ["DIREZIONE"], ["IMPORTO_LORDO"])
    edges = sketches.quantile_estimates(merged, ["IMPORTO_LORDO"], points).drop("MEASURE")
    amount = F.col("IMPORTO_LORDO")
    ranked = lines.where(amount.isNotNull()).join(edges, "DIREZIONE").groupBy("DIREZIONE", "N_VALUES")
    counted = ranked.agg(
        F.count("*").alias("N"),
        *[F.count_if(amount < F.col(p)).alias(f"{p}_BELOW") for p in points],
        *[F.count_if(amount <= F.col(p)).alias(f"{p}_UP_TO") for p in points],
    )
    error = sketches.RANK_ERROR
    within = [
        (
            (F.col(f"{n}_BELOW") <= (p + error) * F.col("N")) & (F.col(f"{n}_UP_TO") >= (p - error) * F.col("N"))
        ).alias(f"{n}_WITHIN")
        for n, p in points.items()
    ]
    return as_long(counted.select("DIREZIONE", "N_VALUES", "N", *within), "DIREZIONE", "N_VALUES")


@query
def q30_hour_share_by_event_type(spark: SparkSession, directory: str) -> DataFrame:
    """Events and customers per hour within each event type."""
    shares = distribution.share_of_parent(
        views.event(spark, directory),
        "TYP_EVENT",
        "EVENT_HOUR",
        {"EVENTs": "ID_EVENT", "CLIs": "ID_CLI"},
    )
    return as_long(shares, "EVENT_HOUR")


@query
def q30_hour_share_by_direction(spark: SparkSession, directory: str) -> DataFrame:
    """Tickets and customers per hour within each direction."""
    shares = tickets.share_by_direction(views.ticket(spark, directory), "TIC_HOUR")
    return as_long(shares, "DIREZIONE", "TIC_HOUR")


@query
def q31_department_share(spark: SparkSession, directory: str) -> DataFrame:
    shares = tickets.share_by_direction(views.ticket(spark, directory, items=True), "COD_REPARTO")
    return as_long(shares, "DIREZIONE")


@query
def q32_day_type_share(spark: SparkSession, directory: str) -> DataFrame:
    shares = tickets.share_by_direction(_typed_tickets(spark, directory), "TIC_DATE_TYP")
    return as_long(shares, "DIREZIONE")


@query
def q33_purchases_per_customer(spark: SparkSession, directory: str) -> DataFrame:
    return tickets.purchases_per_customer(views.ticket(spark, directory))


def _average_amounts(spark: SparkSession, directory: str, entity: str) -> DataFrame:
    lines = views.ticket(spark, directory, items=entity == "COD_REPARTO")
    means = tickets.average_amounts(lines, entity)
    return as_long(rounded(means, 4, "AVG_IMPORTO_LORDO", "AVG_SCONTO"), "DIREZIONE")


@query
def q34_amounts_per_ticket(spark: SparkSession, directory: str) -> DataFrame:
    return _average_amounts(spark, directory, "ID_SCONTRINO")


@query
def q35_amounts_per_department(spark: SparkSession, directory: str) -> DataFrame:
    return _average_amounts(spark, directory, "COD_REPARTO")


@query
def q35_amounts_per_customer(spark: SparkSession, directory: str) -> DataFrame:
    return _average_amounts(spark, directory, "ID_CLI")


@query
def q36_article_popularity(spark: SparkSession, directory: str) -> DataFrame:
    return tickets.article_popularity(views.ticket(spark, directory))


@query
def q36_article_popularity_view(spark: SparkSession, directory: str) -> DataFrame:
    return tickets.article_popularity(views.ticket(spark, directory), below=50)


def _ticket_totals(spark: SparkSession, directory: str, entity: str) -> DataFrame:
    lines = views.ticket(spark, directory, items=entity == "COD_REPARTO")
    totals = tickets.amount_totals(lines, entity)
    return as_long(rounded(totals, 4, "IMPORTO_LORDO", "SCONTO"), "DIREZIONE")


@query
def q37_gross_histogram(spark: SparkSession, directory: str) -> DataFrame:
    totals = _ticket_totals(spark, directory, "ID_SCONTRINO")
    view = totals.where("IMPORTO_LORDO > -1000 AND IMPORTO_LORDO < 1000")
    return distribution.histogram(view, "IMPORTO_LORDO", 10, by=["DIREZIONE"])


@query
def q37_discount_histogram(spark: SparkSession, directory: str) -> DataFrame:
    """The view is cut on the discount from below and on the gross amount from above."""
    totals = _ticket_totals(spark, directory, "ID_SCONTRINO")
    view = totals.where("SCONTO > -250 AND IMPORTO_LORDO < 250")
    return distribution.histogram(view, "SCONTO", 10, by=["DIREZIONE"])


@query
def q37_customer_gross_bins(spark: SparkSession, directory: str) -> DataFrame:
    totals = _ticket_totals(spark, directory, "ID_CLI")
    bins = distribution.histogram_by_bins(totals, "IMPORTO_LORDO", 30, by=["DIREZIONE"])
    return rounded(bins, 3, "BIN_CENTER")


@query
def q37_department_discount_bins(spark: SparkSession, directory: str) -> DataFrame:
    totals = _ticket_totals(spark, directory, "COD_REPARTO")
    bins = distribution.histogram_by_bins(totals, "SCONTO", 30, by=["DIREZIONE"])
    return rounded(bins, 3, "BIN_CENTER")


@query
def q38_next_purchase_curve(spark: SparkSession, directory: str) -> DataFrame:
    return as_long(tickets.next_purchase_curve(views.ticket(spark, directory)), "DAYS_DIFF")


@query
def q38_next_ticket_curve(spark: SparkSession, directory: str) -> DataFrame:
    curve = tickets.next_purchase_curve(views.ticket(spark, directory), grain="ticket")
    return as_long(curve, "DAYS_DIFF")


# ---- recency, frequency, monetary ----


def _rfm_table(spark: SparkSession, directory: str) -> DataFrame:
    return rfm.rfm_customer_table(views.ticket(spark, directory), RFM_END)


def _segments(spark: SparkSession, directory: str) -> DataFrame:
    return rfm.rfm_segment(rfm.rfm_score(_rfm_table(spark, directory)))


@query
def q39_rfm_table(spark: SparkSession, directory: str) -> DataFrame:
    table = rounded(_rfm_table(spark, directory), 2, "revenue")
    return as_long(as_text(table, "last_buy"), "recency_days")


@query
def q39_last_line_per_customer(spark: SparkSession, directory: str) -> DataFrame:
    """One line per customer: the latest, then the highest ticket and article number."""
    lines = views.ticket(spark, directory).select(
        "ID_CLI", "TIC_DATE", "ID_SCONTRINO", "ID_ARTICOLO", "IMPORTO_LORDO"
    )
    order = [F.desc(c) for c in ["TIC_DATE", "ID_SCONTRINO", "ID_ARTICOLO", "IMPORTO_LORDO"]]
    return as_text(quality.first_per_key(lines, ["ID_CLI"], order), "TIC_DATE")


@query
def q40_rfm_segments(spark: SparkSession, directory: str) -> DataFrame:
    scored = rounded(_segments(spark, directory), 2, "amount")
    return as_long(
        scored, "recency_days", "recency_score", "frequency_score", "monetary_score", "rfm_score"
    )


@query
def q40_rfm_segments_last_match(spark: SparkSession, directory: str) -> DataFrame:
    scores = rfm.rfm_score(_rfm_table(spark, directory))
    return rfm.rfm_segment(scores, on_overlap="last").select("customer_id", "segment")


@query
def q40_segments_by_rule_table(spark: SparkSession, directory: str) -> DataFrame:
    """The ten rules as rows, joined through the cells they cover."""
    scores = rfm.rfm_score(_rfm_table(spark, directory))
    rules = rfm.segment_rules_table(spark)
    return rfm.rfm_segment(scores, rules).select("customer_id", "segment")


@query
def q40_segments_by_many_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of ten bins against a box per part: as many rules as there are parts, the last one wins."""
    scores = rfm.rfm_score(_rfm_table(spark, directory), bins=10)
    rules = spark.read.parquet(f"{directory}/part.parquet").selectExpr(
        "p_partkey AS priority",
        "p_brand AS segment",
        "1 + p_size % 10 AS recency_lower",
        "1 + p_size % 10 + p_partkey % 3 AS recency_upper",
        "1 + p_partkey % 10 AS frequency_lower",
        "IF(p_partkey % 7 = 0, NULL, 1 + p_partkey % 10 + p_size % 2) AS frequency_upper",
        "IF(p_partkey % 11 = 0, NULL, 1 + p_partkey div 10 % 10) AS monetary_lower",
        "1 + p_partkey div 10 % 10 AS monetary_upper",
    )
    found = rfm.rfm_segment(scores, rules, on_overlap="last", bins=10)
    columns = ["recency_score", "frequency_score", "monetary_score"]
    return as_long(found, *columns).select("customer_id", *columns, "segment")


@query
def q41_segment_counts(spark: SparkSession, directory: str) -> DataFrame:
    return rfm.segment_counts(_segments(spark, directory))


@query
def q42_segment_medians(spark: SparkSession, directory: str) -> DataFrame:
    medians = rfm.segment_medians(_segments(spark, directory))
    return rounded(medians, 2, "median_monetary", "median_frequency", "median_recency")


@query
def q43_monetary_heatmap(spark: SparkSession, directory: str) -> DataFrame:
    heat = rfm.monetary_heatmap(rfm.rfm_score(_rfm_table(spark, directory)))
    return as_long(rounded(heat, 9, "monetary"), "frequency_score", "recency_score")


@query
def q43_score_counts(spark: SparkSession, directory: str) -> DataFrame:
    counts = rfm.score_counts(rfm.rfm_score(_rfm_table(spark, directory)))
    return as_long(counts, "frequency_score", "recency_score", "monetary_score")


@query
def q43_order_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return rfm.order_distribution(rfm.rfm_score(_rfm_table(spark, directory)))


# ---- churn ----


def _churn_set(spark: SparkSession, directory: str) -> DataFrame:
    customers = rfm.rfm_customer_table(
        views.ticket(spark, directory), RFM_END, active=churn.active_line(CHURN_START, CHURN_END)
    )
    segments = rfm.rfm_segment(rfm.rfm_score(customers))
    return churn.label_churn(segments)


@query
def q44_churn_labels(spark: SparkSession, directory: str) -> DataFrame:
    labelled = rounded(_churn_set(spark, directory), 2, "amount")
    return as_long(labelled, "recency_days", "CHURN")


def _prior_churn_set(spark: SparkSession, directory: str) -> DataFrame:
    """As ``_churn_set``, with features that end before the window of the label begins."""
    lines = views.ticket(spark, directory)
    before = lines.where(F.col("TIC_DATE") <= F.lit(CHURN_START).cast("date"))
    segments = rfm.rfm_segment(rfm.rfm_score(rfm.rfm_customer_table(before, CHURN_START)))
    return churn.label_churn(segments, lines, CHURN_START, CHURN_END)


@query
def q44_prior_churn_labels(spark: SparkSession, directory: str) -> DataFrame:
    labelled = rounded(_prior_churn_set(spark, directory), 2, "amount")
    return as_long(labelled, "recency_days", "CHURN")


@query
def q45_split_sizes(spark: SparkSession, directory: str) -> DataFrame:
    split = churn.stratified_split(_churn_set(spark, directory))
    sizes = split.groupBy("CHURN", "IS_TRAIN").agg(F.count(F.lit(1)).alias("N_ROWS"))
    return as_long(sizes, "CHURN", "IS_TRAIN")


def _split(spark: SparkSession, directory: str) -> DataFrame:
    # read by every fit and by the scoring
    return checkpointed(churn.stratified_split(_churn_set(spark, directory)))


def _predictions(spark: SparkSession, directory: str, *names: str) -> dict[str, DataFrame]:
    split = _split(spark, directory)
    train, test = split.where("IS_TRAIN"), split.where("NOT IS_TRAIN")
    fits = {
        "tree": churn.fit_decision_tree,
        "forest": churn.fit_random_forest,
        "logistic": churn.fit_logistic,
    }
    return {name: churn.predict(fits[name](train), test, name) for name in names}


@query
def q46_tree_predictions(spark: SparkSession, directory: str) -> DataFrame:
    return _predictions(spark, directory, "tree")["tree"]


@query
def q46_forest_predictions(spark: SparkSession, directory: str) -> DataFrame:
    return _predictions(spark, directory, "forest")["forest"]


@query
def q46_logistic_predictions(spark: SparkSession, directory: str) -> DataFrame:
    return _predictions(spark, directory, "logistic")["logistic"]


@query
def q46_model_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    predictions = _predictions(spark, directory, "logistic", "forest", "tree")
    return evaluation.accuracy_table(predictions, "PREDICTED", "CHURN")


@query
def q46_logistic_coefficients(spark: SparkSession, directory: str) -> DataFrame:
    return churn.logistic_coefficients(_split(spark, directory).where("IS_TRAIN"))


@query
def q46_prior_logistic_coefficients(spark: SparkSession, directory: str) -> DataFrame:
    """Terms of a model whose features do not know the window of the label."""
    return churn.logistic_coefficients(checkpointed(_prior_churn_set(spark, directory)))


def _stayers_expected(spark: SparkSession, directory: str, fit) -> DataFrame:
    """Sum of the probabilities to stay that a model gives to the rows it was fitted on."""
    train = _split(spark, directory).where("IS_TRAIN")
    known = churn.predict(fit(train), train, "model")
    return rounded(known.agg(F.sum("P_STAY").alias("EXPECTED_STAYERS")), 1, "EXPECTED_STAYERS")


@query
def q46_tree_balance(spark: SparkSession, directory: str) -> DataFrame:
    """A leaf's probability is its share, so over all leaves they add up to the class."""
    return _stayers_expected(spark, directory, churn.fit_decision_tree)


@query
def q46_logistic_balance(spark: SparkSession, directory: str) -> DataFrame:
    """Where the likelihood is largest, probabilities add up to the class."""
    return _stayers_expected(spark, directory, churn.fit_logistic)


def _ruled(spark: SparkSession, directory: str) -> DataFrame:
    """Customers with a label that a rule decides."""
    ruled = F.col("segment").isin(*RULE_SEGMENTS).cast("int")
    return checkpointed(_churn_set(spark, directory).withColumn("CHURN", ruled))


@query
def q46_complexity_table(spark: SparkSession, directory: str) -> DataFrame:
    """Complexity, splits and errors, cross-validated too, of the pruned churn tree."""
    return trees.complexity_table(_split(spark, directory).where("IS_TRAIN"))


@query
def q46_rule_complexity_table(spark: SparkSession, directory: str) -> DataFrame:
    """The same for a label that one split decides."""
    return rounded(trees.complexity_table(_ruled(spark, directory)), 9, "XERROR", "XSTD")


@query
def q46_tree_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """Every node of the churn tree with its rows and its rule."""
    nodes = trees.node_table(churn.fit_decision_tree(_split(spark, directory).where("IS_TRAIN")))
    return joined_items(nodes, "LEVELS")


@query
def q46_rule_tree_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """The same for a label that one split decides."""
    nodes = trees.node_table(churn.fit_decision_tree(_ruled(spark, directory)))
    return joined_items(nodes, "LEVELS").select("NODE", "PARENT", "DEPTH", "N_0", "N_1", "PREDICTED", "LEVELS", "RULE")


@query
def q46_left_out_error(spark: SparkSession, directory: str) -> DataFrame:
    """Confusion and error of 100 trees on the rows that their ten bags leave out."""
    votes = trees.left_out_votes(_split(spark, directory).where("IS_TRAIN"), bags=10)
    return trees.left_out_error(votes)


@query
def q46_rule_left_out_error(spark: SparkSession, directory: str) -> DataFrame:
    """The same for 50 trees in 25 bags, on a label that any tree learns without a mistake."""
    votes = trees.left_out_votes(_ruled(spark, directory), trees=50, bags=25)
    return as_long(trees.left_out_error(votes), "CHURN")


@query
def q46_separated_terms(spark: SparkSession, directory: str) -> DataFrame:
    """Terms of the logistic model that decide the label alone."""
    return as_long(churn.separated_terms(_churn_set(spark, directory)), "CLASS")


@query
def q46_prior_separated_terms(spark: SparkSession, directory: str) -> DataFrame:
    """The same where the features end before the label's window."""
    return as_long(churn.separated_terms(_prior_churn_set(spark, directory)), "CLASS")


@query
def q46_score_table(spark: SparkSession, directory: str) -> DataFrame:
    """One row per customer with the class each model predicts, on a label that a rule decides."""
    ruled = F.col("segment").isin(*RULE_SEGMENTS).cast("int")
    labelled = checkpointed(_churn_set(spark, directory).withColumn("CHURN", ruled))
    fits = {
        "tree": churn.fit_decision_tree,
        "forest": churn.fit_random_forest,
        "logistic": churn.fit_logistic,
    }
    scored = {n: churn.predict(fit(labelled), labelled, n) for n, fit in fits.items()}
    return evaluation.score_table(scored, "PREDICTED", "ID_CLI", "CHURN")


@query
def q46_importances(spark: SparkSession, directory: str) -> DataFrame:
    """Importance of each feature in the tree and in the forest."""
    train = _split(spark, directory).where("IS_TRAIN")
    return distribution.union_all(
        *[
            churn.importance_table(train, fit(train)).withColumn("MODEL", F.lit(name))
            for name, fit in {
                "tree": churn.fit_decision_tree,
                "forest": churn.fit_random_forest,
            }.items()
        ]
    )


@query
def q46_tree_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """Leaves and errors of trees cut at growing depths."""
    split = _split(spark, directory)
    return churn.tree_sizes(split.where("IS_TRAIN"), split.where("NOT IS_TRAIN"), (1, 2, 4, 8, 30))


@query
def q46_resampled_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    """Accuracy of the logistic model on the rows that each of five resamples leaves out."""
    return churn.resampled_accuracy(_split(spark, directory).where("IS_TRAIN"), 5)


@query
def q48_model_gain_lift(spark: SparkSession, directory: str) -> DataFrame:
    """Customers who stay, found by the probability each model gives them to stay."""
    predictions = _predictions(spark, directory, "tree", "forest", "logistic")
    return distribution.union_all(
        *[
            evaluation.gain_lift(scored, "P_STAY", "CHURN", positive=0).withColumn(
                "MODEL", F.lit(name)
            )
            for name, scored in predictions.items()
        ]
    )


@query
def q49_model_auc(spark: SparkSession, directory: str) -> DataFrame:
    """On predicted classes, for the forest and the tree."""
    predictions = _predictions(spark, directory, "forest", "tree")
    return distribution.union_all(
        *[
            evaluation.auc(scored, "PREDICTED", "CHURN").withColumn("MODEL", F.lit(name))
            for name, scored in predictions.items()
        ]
    )


def _rule_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """Customers with plain rules in the place of a model: who buys often, or for much, stays.

    Both engines compute these scores alike, so the measures built on them compare by value.
    """
    return _churn_set(spark, directory).select(
        "CHURN",
        "transaction_count",
        F.round("amount", 2).alias("amount"),
        (F.col("transaction_count") < 40).cast("int").alias("BY_FREQUENCY"),
        (F.round("amount", 2) < 5000).cast("int").alias("BY_AMOUNT"),
    )


@query
def q47_confusion_matrix(spark: SparkSession, directory: str) -> DataFrame:
    matrix = evaluation.confusion_matrix(
        _rule_predictions(spark, directory), "BY_FREQUENCY", "CHURN"
    )
    return rounded(matrix, 10, "KAPPA")


@query
def q47_accuracy_table(spark: SparkSession, directory: str) -> DataFrame:
    predictions = _rule_predictions(spark, directory)
    said = {
        "frequency": predictions.select("CHURN", F.col("BY_FREQUENCY").alias("SAID")),
        "amount": predictions.select("CHURN", F.col("BY_AMOUNT").alias("SAID")),
    }
    return evaluation.accuracy_table(said, "SAID", "CHURN")


def _gain_lift(spark: SparkSession, directory: str, score: str) -> DataFrame:
    table = evaluation.gain_lift(_rule_predictions(spark, directory), score, "CHURN", positive=0)
    return rounded(table, 9, "GAIN", "LIFT", "SCORE_POINT")


@query
def q48_gain_lift_by_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return _gain_lift(spark, directory, "transaction_count")


@query
def q48_gain_lift_by_amount(spark: SparkSession, directory: str) -> DataFrame:
    return _gain_lift(spark, directory, "amount")


@query
def q49_roc_points(spark: SparkSession, directory: str) -> DataFrame:
    predictions = _rule_predictions(spark, directory)
    return evaluation.roc_points(predictions, "transaction_count", "CHURN", positive=0)


@query
def q49_auc(spark: SparkSession, directory: str) -> DataFrame:
    predictions = _rule_predictions(spark, directory)
    area = evaluation.auc(predictions, "transaction_count", "CHURN", positive=0)
    return rounded(area, 10, "AUC")


@query
def q49_auc_of_classes(spark: SparkSession, directory: str) -> DataFrame:
    """On predicted classes, as for the chosen model: three points, the mean of two rates."""
    area = evaluation.auc(_rule_predictions(spark, directory), "BY_FREQUENCY", "CHURN")
    return rounded(area, 10, "AUC")


# ---- baskets ----


@query
def q50_baskets(spark: SparkSession, directory: str) -> DataFrame:
    return joined_items(baskets.baskets(views.ticket(spark, directory)), "items")


@query
def q50_basket_sizes(spark: SparkSession, directory: str) -> DataFrame:
    return baskets.basket_sizes(baskets.basket_items(views.ticket(spark, directory)))


def _rules(spark: SparkSession, directory: str) -> DataFrame:
    pairs = baskets.basket_items(views.ticket(spark, directory, items=True), RULE_ITEM)
    rules = baskets.association_rules(
        baskets.minable_baskets(pairs, RULE_SUPPORT), RULE_SUPPORT, RULE_CONFIDENCE
    )
    return joined_items(rules, "antecedent", "consequent")


@query
def q51_association_rules(spark: SparkSession, directory: str) -> DataFrame:
    measures = ["support", "confidence", "coverage", "lift"]
    return rounded(_rules(spark, directory), 8, *measures)


@query
def q51_article_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Rules between two articles."""
    pairs = baskets.basket_items(views.ticket(spark, directory))
    rules = baskets.association_rules(
        baskets.minable_baskets(pairs, ARTICLE_SUPPORT),
        ARTICLE_SUPPORT,
        ARTICLE_CONFIDENCE,
        max_length=2,
    )
    found = joined_items(rules.where("size(antecedent) > 0"), "antecedent", "consequent")
    return rounded(found, 8, "support", "confidence", "coverage", "lift")


@query
def q51_triple_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Rules of up to three articles, from a search that goes no further."""
    pairs = baskets.basket_items(views.ticket(spark, directory))
    rules = baskets.bounded_rules(pairs, TRIPLE_SUPPORT, TRIPLE_CONFIDENCE, max_length=3)
    found = joined_items(rules, "antecedent", "consequent")
    return rounded(found, 8, "support", "confidence", "coverage", "lift")


@query
def q51_minable_baskets(spark: SparkSession, directory: str) -> DataFrame:
    """Baskets without their rare articles."""
    pairs = baskets.basket_items(views.ticket(spark, directory))
    return joined_items(baskets.minable_baskets(pairs, FREQUENT_ARTICLE), "items")


@query
def q52_rule_count(spark: SparkSession, directory: str) -> DataFrame:
    return baskets.rule_count(_rules(spark, directory))


@query
def q52_top_rules(spark: SparkSession, directory: str) -> DataFrame:
    measures = ["support", "confidence", "coverage", "lift"]
    return baskets.top_rules(rounded(_rules(spark, directory), 8, *measures))


@query
def q53_item_frequency(spark: SparkSession, directory: str) -> DataFrame:
    pairs = baskets.basket_items(views.ticket(spark, directory))
    return baskets.item_frequency(pairs, 0.001)
