"""Email campaigns: the send / open / click / fail funnel and its rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nulls import n_distinct, null_safe_join
from tessera.operators.distribution import cumulative_share, share_of_overall, share_of_parent

MESSAGE = ["ID_CLI", "ID_CAMP", "ID_DELIVERY"]
EVENTS_AND_CLIENTS = {"EVENTs": "ID_EVENT_S", "CLIs": "ID_CLI"}


def recode_failures(events: DataFrame) -> DataFrame:
    """Errors and bounces are one event type, failure."""
    kind = F.col("TYP_EVENT")
    return events.withColumn(
        "TYP_EVENT", F.when(kind.isin("E", "B"), F.lit("F")).otherwise(kind)
    )


def _reactions(events: DataFrame, strict_na: bool) -> DataFrame:
    """First open, click and failure date and the number of opens and clicks per message."""
    # repeated rows of an event collapse first; both steps combine rows before their shuffle, so
    # a message that drew very many events does not end up in one task
    single = (
        recode_failures(events.where(F.col("TYP_EVENT").isin("V", "C", "E", "B", "F")))
        .groupBy(*MESSAGE, "TYP_EVENT", "ID_EVENT")
        .agg(
            F.min("EVENT_DATETIME").alias("AT"),
            F.count_if(F.col("EVENT_DATETIME").isNull()).alias("UNTIMED"),
        )
    )

    def kind(code: str):
        return F.col("TYP_EVENT") == code

    def first_at(code: str):
        earliest = F.min(F.when(kind(code), F.col("AT")))
        if strict_na:
            untimed = F.coalesce(F.sum(F.when(kind(code), F.col("UNTIMED"))), F.lit(0))
            return F.when(untimed == 0, earliest)
        return earliest

    found = single.groupBy(*MESSAGE).agg(
        first_at("V").alias("OPEN_AT"),
        F.count_if(kind("V")).alias("N_OPENS"),
        first_at("C").alias("CLICK_AT"),
        F.count_if(kind("C")).alias("N_CLICKS"),
        first_at("F").alias("FAIL_AT"),
    )
    opened, clicked = F.col("OPEN_AT").isNotNull(), F.col("CLICK_AT").isNotNull()
    return found.select(
        *MESSAGE,
        F.to_date("OPEN_AT").alias("OPEN_DATE"),
        F.when(opened, F.col("N_OPENS")).alias("NUM_OPENs"),
        F.to_date("CLICK_AT").alias("CLICK_DATE"),
        F.when(clicked, F.col("N_CLICKS")).alias("NUM_CLICKs"),
        F.to_date("FAIL_AT").alias("FAIL_DATE"),
    )


def email_funnel(events: DataFrame, campaigns: DataFrame, strict_na: bool = False) -> DataFrame:
    """One row per send with the first reaction of each kind to the same message.

    Dates, not times, are compared. A send is dropped when the first open or failure is dated
    before it, and when there is a click that no open on the same day or earlier explains. Several
    sends of one message get the same reactions. ``campaigns`` holds one row per ID_CAMP (see
    ``key_check``). With ``strict_na`` one event without a time voids its kind for the message.
    """
    # both branches filter on the type as stored, so the filter reaches the file scan
    sends = events.where("TYP_EVENT = 'S'").select(
        F.col("ID_EVENT").alias("ID_EVENT_S"),
        *MESSAGE,
        F.to_date("EVENT_DATETIME").alias("SEND_DATE"),
    )
    types = campaigns.select("ID_CAMP", "TYP_CAMP")
    with_reactions = null_safe_join(sends, _reactions(events, strict_na), MESSAGE, "left")
    kept = with_reactions.where(
        (F.col("OPEN_DATE").isNull() | (F.col("SEND_DATE") <= F.col("OPEN_DATE")))
        & (F.col("CLICK_DATE").isNull() | (F.col("OPEN_DATE") <= F.col("CLICK_DATE")))
        & (F.col("FAIL_DATE").isNull() | (F.col("SEND_DATE") <= F.col("FAIL_DATE")))
    )
    return null_safe_join(kept, types, ["ID_CAMP"], "left").select(
        "ID_EVENT_S",
        "ID_CLI",
        "ID_CAMP",
        "TYP_CAMP",
        "ID_DELIVERY",
        "SEND_DATE",
        F.col("OPEN_DATE").isNotNull().alias("OPENED"),
        "OPEN_DATE",
        F.date_diff("OPEN_DATE", "SEND_DATE").alias("DAYS_TO_OPEN"),
        "NUM_OPENs",
        F.col("CLICK_DATE").isNotNull().alias("CLICKED"),
        "CLICK_DATE",
        "NUM_CLICKs",
        F.col("FAIL_DATE").isNotNull().alias("FAILED"),
    )


def campaign_overview(funnel: DataFrame, all_label: str = "ALL") -> DataFrame:
    """First and last send date, sends and customers, overall and per campaign type."""
    return (
        funnel.rollup("TYP_CAMP")
        .agg(
            F.grouping("TYP_CAMP").alias("IS_TOTAL"),
            F.min("SEND_DATE").alias("MIN_DATE"),
            F.max("SEND_DATE").alias("MAX_DATE"),
            n_distinct("ID_EVENT_S").alias("TOT_EVENTs"),
            n_distinct("ID_CLI").alias("TOT_CLIs"),
        )
        .withColumn(
            "TYP_CAMP", F.when(F.col("IS_TOTAL") == 1, all_label).otherwise(F.col("TYP_CAMP"))
        )
        .drop("IS_TOTAL")
    )


def outcome_rate(funnel: DataFrame, flag: str, by_type: bool = False) -> DataFrame:
    """Sends and customers per outcome (OPENED, CLICKED or FAILED), with their shares.

    Shares are of all sends and customers, or of those of the same campaign type.
    """
    if by_type:
        return share_of_parent(funnel, "TYP_CAMP", flag, EVENTS_AND_CLIENTS)
    return share_of_overall(funnel, [flag], EVENTS_AND_CLIENTS).withColumn(
        "TYP_CAMP", F.lit("ALL")
    )


def customer_value_distribution(
    funnel: DataFrame, flag: str, value: str, name: str, aggregate: str = "mean"
) -> DataFrame:
    """Customers per rounded-down mean (or sum) of a value over their flagged sends."""
    combine = {"mean": F.avg, "sum": F.sum}[aggregate]
    per_customer = (
        funnel.where(F.col(flag))
        .groupBy("ID_CLI")
        .agg(F.floor(combine(value)).cast("long").alias(name))
    )
    return per_customer.groupBy(name).agg(n_distinct("ID_CLI").alias("TOT_CLIs"))


def days_to_open_distribution(funnel: DataFrame) -> DataFrame:
    return customer_value_distribution(funnel, "OPENED", "DAYS_TO_OPEN", "AVG_DAYS_TO_OPEN")


def days_to_open_curve(funnel: DataFrame, before_days: int | None = None) -> DataFrame:
    """Running share of customers by days to open; the cut is applied after the shares."""
    curve = cumulative_share(
        days_to_open_distribution(funnel), ["AVG_DAYS_TO_OPEN"], "TOT_CLIs"
    )
    return curve if before_days is None else curve.where(F.col("AVG_DAYS_TO_OPEN") < before_days)


def opens_per_customer(funnel: DataFrame, aggregate: str = "mean") -> DataFrame:
    return customer_value_distribution(funnel, "OPENED", "NUM_OPENs", "AVG_OPENs", aggregate)


def clicks_per_customer(funnel: DataFrame, aggregate: str = "sum") -> DataFrame:
    """Named an average, summed by default; pass ``aggregate="mean"`` for the average."""
    return customer_value_distribution(funnel, "CLICKED", "NUM_CLICKs", "AVG_CLICKs", aggregate)
