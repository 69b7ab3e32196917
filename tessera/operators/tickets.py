"""Purchase tickets: overview, amounts, popularity and the re-purchase curve.

Input is at line grain; a purchase line has DIREZIONE 1, any other value is a refund.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.nulls import n_distinct
from tessera.operators.distribution import share_of_overall, share_of_parent, with_share

TICKETS_AND_CLIENTS = {"TICs": "ID_SCONTRINO", "CLIs": "ID_CLI"}
PURCHASE = 1


def ticket_overview(tickets: DataFrame) -> DataFrame:
    """First and last date, tickets and customers."""
    return tickets.agg(
        F.min("TIC_DATE").alias("MIN_DATE"),
        F.max("TIC_DATE").alias("MAX_DATE"),
        n_distinct("ID_SCONTRINO").alias("TOT_TICs"),
        n_distinct("ID_CLI").alias("TOT_CLIs"),
    )


def direction_shares(tickets: DataFrame) -> DataFrame:
    """Tickets and customers per direction, over all tickets and customers."""
    return share_of_overall(tickets, ["DIREZIONE"], TICKETS_AND_CLIENTS)


def share_by_direction(tickets: DataFrame, by: str) -> DataFrame:
    """Tickets and customers per (direction, ``by``), over those of the direction."""
    return share_of_parent(tickets, "DIREZIONE", by, TICKETS_AND_CLIENTS)


def amount_totals(tickets: DataFrame, entity: str) -> DataFrame:
    """Gross amount and discount per (entity, direction)."""
    return tickets.groupBy(entity, "DIREZIONE").agg(
        F.sum("IMPORTO_LORDO").alias("IMPORTO_LORDO"), F.sum("SCONTO").alias("SCONTO")
    )


def average_amounts(tickets: DataFrame, entity: str) -> DataFrame:
    """Mean over entities (ticket, department or customer) of their totals, per direction."""
    return (
        amount_totals(tickets, entity)
        .groupBy("DIREZIONE")
        .agg(
            F.avg("IMPORTO_LORDO").alias("AVG_IMPORTO_LORDO"), F.avg("SCONTO").alias("AVG_SCONTO")
        )
    )


def tickets_per_article(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("ID_ARTICOLO").agg(n_distinct("ID_SCONTRINO").alias("NUM_TICs"))


def article_popularity(tickets: DataFrame, below: int | None = None) -> DataFrame:
    """Articles per number of tickets they occur in; ``below`` cuts the view, not the counts."""
    counts = (
        tickets_per_article(tickets)
        .groupBy("NUM_TICs")
        .agg(F.count(F.lit(1)).alias("COUNT_ART"))
    )
    return counts if below is None else counts.where(F.col("NUM_TICs") < below)


def purchases(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("DIREZIONE") == PURCHASE)


def purchases_per_customer(tickets: DataFrame) -> DataFrame:
    """Distinct purchase tickets per customer, most first."""
    return (
        purchases(tickets)
        .groupBy("ID_CLI")
        .agg(n_distinct("ID_SCONTRINO").alias("TOT_PURCHASE"))
        .orderBy(F.desc("TOT_PURCHASE"), F.asc_nulls_last("ID_CLI"))
    )


def next_purchase_gaps(tickets: DataFrame, grain: str = "line") -> DataFrame:
    """Frequency of each gap in days between consecutive purchases of a customer.

    ``grain`` says what counts as a purchase: every ticket line, or every ticket. Purchases are
    first counted per customer and day: all but one on a day have gap 0, and only the days are
    ordered, so a customer's window holds at most one row per calendar day.
    """
    n_purchases = {
        "line": F.count(F.lit(1)),
        "ticket": n_distinct("ID_SCONTRINO"),
    }[grain]
    days = (
        purchases(tickets)
        .where(F.col("TIC_DATE").isNotNull())
        .groupBy("ID_CLI", "TIC_DATE")
        .agg(n_purchases.alias("N"))
    )
    previous = F.lag("TIC_DATE").over(Window.partitionBy("ID_CLI").orderBy("TIC_DATE"))
    to_previous = F.date_diff("TIC_DATE", previous)
    gaps = F.array(
        F.struct(to_previous.alias("DAYS_DIFF"), F.lit(1).cast("long").alias("FREQ")),
        F.struct(F.lit(0).alias("DAYS_DIFF"), (F.col("N") - 1).alias("FREQ")),
    )
    return (
        days.select(gaps.alias("GAPS"))
        .select(F.inline("GAPS"))
        .where("DAYS_DIFF IS NOT NULL AND FREQ > 0")
        .groupBy("DAYS_DIFF")
        .agg(F.sum("FREQ").alias("FREQ"))
    )


def next_purchase_curve(tickets: DataFrame, grain: str = "line") -> DataFrame:
    """Share of each gap after leaving out the smallest one (0 days, the same visit)."""
    gaps = next_purchase_gaps(tickets, grain)
    smallest = gaps.agg(F.min("DAYS_DIFF")).scalar()
    return with_share(gaps.where(F.col("DAYS_DIFF") > smallest), "FREQ", "PERC")
