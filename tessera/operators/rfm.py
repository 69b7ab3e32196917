"""Recency, frequency and monetary scoring of customers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.materialize import checkpointed
from tessera.functions.nulls import n_distinct
from tessera.functions.ordered import approx_value_summary, value_summary


class SegmentRule(NamedTuple):
    """A segment with inclusive bounds on the three scores."""

    segment: str
    recency: tuple[int, int]
    frequency: tuple[int, int]
    monetary: tuple[int, int]


# The ten segments in order of priority. Some boxes overlap.
SEGMENT_RULES = (
    SegmentRule("Champions", (4, 5), (4, 5), (4, 5)),
    SegmentRule("Loyal Customers", (2, 5), (3, 5), (3, 5)),
    SegmentRule("Potential Loyalist", (3, 5), (1, 3), (1, 3)),
    SegmentRule("New Customers", (4, 5), (1, 1), (1, 1)),
    SegmentRule("Promising", (3, 4), (1, 1), (1, 1)),
    SegmentRule("Need Attention", (2, 3), (2, 3), (2, 3)),
    SegmentRule("About To Sleep", (2, 3), (1, 2), (1, 2)),
    SegmentRule("At Risk", (1, 2), (2, 5), (2, 5)),
    SegmentRule("Can't Lose Them", (1, 1), (4, 5), (4, 5)),
    SegmentRule("Lost", (1, 2), (1, 2), (1, 2)),
)


# Cells of a score grid that are broadcast, at most.
BROADCAST_CELLS = 1 << 16


def segment_rules_table(
    spark: SparkSession, rules: Sequence[SegmentRule] = SEGMENT_RULES
) -> DataFrame:
    """The rules as rows, for reports."""
    return spark.createDataFrame(
        [(i, r.segment, *r.recency, *r.frequency, *r.monetary) for i, r in enumerate(rules, 1)],
        "priority int, segment string, recency_lower int, recency_upper int,"
        " frequency_lower int, frequency_upper int, monetary_lower int, monetary_upper int",
    )


def rfm_customer_table(
    tickets: DataFrame,
    end_date: str = "2019-12-31",
    frequency: str = "lines",
    active: Column | None = None,
) -> DataFrame:
    """Orders, revenue and days since the last line, per customer with positive revenue.

    ``frequency="lines"`` counts ticket lines as orders, ``"tickets"`` distinct tickets. Refund
    lines count too, in all three measures. With ``active``, a condition on lines, the same pass
    adds CHURN: 0 for customers with a line that meets it, else 1.
    """
    flags = [] if active is None else [F.when(F.max(active), 0).otherwise(1).alias("CHURN")]
    orders = {"lines": F.count(F.lit(1)), "tickets": n_distinct("ID_SCONTRINO")}[frequency]
    return (
        tickets.groupBy(F.col("ID_CLI").alias("customer_id"))
        .agg(
            orders.alias("number_of_orders"),
            F.sum("IMPORTO_LORDO").alias("revenue"),
            F.max("TIC_DATE").alias("last_buy"),
            *flags,
        )
        .where("revenue > 0")
        .select(
            "customer_id",
            "number_of_orders",
            "revenue",
            F.date_diff(F.lit(end_date).cast("date"), "last_buy").alias("recency_days"),
            "last_buy",
            *(["CHURN"] if flags else []),
        )
    )


def score_edges(
    customers: DataFrame, columns: Sequence[str], bins: int = 5, approx: bool = False
) -> DataFrame:
    """One row with, per column, the array of its ``bins - 1`` inner quantile edges."""
    names = [f"Q{i}" for i in range(1, bins)]
    points = {name: i / bins for i, name in enumerate(names, 1)}
    summarise = approx_value_summary if approx else value_summary
    edges = F.filter(F.array(*[F.round(n, 6) for n in names]), lambda e: e.isNotNull())
    return summarise(customers, columns, points).agg(
        *[F.max(F.when(F.col("MEASURE") == c, edges)).alias(c) for c in columns]
    )


def rfm_score(customers: DataFrame, bins: int = 5, approx: bool = False) -> DataFrame:
    """Scores 1..bins from quantile edges; the most recent, frequent and valuable score highest.

    A bin includes its lower edge, the last one both. Equal values always share a score, so these
    are not equal-sized tiles. Input as from ``rfm_customer_table``; it is written once, since the
    edges and the scores read it. A column CHURN is kept.
    """
    once = checkpointed(customers)
    edges = score_edges(once, ["recency_days", "number_of_orders", "revenue"], bins, approx)

    def reached(column: str) -> Column:
        # sums of money carry rounding noise, so values and edges are compared at six decimals
        value, found = F.round(F.col(column).cast("double"), 6), edges.select(column).scalar()
        above = [(value >= F.get(found, F.lit(i))).cast("int") for i in range(bins - 1)]
        return reduce(add, [F.coalesce(a, F.lit(0)) for a in above])

    return once.select(
        "customer_id",
        "recency_days",
        F.col("number_of_orders").alias("transaction_count"),
        F.col("revenue").alias("amount"),
        (F.lit(bins) - reached("recency_days")).alias("recency_score"),
        (1 + reached("number_of_orders")).alias("frequency_score"),
        (1 + reached("revenue")).alias("monetary_score"),
        *[c for c in once.columns if c == "CHURN"],
    ).withColumn(
        "rfm_score", F.expr("100 * recency_score + 10 * frequency_score + monetary_score")
    )


def rule_cells(rules: DataFrame, bins: int = 5, on_overlap: str = "first") -> DataFrame:
    """(R, F, M, segment): the rule that decides each cell of scores 1..``bins`` that a box covers.

    ``rules`` has the columns of ``segment_rules_table``. A NULL bound leaves its side open, a box
    whose lower bound is above its upper one is empty, and a rule without priority takes no part.
    Of rules with one priority the first segment by name decides. Boxes are cut to the scores, so a
    rule stands for at most bins ** 3 cells, and tasks keep one rule per cell before the shuffle.
    """
    rank = {"first": F.col("priority"), "last": -F.col("priority")}[on_overlap]
    covered = rules.where("priority IS NOT NULL").select(rank.cast("long").alias("rank"), "segment", *[
        F.expr(
            f"CASE WHEN coalesce({score}_lower, 1) <= {bins} AND coalesce({score}_upper, {bins}) >= 1"
            f" AND coalesce({score}_lower, 1) <= coalesce({score}_upper, {bins}) THEN sequence("
            f"CAST(greatest(coalesce({score}_lower, 1), 1) AS INT), CAST(least(coalesce({score}_upper, {bins}), {bins}) AS INT)) END"
        ).alias(score)
        for score in ("recency", "frequency", "monetary")
    ])
    for score, name in (("recency", "R"), ("frequency", "F"), ("monetary", "M")):
        # exploding a missing sequence drops the rule
        covered = covered.withColumn(name, F.explode(score)).drop(score)
    decided = covered.groupBy("R", "F", "M").agg(F.min(F.struct("rank", "segment")).alias("rule"))
    return decided.select("R", "F", "M", "rule.segment")


def rfm_segment(
    scores: DataFrame,
    rules: Sequence[SegmentRule] | DataFrame = SEGMENT_RULES,
    on_overlap: str = "first",
    other: str = "Others",
    bins: int = 5,
) -> DataFrame:
    """Add the segment of the first (or last) matching rule.

    A short sequence of rules becomes a chain of conditions. Rules as a DataFrame, as many as there
    are, meet the scores, which run from 1 to ``bins``, as an equi-join on the cells they cover (see
    ``rule_cells``); a rule without a name gives ``other``.
    """
    if isinstance(rules, DataFrame):
        return _segment_by_cells(scores, rule_cells(rules, bins, on_overlap), other, bins)
    ordered = {"first": list(rules), "last": list(reversed(rules))}[on_overlap]
    segment = F.lit(other)
    for rule in reversed(ordered):
        matches = F.expr(
            " AND ".join(
                f"{score}_score BETWEEN {low} AND {high}"
                for score, (low, high) in [
                    ("recency", rule.recency),
                    ("frequency", rule.frequency),
                    ("monetary", rule.monetary),
                ]
            )
        )
        segment = F.when(matches, rule.segment).otherwise(segment)
    return scores.withColumn("segment", segment)


def _segment_by_cells(scores: DataFrame, cells: DataFrame, other: str, bins: int) -> DataFrame:
    names = {"R": "__recency", "F": "__frequency", "M": "__monetary", "segment": "__segment"}
    cells = cells.withColumnsRenamed(names)
    # a row per cell at most; finer scores are left to the optimizer
    cells = F.broadcast(cells) if bins**3 <= BROADCAST_CELLS else cells
    alike = [
        F.col(f"{score}_score") == F.col(f"__{score}") for score in ("recency", "frequency", "monetary")
    ]
    joined = scores.join(cells, reduce(and_, alike), "left")
    return joined.withColumn("segment", F.coalesce("__segment", F.lit(other))).drop(*names.values())


def segment_counts(segments: DataFrame) -> DataFrame:
    """Customers per segment, largest first."""
    return (
        segments.groupBy(F.col("segment").alias("Segment"))
        .agg(F.count(F.lit(1)).alias("Count"))
        .orderBy(F.desc("Count"), "Segment")
    )


def segment_medians(segments: DataFrame, approx: bool = False) -> DataFrame:
    """Median amount, transaction count and recency per segment."""
    measures = {
        "amount": "median_monetary",
        "transaction_count": "median_frequency",
        "recency_days": "median_recency",
    }
    half = {"MEDIAN": 0.5}
    summarise = approx_value_summary if approx else value_summary
    medians = summarise(segments, list(measures), half, ["segment"])
    return medians.groupBy("segment").agg(
        *[
            F.max(F.when(F.col("MEASURE") == measure, F.col("MEDIAN"))).alias(name)
            for measure, name in measures.items()
        ]
    )


def monetary_heatmap(scores: DataFrame) -> DataFrame:
    """Mean amount per frequency and recency score."""
    return scores.groupBy("frequency_score", "recency_score").agg(
        F.avg("amount").alias("monetary")
    )


def score_counts(scores: DataFrame) -> DataFrame:
    """Customers per frequency, recency and monetary score."""
    return scores.groupBy("frequency_score", "recency_score", "monetary_score").agg(
        F.count(F.lit(1)).alias("n")
    )


def order_distribution(scores: DataFrame) -> DataFrame:
    """Customers per transaction count."""
    return scores.groupBy("transaction_count").agg(F.count(F.lit(1)).alias("n"))
