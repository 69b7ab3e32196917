"""Distributions, shares and histograms.

Totals are scalar subqueries over the already aggregated frame. Spark computes that frame once
and reuses its shuffle for the total, so no group is moved to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distinct import counts_at_two_grains
from tessera.functions.nulls import ColumnLike, as_column, n_distinct, null_safe_join
from tessera.functions.ordered import running_total
from tessera.functions.sketches import distinct_estimates, distinct_states, merged_distinct_states


def with_share(counts: DataFrame, count: str, share: str = "PERCENT") -> DataFrame:
    """Add each row's share of the column total."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.try_divide(count, total))


def distribution(
    df: DataFrame,
    by: ColumnLike,
    id_column: str = "ID_CLI",
    count: str = "TOT_CLIs",
    name: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """Distinct ids per level, with the share of the sum of these counts, largest first."""
    level = as_column(by) if name is None else as_column(by).alias(name)
    counts = df.groupBy(level).agg(n_distinct(F.col(id_column), approx).alias(count))
    level_name = counts.columns[0]
    return with_share(counts, count).orderBy(F.desc("PERCENT"), F.asc_nulls_last(level_name))


def share_of_overall(
    df: DataFrame, by: Sequence[str], counts: dict[str, str], approx: bool = False
) -> DataFrame:
    """Distinct counts per group over the overall distinct counts.

    ``counts`` maps a suffix to the counted column: ``{"CLIs": "ID_CLI"}`` gives ``TOT_CLIs``
    and ``PERCENT_CLIs``. An id in several groups counts in each, so shares need not sum to 1.
    """
    names = [f"TOT_{n}" for n in counts]
    if approx:
        states = distinct_states(df, by, {f"TOT_{n}": c for n, c in counts.items()})
        groups = distinct_estimates(states, names)
        # the overall counts come from the merged states of the groups
        overall = distinct_estimates(merged_distinct_states(states, [], names), names)
        totals = {n: overall.select(n).scalar() for n in names}
    else:
        both = counts_at_two_grains(df, by, [], counts, names)
        groups = both.where("GRAIN = 0").drop("GRAIN")
        # the overall counts are the one row of the other grain
        totals = {n: both.agg(F.max(F.when(F.col("GRAIN") > 0, F.col(n)))).scalar() for n in names}
    return groups.withColumns(
        {f"PERCENT_{n}": F.try_divide(f"TOT_{n}", totals[f"TOT_{n}"]) for n in counts}
    )


def share_of_parent(
    df: DataFrame, parent: str, child: str, counts: dict[str, str], approx: bool = False
) -> DataFrame:
    """Distinct counts per (parent, child) over the parent's own distinct counts."""
    names = [f"TOT_{n}" for n in counts]
    if approx:
        states = distinct_states(df, [parent, child], {f"TOT_{n}": c for n, c in counts.items()})
        totals = distinct_estimates(merged_distinct_states(states, [parent], names), names)
        children = distinct_estimates(states, names)
        totals = totals.withColumnsRenamed({n: f"ALL_{n}" for n in names})
        children = null_safe_join(children, totals, [parent], "left")
    else:
        both = counts_at_two_grains(df, [parent, child], [parent], counts, names)
        # a parent's window holds its children and itself
        whole = Window.partitionBy(parent)
        children = both.withColumns(
            {f"ALL_{n}": F.max(F.when(F.col("GRAIN") > 0, F.col(n))).over(whole) for n in names}
        )
        children = children.where("GRAIN = 0").drop("GRAIN")
    return children.withColumns(
        {f"PERCENT_{n}": F.try_divide(f"TOT_{n}", f"ALL_TOT_{n}") for n in counts}
    ).drop(*[f"ALL_{n}" for n in names])


def share_within(counts: DataFrame, within: str, count: str, share: str = "SHARE") -> DataFrame:
    """Share of each row in its ``within`` group: the heights of a filled stacked bar."""
    return counts.withColumn(
        share, F.try_divide(count, F.sum(count).over(Window.partitionBy(within)))
    )


def cumulative_share(
    counts: DataFrame, order: Sequence[str], count: str, share: str = "PERCENT_COVERED"
) -> DataFrame:
    """Running share of the total, row by row in ``order`` (as in ``running_total``)."""
    summed = running_total(counts, order, {"__running": count})
    return summed.withColumn(share, F.try_divide("__running", "__running_ALL")).drop(
        "__running", "__running_ALL"
    )


def level_coverage(
    df: DataFrame, column: str, id_column: str = "ID_CLI", missing: str = "(missing)"
) -> DataFrame:
    """Levels of a column, most frequent first (ties by name), with count, share, running share."""
    filled = df.withColumn(column, F.coalesce(column, F.lit(missing)))
    counts = filled.groupBy(column).agg(n_distinct(F.col(id_column)).alias("TOT_CLIs"))
    order = ["TOT_CLIs DESC", column]
    summed = running_total(counts, order, {"__running": "TOT_CLIs"})
    return summed.withColumns(
        {
            "PERCENT": F.try_divide("TOT_CLIs", "__running_ALL"),
            "PERCENT_COVERED": F.try_divide("__running", "__running_ALL"),
        }
    ).drop("__running", "__running_ALL")


def bucket_levels(
    coverage_table: DataFrame,
    column: str,
    coverage: float = 0.85,
    keep: str = "(missing)",
    other: str = "others",
    strict: bool = False,
) -> DataFrame:
    """Add ``<column>_CLEAN``: the levels that reach the coverage by name, the rest as ``other``.

    Kept are the levels up to and including the one that reaches ``coverage``. ``strict`` applies
    the comparison literally: a level is kept below the coverage, or above it when the level before
    is below; so one that meets it exactly is not kept, and a first level that is already above
    has no level before it and gets NULL.
    """
    # exact at the edge: running shares are ratios of counts, compared after the same rounding
    running = F.round("PERCENT_COVERED", 12)
    before = F.round(F.col("PERCENT_COVERED") - F.col("PERCENT"), 12)
    is_first = before <= 0
    kept = F.col(column) == keep
    if strict:
        crosses = F.when(~is_first, before < coverage)
        inside = (running < coverage) | ((running > coverage) & crosses)
        clean = F.when(kept | inside, F.col(column)).when(~(kept | inside), F.lit(other))
    else:
        clean = F.when(kept | (before < coverage), F.col(column)).otherwise(F.lit(other))
    return coverage_table.withColumn(f"{column}_CLEAN", clean)


def bucket_top_coverage(
    df: DataFrame,
    column: str,
    id_column: str = "ID_CLI",
    coverage: float = 0.85,
    keep: str = "(missing)",
    other: str = "others",
    strict: bool = False,
) -> DataFrame:
    """Replace the column by its bucketed form; NULL becomes the always kept ``keep`` level."""
    levels = bucket_levels(
        level_coverage(df, column, id_column, keep), column, coverage, keep, other, strict
    ).select(column, f"{column}_CLEAN")
    filled = df.withColumn(column, F.coalesce(column, F.lit(keep)))
    return filled.join(levels, column, "left").drop(column)


def merge_levels(
    df: DataFrame, column: str, source: str, into: str, missing: str = "(missing)"
) -> DataFrame:
    """Recode one level as another before counting; NULL is the level ``missing``."""
    filled = F.coalesce(F.col(column), F.lit(missing))
    return df.withColumn(column, F.when(filled == source, F.lit(into)).otherwise(filled))


def declared_distribution(
    df: DataFrame, column: str, undeclared: str, id_column: str = "ID_CLI"
) -> DataFrame:
    """Distribution over the declared levels only."""
    return distribution(df.where(F.col(column) != undeclared), column, id_column)


def histogram(
    df: DataFrame,
    value: str,
    width: float,
    by: Sequence[str] = (),
    center: float = 0.0,
    closed: str = "right",
) -> DataFrame:
    """Rows per bin of fixed width; a bin is centred on ``center`` plus a multiple of ``width``.

    ``closed`` names the edge that belongs to the bin. For edges on the multiples themselves pass
    ``center=width / 2``.
    """
    offset = (F.col(value) - F.lit(center)) / F.lit(float(width))
    index = F.ceil(offset - 0.5) if closed == "right" else F.floor(offset + 0.5)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, index.cast("long").alias("BIN"))
        .agg(F.count(F.lit(1)).alias("N"))
        .withColumn("BIN_CENTER", F.col("BIN") * F.lit(float(width)) + F.lit(float(center)))
    )


def histogram_by_bins(
    df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per bin when only the number of bins is given.

    The range of all rows is covered by bins centred on the minimum, ..., the maximum; bin 0 is
    the first one. Upper edges belong to the bin.
    """
    low = df.agg(F.min(value)).scalar()
    width = df.agg((F.max(value) - F.min(value)) / F.lit(bins - 1)).scalar()
    offset = F.try_divide(F.col(value) - low, width)
    index = F.coalesce(F.greatest(F.ceil(F.round(offset - 0.5, 9)), F.lit(0)), F.lit(0))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, index.cast("long").alias("BIN"))
        .agg(F.count(F.lit(1)).alias("N"))
        .withColumn("BIN_CENTER", low + F.col("BIN") * width)
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column absent from one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

