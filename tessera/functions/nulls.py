"""Missing-value rules that differ from the Spark defaults."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(column: ColumnLike) -> Column:
    return F.col(column) if isinstance(column, str) else column


def n_distinct(column: ColumnLike, approx: bool = False) -> Column:
    """Distinct values of ``column`` where NULL counts as one value; 0 on empty input."""
    value = as_column(column)
    if approx:
        has_null = F.coalesce(F.max(value.isNull().cast("long")), F.lit(0))
        return F.approx_count_distinct(value) + has_null
    # the struct around a NULL is not NULL, so the count includes it
    return F.count_distinct(F.struct(value))


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on same-named keys in which a NULL key matches a NULL key.

    Columns other than the keys must not share names; rename them before the join.
    """
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides of the join: {sorted(clash)}")
    renamed = {key: f"__right_{key}" for key in on}
    condition = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(renamed[key])) for key in on]
    )
    joined = left.join(right.withColumnsRenamed(renamed), condition, how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        joined = joined.withColumns({key: F.coalesce(key, renamed[key]) for key in on})
    return joined.drop(*renamed.values())


def fill_levels(df: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Replace NULL in each named text column by the given level."""
    return df.fillna(levels)
