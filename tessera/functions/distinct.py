"""Distinct counts of several columns at several grains from one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, keys: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """Distinct (keys, id) rows for each counted column, marked by WHICH column it is.

    Each task drops its own repeats before the shuffle, and as the ids are part of the shuffle key
    a frequent group spreads over all tasks. A NULL id is an id.
    """
    return marked_ids(df, keys, counts).distinct()


def marked_ids(df: DataFrame, keys: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """A row per row and counted column: the keys, WHICH column it is, and its id."""
    columns = list(counts.values())
    types = {c: df.schema[c].dataType for c in columns}
    marked = [
        F.struct(
            F.lit(i).alias("WHICH"),
            *[
                (F.col(c) if i == j else F.lit(None).cast(types[c])).alias(f"ID_{j}")
                for j, c in enumerate(columns)
            ],
        )
        for i in range(len(columns))
    ]
    return df.select(*keys, F.inline(F.array(*marked)))


def count_ids(ids: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Ids per group, one column per name in the order of the counted columns."""
    return ids.groupBy(*by).agg(
        *[F.expr(f"count_if(WHICH = {i})").alias(name) for i, name in enumerate(names)]
    )


def counts_at_two_grains(
    df: DataFrame, fine: Sequence[str], coarse: Sequence[str], counts: dict[str, str], names: Sequence[str]
) -> DataFrame:
    """Ids per ``fine`` keys and, in rows with GRAIN above 0, per ``coarse`` keys.

    Distinct counts do not add up, so both are counted, from one scan and one shuffle of the ids:
    each marked row stands for both grains, and repeats are dropped before the shuffle.
    """
    marked = marked_ids(df, fine, counts)
    ids = [c for c in marked.columns if c not in fine]
    sets = [[F.col(c) for c in [*keys, *ids]] for keys in (fine, coarse)]
    distinct = marked.groupingSets(sets, *fine, *ids).agg(F.grouping_id().alias("GRAIN"))
    return count_ids(distinct, [*fine, "GRAIN"], names)
