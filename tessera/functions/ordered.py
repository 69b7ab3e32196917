"""Running totals and exact quantiles without a one-partition window.

A window without ``partitionBy`` sends every row to one task. Here the rows are dealt into
stretches of the order, summed per stretch, and only those sums (one row per stretch) go through
an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.materialize import checkpointed
from tessera.functions.nulls import null_safe_join

_PART = "__part"
SKETCH_ACCURACY = 10000
# Half widths, as shares of the rows, of the intervals sketched around a quantile.
REACHES = (5 / SKETCH_ACCURACY, 0.01, 0.1)


def sorted_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sort and write ``df``; ``__part`` numbers the written partitions in that order."""
    return checkpointed(df.orderBy(*order)).withColumn(_PART, F.spark_partition_id())


def _sorting(order: Sequence[str]) -> list[Column]:
    """Sort columns of entries ``"column"`` or ``"column DESC"``; NULL comes last."""
    return [
        F.desc_nulls_last(o.removesuffix(" DESC")) if o.endswith(" DESC") else F.asc_nulls_last(o)
        for o in order
    ]


def running_total(df: DataFrame, order: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """Add ``{new column: summed column}`` running sums in the given total order.

    Each ``<new column>_ALL`` holds the sum over all rows. ``order`` names columns, followed by
    `` DESC`` for falling ones; NULL comes last. It must identify a row, so callers aggregate equal
    keys first: no value, however frequent, then fills more than one row.

    The rows are range-sorted and written once; a written partition is a stretch of the order, and
    there are as many as the size of the rows asks for, not as the session has shuffle partitions.
    Rows are summed by stretch. Only a row per stretch goes through an unpartitioned window, and
    the plan is the same for any number of them.
    """
    sort = _sorting(order)
    placed = sorted_parts(df, sort)
    per_part = placed.groupBy(_PART).agg(
        *[F.sum(value).alias(name) for name, value in totals.items()]
    )
    by_part = Window.orderBy(_PART)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_part.select(
        _PART,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in totals],
        *[F.sum(n).over(everything).alias(f"{n}_ALL") for n in totals],
    )
    within = (
        Window.partitionBy(_PART)
        .orderBy(*sort)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.withColumns(
        {f"__within_{name}": F.sum(value).over(within) for name, value in totals.items()}
    )
    # offsets holds one row per stretch, whatever the data size
    return summed.join(F.broadcast(offsets), _PART).select(
        *df.columns,
        *[(F.col(f"__within_{n}") + F.col(f"__before_{n}")).alias(n) for n in totals],
        *[f"{name}_ALL" for name in totals],
    )


def _long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "MEASURE", "VALUE"
    )


def _sql_array(numbers: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(n)!r}D' for n in numbers)})"


def _per_column(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], aggregates: dict[str, str]
) -> DataFrame:
    """``{name: SQL aggregate of {x}}`` for each column, turned into one row per column."""
    found = df.groupBy(*by).agg(
        *[
            F.expr(sql.format(x=f"CAST(`{c}` AS DOUBLE)")).alias(f"__{name}_{i}")
            for i, c in enumerate(columns)
            for name, sql in aggregates.items()
        ]
    )
    structs = ", ".join(
        f"struct('{c}' AS MEASURE, "
        + ", ".join(f"__{name}_{i} AS {name}" for name in aggregates)
        + ")"
        for i, c in enumerate(columns)
    )
    return found.selectExpr(*by, f"inline(array({structs}))")


def _brackets(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], quantiles: Sequence[float], level: int
) -> DataFrame:
    """Per group, an interval of values around each quantile that is meant to contain it.

    Column ENDS holds the lower ends, then the upper ends. A sketch of accuracy 10000 misses a
    rank by at most N/10000; the narrowest interval reaches five times as far. A group takes the
    narrowest one, from ``level`` on, that also reaches over two of its ranks, and everything if
    there is none.
    """
    reaches = REACHES[level:]
    aggregates = {"N_VALUES": "count({x})"}
    lows, highs = [], []
    for i, p in enumerate(quantiles):
        for ends, sign, limit in ((lows, -1, "double('-inf')"), (highs, 1, "double('inf')")):
            cases = []
            for k, reach in enumerate(reaches):
                at = p + sign * reach
                end = f"ENDS[{(2 * i + (sign > 0)) * len(reaches) + k}]" if 0 < at < 1 else limit
                cases.append(f"WHEN N_VALUES * {reach!r}D >= 2 THEN {end}")
            ends.append(f"CASE {' '.join(cases)} ELSE {limit} END" if cases else limit)
    wanted = [p + sign * r for p in quantiles for sign in (-1, 1) for r in reaches]
    if wanted:
        inner = _sql_array([min(max(p, 0.0), 1.0) for p in wanted])
        aggregates["ENDS"] = f"percentile_approx({{x}}, {inner}, {SKETCH_ACCURACY})"
    sketched = _per_column(df, columns, by, aggregates)
    return sketched.selectExpr(*by, "MEASURE", f"array({', '.join(lows + highs)}) AS ENDS")


def _condensed_counts(
    values: DataFrame, brackets: DataFrame, keys: Sequence[str], n_quantiles: int
) -> DataFrame:
    """Rows per value inside the brackets, and per gap between two brackets.

    LOWEST and HIGHEST differ only in rows that stand for a gap.
    """
    pairs = [(f"ENDS[{i}]", f"ENDS[{i + n_quantiles}]") for i in range(n_quantiles)]
    inside = " OR ".join(f"VALUE BETWEEN {low} AND {high}" for low, high in pairs)
    gap = " + ".join(f"CAST(VALUE >= {low} AS INT)" for low, _ in pairs)
    return (
        null_safe_join(values, brackets, keys)
        .selectExpr(*keys, "VALUE", f"IF({inside}, VALUE, NULL) AS SINGLE", f"{gap} AS GAP")
        .groupBy(*keys, "GAP", "SINGLE")
        .agg(
            F.expr("count(1) AS N"),
            F.expr("min(VALUE) AS LOWEST"),
            F.expr("max(VALUE) AS HIGHEST"),
            F.expr("sum(VALUE) AS TOTAL"),
        )
        .drop("GAP", "SINGLE")
    )


def value_summary(
    df: DataFrame, columns: Sequence[str], quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact summary of numeric columns, one row per (``by``, column).

    Result: by..., MEASURE, N_ROWS, N_MISSING, MIN_VALUE, MEAN_VALUE, MAX_VALUE and one column per
    entry of ``quantiles``, interpolated linearly between the two nearest ranks.

    A first pass sketches an interval around each quantile. In the second pass values inside the
    intervals are counted one by one and all values between two intervals fall into one row, both
    before the shuffle. Only this short list is sorted to find the ranks. Should a rank miss its
    interval, the groups it happened to are searched again with wider intervals, in the end with
    one that holds everything; a neighbouring value is never returned. The columns needed are
    written once, since both passes read them.
    """
    by = list(by)
    keys = [*by, "MEASURE"]
    once = checkpointed(df.select(*dict.fromkeys([*by, *columns])))
    found = checkpointed(_ranked(once, columns, quantiles, by, 0, None))
    for level in range(1, len(REACHES) + 1):
        missed = found.where("MISSED").select(*keys)
        if missed.isEmpty():
            break
        again = _ranked(once, columns, quantiles, by, level, missed)
        found = checkpointed(found.where("NOT MISSED").unionByName(again))
    return found.drop("MISSED")


def _ranked(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: dict[str, float],
    by: list[str],
    level: int,
    only: DataFrame | None,
) -> DataFrame:
    """The summary by intervals of ``level``, of the groups ``only`` if given, and who MISSED."""
    keys = [*by, "MEASURE"]
    points = list(quantiles.values())
    values = _long_form(df, columns, by)
    # written once: a sketch may come out differently when a lost task is repeated
    brackets = checkpointed(_brackets(df, columns, by, points, level))
    if only is not None:
        brackets = null_safe_join(brackets, only, keys)
    if not by:
        # one row per column
        brackets = F.broadcast(brackets)
    order = [*[F.asc_nulls_last(k) for k in keys], F.asc_nulls_last("LOWEST")]
    placed = sorted_parts(_condensed_counts(values, brackets, keys, len(points)), order)

    # a stretch is the part of a group within one written partition
    group = f"PARTITION BY {', '.join(keys)}"
    earlier = f"{group} ORDER BY {_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    stretches = (
        placed.groupBy(*keys, _PART)
        .agg(
            F.expr("sum(N) AS N_STRETCH"),
            F.expr("sum(IF(LOWEST IS NULL, 0, N)) AS N_KNOWN"),
            F.expr("min(LOWEST) AS MIN_VALUE"),
            F.expr("sum(TOTAL) AS SUM_VALUE"),
            F.expr("max(HIGHEST) AS MAX_VALUE"),
        )
        .selectExpr(
            *keys,
            _PART,
            "N_STRETCH",
            f"coalesce(sum(N_STRETCH) OVER ({earlier}), 0) AS BEFORE",
            f"sum(N_STRETCH) OVER ({group}) AS N_ROWS",
            f"sum(N_KNOWN) OVER ({group}) AS N_KNOWN",
            f"min(MIN_VALUE) OVER ({group}) AS MIN_VALUE",
            f"sum(SUM_VALUE) OVER ({group}) AS SUM_VALUE",
            f"max(MAX_VALUE) OVER ({group}) AS MAX_VALUE",
        )
        .withColumn(
            "TARGETS",
            F.expr(
                f"flatten(transform({_sql_array(points)}, (p, i) -> array("
                "struct(2 * i AS SLOT, floor(p * (N_KNOWN - 1)) AS RANK),"
                "struct(2 * i + 1 AS SLOT, ceil(p * (N_KNOWN - 1)) AS RANK))))"
            ),
        )
    )
    needed = stretches.where(
        "BEFORE = 0 OR exists(TARGETS, t -> BEFORE <= t.RANK AND t.RANK < BEFORE + N_STRETCH)"
    ).drop("N_STRETCH")
    if not by:
        # at most one stretch per column and rank
        needed = F.broadcast(needed)
    same = ["N_ROWS", "N_KNOWN", "MIN_VALUE", "SUM_VALUE", "MAX_VALUE"]
    found = (
        null_safe_join(
            placed.select(*keys, _PART, "N", "LOWEST", "HIGHEST"), needed, [*keys, _PART]
        )
        .withColumn(
            "NEXT_RANK",
            F.expr(
                f"BEFORE + sum(N) OVER ({group}, {_PART} ORDER BY LOWEST ASC NULLS LAST"
                " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            ),
        )
        .withColumn(
            "HITS",
            F.expr(
                "filter(TARGETS, t -> LOWEST IS NOT NULL"
                " AND NEXT_RANK - N <= t.RANK AND t.RANK < NEXT_RANK)"
            ),
        )
        .withColumn(
            "EXACT",
            F.expr("IF(size(HITS) > 0 AND LOWEST = HIGHEST, LOWEST, NULL)"),
        )
        .groupBy(*keys)
        .agg(
            *[F.expr(f"max({c}) AS {c}") for c in same],
            F.expr("max(size(HITS) > 0 AND LOWEST < HIGHEST) AS MISSED"),
            # two entries per quantile
            F.expr(
                "map_from_entries(flatten(collect_list(IF(size(HITS) = 0, NULL,"
                " transform(HITS, t -> struct(t.SLOT, EXACT)))))) AS AT"
            ),
        )
    )
    results = []
    for i, (name, p) in enumerate(quantiles.items()):
        position = f"({float(p)!r}D * (N_KNOWN - 1))"
        low, high = f"AT[{2 * i}]", f"AT[{2 * i + 1}]"
        results.append(
            f"{low} + ({position} - floor({position})) * ({high} - {low}) AS `{name}`"
        )
    return found.selectExpr(
        *keys,
        "N_ROWS",
        "N_ROWS - N_KNOWN AS N_MISSING",
        "MIN_VALUE",
        "try_divide(SUM_VALUE, N_KNOWN) AS MEAN_VALUE",
        "MAX_VALUE",
        *results,
        "coalesce(MISSED, false) AS MISSED",
    )


def approx_value_summary(
    df: DataFrame, columns: Sequence[str], quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Same columns as ``value_summary`` with sketched quantiles, in one pass and without a sort."""
    sketch = f"percentile_approx({{x}}, {{points}}, {SKETCH_ACCURACY})"
    return _summary_in_one_aggregate(df, columns, quantiles, by, sketch)


def _summary_in_one_aggregate(
    df: DataFrame, columns: Sequence[str], quantiles: dict[str, float], by: Sequence[str], sql: str
) -> DataFrame:
    points = _sql_array(list(quantiles.values()))
    return _per_column(
        df,
        columns,
        by,
        {
            "N_ROWS": "count(1)",
            "N_MISSING": "count_if({x} IS NULL)",
            "MIN_VALUE": "min({x})",
            "MEAN_VALUE": "avg({x})",
            "MAX_VALUE": "max({x})",
            "POINTS": sql.format(x="{x}", points=points),
        },
    ).selectExpr(
        *by,
        "MEASURE",
        "N_ROWS",
        "N_MISSING",
        "MIN_VALUE",
        "MEAN_VALUE",
        "MAX_VALUE",
        *[f"POINTS[{i}] AS `{name}`" for i, name in enumerate(quantiles)],
    )
