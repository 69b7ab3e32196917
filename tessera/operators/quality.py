"""Profiling and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distinct import count_ids, distinct_ids
from tessera.functions.nulls import n_distinct
from tessera.functions.ordered import approx_value_summary, value_summary

QUARTILES = {"Q1": 0.25, "MEDIAN": 0.5, "Q3": 0.75}


def structure(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: name, type, number of rows, number of distinct values."""
    names = df.columns
    one_row = df.agg(
        F.count(F.lit(1)).alias("N_ROWS"), *[n_distinct(F.col(c), approx).alias(c) for c in names]
    )
    types = F.create_map(*[F.lit(x) for name, kind in df.dtypes for x in (name, kind)])
    return one_row.unpivot("N_ROWS", names, "COLUMN_NAME", "N_DISTINCT").select(
        "COLUMN_NAME", types[F.col("COLUMN_NAME")].alias("TYPE"), "N_ROWS", "N_DISTINCT"
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Missing count, min, quartiles, mean and max per numeric column.

    Exact in two passes by default; ``approx=True`` sketches the quartiles in one.
    """
    summarise = approx_value_summary if approx else value_summary
    return summarise(df, columns, QUARTILES).withColumnRenamed("MEASURE", "COLUMN_NAME")


def date_summary(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``numeric_summary`` over dates; quartiles between two days round down to a day."""
    days = df.select(*[F.unix_date(c).alias(c) for c in columns])
    summary = numeric_summary(days, columns, approx)
    as_dates = ["MIN_VALUE", *QUARTILES, "MEAN_VALUE", "MAX_VALUE"]
    return summary.withColumns(
        {c: F.date_from_unix_date(F.floor(c).cast("int")) for c in as_dates}
    )


def top_levels(df: DataFrame, columns: Sequence[str], k: int = 6) -> DataFrame:
    """The ``k`` most frequent levels of each categorical column, NULL being a level."""
    counts = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "COLUMN_NAME", "LEVEL")
        .groupBy("COLUMN_NAME", "LEVEL")
        .agg(F.count(F.lit(1)).alias("N_ROWS"))
    )
    # a rank filter this small is applied before the shuffle, to each task's own levels
    ranking = Window.partitionBy("COLUMN_NAME").orderBy(
        F.desc("N_ROWS"), F.asc_nulls_last("LEVEL")
    )
    return counts.withColumn("POSITION", F.row_number().over(ranking)).where(
        F.col("POSITION") <= k
    )


def key_check(df: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """Per candidate key (one or more columns): distinct keys, rows, and whether it is unique."""
    names = ["-".join(key) for key in keys]
    one_row = df.agg(
        F.count(F.lit(1)).alias("TOT_ROWS"),
        *[
            n_distinct(F.col(key[0]) if len(key) == 1 else F.struct(*key)).alias(name)
            for key, name in zip(keys, names)
        ],
    )
    return one_row.unpivot("TOT_ROWS", names, "KEY_COLUMNS", "TOT_KEYS").select(
        "KEY_COLUMNS",
        "TOT_KEYS",
        "TOT_ROWS",
        (F.col("TOT_KEYS") == F.col("TOT_ROWS")).alias("IS_UNIQUE"),
    )


def key_multiplicity(df: DataFrame, key: str, counts: dict[str, str]) -> DataFrame:
    """Per key: distinct values of each counted column, as ``{new column: column}``."""
    return count_ids(distinct_ids(df, [key], counts), [key], list(counts))


def multiplicity_distribution(df: DataFrame, key: str, counts: dict[str, str]) -> DataFrame:
    """Number and share of keys for each combination of multiplicities."""
    per_key = key_multiplicity(df, key, counts)
    grouped = per_key.groupBy(*counts).agg(F.count(F.lit(1)).alias("TOT_CLIs"))
    total = grouped.agg(F.sum("TOT_CLIs")).scalar()
    return grouped.withColumn("PERCENT_CLIs", F.try_divide("TOT_CLIs", total))


def missing_pattern(df: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """Distinct ids per combination of present (1) and absent (0) values."""
    flags = [F.col(c).isNotNull().cast("int").alias(f"W_{c}") for c in columns]
    return df.groupBy(*flags).agg(n_distinct(F.col(id_column)).alias(f"TOT_{id_column}s"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def key_overlap(
    left: DataFrame, right: DataFrame, key: str, names: tuple[str, str], approx: bool = False
) -> DataFrame:
    """How many distinct keys are in both tables, only in the first, or only in the second.

    A NULL key of one table equals a NULL key of the other. One aggregate over the union replaces
    two de-duplications and a full join, and combines each task's keys before the shuffle.
    """
    in_left, in_right = names

    def marked(df: DataFrame, l_flag: int, r_flag: int) -> DataFrame:
        return df.select(key, F.lit(l_flag).alias(in_left), F.lit(r_flag).alias(in_right))

    return (
        marked(left, 1, 0)
        .unionByName(marked(right, 0, 1))
        .groupBy(key)
        .agg(F.max(in_left).alias(in_left), F.max(in_right).alias(in_right))
        .groupBy(in_left, in_right)
        .agg(F.count(F.lit(1)).alias("TOT_KEYS"))
    )


def key_presence(sources: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Distinct keys per key column and set of tables that hold them.

    ``sources`` are (key column, table name, table); a table may come with several keys. Result:
    KEY, TABLES (names in the order given, joined by commas), TOT_KEYS. Every overlap of two or more
    tables, and every inclusion, is a sum over these rows, at most 2 ** n - 1 of them for a key of n
    tables. Each table is one bit; a task's bits of a key are joined before the one shuffle of the
    keys. A NULL key is a key. Keys are compared as text.
    """
    names = {key: [name for k, name, _ in sources if k == key] for key, _, _ in sources}
    parts = [
        df.select(
            F.lit(key).alias("KEY"),
            F.col(key).cast("string").alias("__key"),
            F.lit(1 << names[key].index(name)).cast("long").alias("__bit"),
        )
        for key, name, df in sources
    ]
    bits = reduce(DataFrame.unionByName, parts).groupBy("KEY", "__key").agg(F.bit_or("__bit").alias("__bits"))
    counts = bits.groupBy("KEY", "__bits").agg(F.count(F.lit(1)).alias("TOT_KEYS"))

    def listed(key: str) -> Column:
        held = [F.when(F.col("__bits").bitwiseAND(1 << i) != 0, name) for i, name in enumerate(names[key])]
        return F.concat_ws(",", *held)

    tables = F.coalesce(*[F.when(F.col("KEY") == key, listed(key)) for key in names])
    return counts.select("KEY", tables.alias("TABLES"), "TOT_KEYS")


def level_dominance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How far the most frequent level of each column outweighs the others.

    Result: COLUMN, N_LEVELS, TOP_LEVEL (as text), TOP_COUNT, SECOND_COUNT, SHARE of all rows and
    RATIO to the second (NULL with one level). A missing value is a level like others; of equally
    frequent ones the first as text counts, NULL last. Values are counted by column and level in one
    pass, combined before the shuffle; only two levels a column and task go on to be ranked.
    """
    names = list(df.columns if columns is None else columns)
    texts = df.select([F.col(c).cast("string").alias(c) for c in names])
    levels = texts.unpivot([], names, "COLUMN", "LEVEL").groupBy("COLUMN", "LEVEL").agg(F.count(F.lit(1)).alias("N"))
    order = Window.partitionBy("COLUMN").orderBy(F.desc("N"), F.asc_nulls_last("LEVEL"))
    first = levels.withColumn("__rank", F.row_number().over(order)).where("__rank <= 2")
    sums = levels.groupBy("COLUMN").agg(F.count(F.lit(1)).alias("N_LEVELS"), F.sum("N").alias("__rows"))
    top = first.groupBy("COLUMN").agg(
        F.max_by("LEVEL", F.col("__rank") == 1).alias("TOP_LEVEL"),
        F.max(F.when(F.col("__rank") == 1, F.col("N"))).alias("TOP_COUNT"),
        F.max(F.when(F.col("__rank") == 2, F.col("N"))).alias("SECOND_COUNT"),
    )
    # one row per column of the table on both sides
    return top.join(F.broadcast(sums), "COLUMN").select(
        "COLUMN",
        "N_LEVELS",
        "TOP_LEVEL",
        "TOP_COUNT",
        "SECOND_COUNT",
        (F.col("TOP_COUNT") / F.col("__rows")).alias("SHARE"),
        (F.col("TOP_COUNT") / F.col("SECOND_COUNT")).alias("RATIO"),
    )


def low_variance_columns(df: DataFrame, ratio: float = 19.0, unique: float = 0.1) -> list[str]:
    """Columns of one level, or whose first outweighs the second more than ``ratio`` times while
    their levels are fewer than ``unique`` of the rows."""
    rows = df.count()
    few = F.col("N_LEVELS") < F.lit(float(unique)) * rows
    found = level_dominance(df).where(F.col("SECOND_COUNT").isNull() | ((F.col("RATIO") > ratio) & few))
    named = {r["COLUMN"] for r in found.select("COLUMN").collect()}
    return [c for c in df.columns if c in named]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; give an order without ties.

    The rank filter runs once before the shuffle too, so a frequent key sends one row per task.
    """
    ranking = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranking)).where("__rank = 1").drop("__rank")


def constant_columns(df: DataFrame) -> list[str]:
    """Names of the columns with a single value (or none), found in one pass."""
    checks = df.agg(
        *[
            (
                F.min(c).eqNullSafe(F.max(c))
                & ((F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0))
            ).alias(c)
            for c in df.columns
        ]
    ).first()
    return [c for c in df.columns if checks[c]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns that carry no information. Runs one aggregate job to find them."""
    return df.drop(*constant_columns(df))
