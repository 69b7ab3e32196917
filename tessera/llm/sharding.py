"""Shard and slot of every row by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import dealt_by, running_start

#: Copies of a row that are counted out at a time.
COPIES = 10_000


def permuted(numbers: np.ndarray, count: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Where a fixed permutation of 0..count-1 sends each number.

    A balanced Feistel network permutes the smallest even power of two that is not below ``count``;
    a value that lands outside walks its cycle until it is inside again, which happens for every
    start inside. Nothing but ``count``, ``seed`` and ``rounds`` decides the result.
    """
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    values = numbers.astype(np.uint64)
    outside = np.arange(len(values))
    while len(outside):
        left, right = values[outside] >> half, values[outside] & mask
        for k in range(rounds):
            left, right = right, left ^ (_mixed(right, seed * rounds + k) & mask)
        values[outside] = (left << half) | right
        outside = outside[values[outside] >= np.uint64(count)]
    return values.astype(np.int64)


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A round's function: a 64-bit finalizer of value and key."""
    z = values + np.uint64((key + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permuted_column(number: Column, count: int, seed: int) -> Column:
    """`permuted` as a column, for any frame with global row numbers."""

    @F.pandas_udf("long")
    def walk(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), count, seed))

    return walk(number)


def numbered(df: DataFrame, columns: list[str], number: str = "row_number") -> DataFrame:
    """The rows of ``columns`` with gapless global numbers from 0 that depend on their content only.

    Equal rows are counted before the shuffle and stand for one; their copies get neighbouring
    numbers, written out in two steps. Rows are dealt by a hash and numbered inside each residue,
    after the rows of the residues before. Nulls are values like any other. The table may be empty.
    """
    some = df.select(*columns).groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_all", F.lit(0))
    stretch = dealt_by(F.xxhash64(F.lit(7), *[F.col(c).isNull() for c in columns], *columns))
    order = [F.col(c).asc_nulls_first() for c in columns]
    placed = running_start(some, ["_all"], stretch, order, {"_copies": "_first"})
    steps = placed.withColumn("_step", F.explode(F.expr(f"sequence(0, (_copies - 1) div {COPIES})")))
    inside = F.expr(f"sequence(_step * {COPIES}, least(_copies, (_step + 1) * {COPIES}) - 1)")
    copies = steps.withColumn("_copy", F.explode(inside))
    return copies.select(*columns, (F.col("_first") + F.col("_copy")).alias(number))


def feistel_shards(df: DataFrame, columns: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``columns`` of every row with its ``shard`` and gapless ``slot`` there.

    A row's global number is permuted; shard and slot are remainder and quotient of its place by
    ``shards``, so shard counts differ by one at most, whatever the content: equal rows and rows of
    one source spread like any others. The same rows get the same places in every run and under any
    partitioning. Null values and empty texts are rows like others; no rows give none.
    """
    rows = numbered(df, columns)
    count = df.count()
    return (
        rows.withColumn("_place", permuted_column(F.col("row_number"), count, seed))
        .withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("row_number", "_place")
    )
