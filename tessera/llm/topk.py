"""Exact top-k inner products by vector-approximation files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import checkpointed
from tessera.llm.vectors import matrix, usable

#: Queries of a block, rows of cells that meet a block in one task, and rows of them at a time.
QUERIES, CELLS, CELL_ROWS = 4096, 8192, 512
#: Up to here a double holds every whole number.
WHOLE = 2.0**53
#: Results fit a long below this.
LONG = 1 << 63


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, x as double, as a double that holds a whole number."""

    def floored(x: Column) -> Column:
        product = x.cast("double") * factor
        return F.when(F.abs(product) < WHOLE, F.floor(product).cast("double")).otherwise(product)

    return F.transform(vector, floored)


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, factor: int = 256) -> DataFrame:
    """(vec_id, vector): usable vectors as whole numbers; other rows take no part in the search.

    A component beyond the range of a double once it is multiplied counts as not finite.
    """
    some = rows.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    whole = some.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), factor).alias("vector"))
    return whole.where(usable(F.col("vector")))


def marks_of(vectors: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper end of each of 2**``bits`` cells in each dimension.

    ``bits`` is 1 to 8, as a cell is stored in a byte. Cells are equally wide between a dimension's
    smallest and largest component, which are taken over all rows: two numbers a dimension reach the
    driver. A component lies in the last cell whose lower end it reaches.
    """
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    each = vectors.select(F.posexplode("vector").alias("dim", "x"))
    ends = each.groupBy("dim").agg(F.min("x").alias("least"), F.max("x").alias("most")).orderBy("dim").collect()
    # Vectors that end early count as zero there.
    least = np.minimum(np.array([r["least"] for r in ends], dtype=np.float64), 0)[:, None]
    most = np.maximum(np.array([r["most"] for r in ends], dtype=np.float64), 0)[:, None]
    cells = 1 << bits
    width = np.floor(most / cells - least / cells) + 1
    with np.errstate(over="ignore"):
        low = np.minimum(least + width * np.arange(cells), most)
    low[:, 0] = least[:, 0]
    # Whole numbers below the next cell's lower end; where doubles are coarser, that end itself.
    return low, np.concatenate((low[:, 1:] - 1, most), axis=1)


def approximations(vectors: DataFrame, low: np.ndarray) -> DataFrame:
    """(row, vec_id, cells): the cell of every component, one byte each."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(2), len(low))
            cells = np.empty(values.shape, dtype=np.uint8)
            for dim, ends in enumerate(low):
                cells[:, dim] = np.searchsorted(ends, values[:, dim], side="right") - 1
            packed = pa.array([c.tobytes() for c in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], names=["row", "vec_id", "cells"])

    return vectors.select("row", "vec_id", "vector").mapInArrow(coded, "row long, vec_id long, cells binary")


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, bits: int = 8, block: int = QUERIES, chunk: int = CELLS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products with other rows.

    ``vectors`` and ``queries`` are `integer_vectors`. Every row is quantised to cells; scanning the
    cells gives each pair an upper and a lower bound. A pair whose upper bound is below the k-th
    largest lower bound of its query, taken over all rows, is out. The exact vectors of the others
    are read, for each query by falling upper bound until the k-th score found is above the bounds
    that are left. So no row is missed, and exact vectors are read for few pairs.

    Blocks of about ``block`` queries meet chunks of about ``chunk`` rows of cells, each pair of
    them in a task's group read from the shuffle, so neither side passes the driver and a group is
    bounded. Of rows with equal vectors only the ``k`` + 1 smallest ids can be results, and only
    they are kept, however many there are. Ties go to the smaller vec_id. Repeated rows count once,
    and rows with the query's own id are left out; rows that share an id but not a vector are
    queries and candidates of their own. A query has fewer results if there are fewer candidates;
    empty tables give no rows. Vectors that end early count as zero beyond. Scores are exact at any
    size; one that no long holds keeps its rank and is null.
    """
    equal = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.distinct().withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k + 1)
    written = checkpointed(first.drop("_n")).withColumn("row", F.monotonically_increasing_id())
    asked = checkpointed(queries.select("vec_id", "vector").distinct())
    asked = asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))
    rows, count = written.count(), asked.count()
    if not rows or not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = marks_of(written, bits)
    cells = approximations(written, low)
    bounds = checkpointed(_bounded(cells, asked, low, high, k, -(-count // block), -(-rows // chunk)))
    by_low = Window.partitionBy("query").orderBy(F.desc("lower"))
    best = bounds.withColumn("_n", F.row_number().over(by_low)).where(F.col("_n") <= k)
    edge = best.groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).alias("edge"))
    left = bounds.join(edge, "query").where(F.col("edge").isNull() | (F.col("upper") >= F.col("edge")))
    read = left.select("query", "row", "upper").join(written, "row").join(asked, "query")
    return _exact(read.select("query", "query_id", "vec_id", "upper", "vector", "asked"), k)


def _bounded(
    cells: DataFrame, queries: DataFrame, low: np.ndarray, high: np.ndarray, k: int, blocks: int, chunks: int
) -> DataFrame:
    """(query, row, lower, upper) of pairs that the k-th lower bound inside their group leaves open."""
    width = len(low)
    dims = np.arange(width)
    largest_mark = max(np.abs(low).max(), np.abs(high).max())

    def scan(chunk: pa.Table, block: pa.Table) -> pa.Table:
        own, numbers = block.column("query_id").to_numpy(), block.column("query").to_numpy()
        q = matrix(block.column("asked"), max(width, max(map(len, block.column("asked")), default=0)))[:, :width]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            # Sums beyond 2**53 round; the bounds are widened by more than that.
            largest = np.abs(q).sum(axis=1, keepdims=True) * largest_mark
            slack = np.where(largest < WHOLE / 2, 0.0, largest * 1e-14 * width)
        best = np.full((len(own), k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, chunk.num_rows, CELL_ROWS):
            part = chunk.slice(at, CELL_ROWS)
            code = np.frombuffer(b"".join(part.column("cells").to_pylist()), dtype=np.uint8).reshape(-1, width)
            least, most = low[dims, code].T, high[dims, code].T
            with np.errstate(over="ignore", invalid="ignore"):
                upper = up @ most + down @ least + slack
                lower = up @ least + down @ most - slack
            # Sums that leave the range of a double say nothing.
            upper[~np.isfinite(upper)], lower[~np.isfinite(lower)] = np.inf, -np.inf
            same = own[:, None] == part.column("vec_id").to_numpy()
            lower[same] = -np.inf
            joined = np.concatenate((best, lower), axis=1)
            best = np.partition(joined, joined.shape[1] - k, axis=1)[:, -k:]
            i, j = np.nonzero((upper >= best.min(axis=1, keepdims=True)) & ~same)
            found.append((i, part.column("row").to_numpy()[j], lower[i, j], upper[i, j]))
            if sum(len(f[0]) for f in found) > 1 << 20:
                found = [_open(found, best)]
        i, row, lower, upper = _open(found, best) if found else (np.empty(0, dtype=np.int64),) * 4
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        arrays = [pa.array(x, kind) for x, kind in zip((numbers[i], row, lower, upper), kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=["query", "row", "lower", "upper"])

    def dealt(df: DataFrame, key: str, parts: int, others: int, pair: str) -> DataFrame:
        own = df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(parts)))
        copies = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return copies.withColumn("pair", F.expr(pair)).drop("_own", "_other")

    cell_side = dealt(cells, "row", chunks, blocks, f"_own * {blocks} + _other")
    query_side = dealt(queries, "query", blocks, chunks, f"_other * {blocks} + _own")
    both = cell_side.groupBy("pair").cogroup(query_side.groupBy("pair"))
    return both.applyInArrow(scan, "query long, row long, lower double, upper double")


def _open(found: list[tuple[np.ndarray, ...]], best: np.ndarray) -> tuple[np.ndarray, ...]:
    i, row, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
    still = upper >= best.min(axis=1)[i]
    return i[still], row[still], lower[still], upper[still]


def _scores(query: np.ndarray, values: np.ndarray) -> list[int]:
    """Exact inner products of a whole-number vector with each row of ``values``."""
    if not len(values):
        return []
    if math.fsum(np.abs(query)) * max(np.abs(values).max(), 1.0) < WHOLE:
        return (values @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(whole, v, strict=True)) for v in values]


def _exact(read: DataFrame, k: int, step: int = 32) -> DataFrame:
    """The k largest scores of each query; its rows are read by falling upper bound, a few at a time."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, query_id, asked = None, None, None
        best: list[tuple[int, int]] = []  # (-score, vec_id), best first

        def result() -> pa.RecordBatch:
            scores = [-s if -LONG < s <= LONG else None for s, _ in best]
            columns = {
                "query_id": pa.array([query_id] * len(best), pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in best], pa.int64()),
                "score": pa.array(scores, pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            numbers = batch.column("query").to_numpy()
            at = 0
            while at < batch.num_rows:
                if numbers[at] != number:
                    if number is not None:
                        yield result()
                    number, query_id, best = numbers[at], batch.column("query_id")[at].as_py(), []
                    asked = np.array(batch.column("asked")[at].as_py(), dtype=np.float64)
                end = at + int(np.searchsorted(numbers[at:], number, side="right"))
                upper = batch.column("upper").to_numpy()
                while at < end and not (len(best) >= k and -best[-1][0] > upper[at]):
                    part = batch.slice(at, min(step, end - at))
                    vectors = part.column("vector")
                    values = matrix(vectors, max(len(asked), max(map(len, vectors))))[:, : len(asked)]
                    scores = _scores(asked, values)
                    best = sorted([*best, *zip([-s for s in scores], part.column("vec_id").to_pylist(), strict=True)])[:k]
                    at += part.num_rows
                at = end
        if number is not None:
            yield result()

    return (
        read.repartition("query")
        .sortWithinPartitions("query", F.desc("upper"), "vec_id")
        .mapInArrow(ranked, "query_id long, rank int, vec_id long, score long")
    )
