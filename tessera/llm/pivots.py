"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.frames import checkpointed, local_roots, runs
from tessera.llm.vectors import matrix, usable

#: Members of an inverted list that one task compares with as many others.
BLOCK = 1024
#: Vectors from which one reference point is chosen.
SAMPLED = 4
#: Candidate pairs verified at once.
VERIFIED = 1 << 16


def unit_rows(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def pivot_orders(values: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` nearest pivots by angle, nearest first, ties to the smaller number."""
    return np.argsort(-(unit_rows(values) @ pivots.T), axis=1, kind="stable")[:, :k]


def spread_points(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the unit vectors ``points``, each next one farthest from those before.

    So a group of near copies, however large, gives few reference points.
    """
    chosen = [0]
    nearest = points @ points[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def vector_classes(rows: DataFrame, vector: str, label: str, vec_id: str) -> DataFrame:
    """(row, label, vector, copies, least): usable, labelled vectors, equal ones of a label once."""
    nonzero = F.exists(F.col(vector), lambda x: x != 0)
    some = rows.where(F.col(label).isNotNull() & usable(F.col(vector)) & nonzero)
    classes = some.groupBy(F.col(label).alias("label"), F.col(vector).alias("vector")).agg(
        F.count("*").alias("copies"), F.min(vec_id).alias("least")
    )
    return checkpointed(classes).withColumn("row", F.monotonically_increasing_id())


def near_links(
    classes: DataFrame, least: float = 0.98, pivots: int = 128, k: int = 16, shared: int = 9
) -> DataFrame:
    """(row, n, root): link counts and links that join the groups of `vector_classes`.

    Every vector is described by its ``k`` nearest of ``pivots`` reference points, which lie farthest
    apart among the ``SAMPLED`` times as many vectors with the smallest hashes. Inverted lists hold, per label and pivot, the vectors that
    have the pivot among their first ones, in order of rarity: two vectors that share ``shared`` of
    ``k`` pivots meet in a list of one of their ``k - shared + 1`` rarest. Where they meet for the
    first time, the pivots they share are counted, and pairs with enough are verified by cosine.

    Each list is cut into blocks of about ``BLOCK``, and a task holds two blocks, so a list of any
    length spreads over many tasks. A task returns, per vector, how many vectors it found and one
    link, which suffices for the groups: pairs are never written out.
    """
    sample = classes.select("row", F.xxhash64("vector").alias("_hash")).orderBy("_hash", "row").limit(SAMPLED * pivots)
    ids = classes.join(F.broadcast(sample), "row").orderBy("_hash", "row").select("vector").collect()
    if not ids:
        return classes.sparkSession.createDataFrame([], "row long, n long, root long")
    # Vectors that end early count as zero beyond.
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    points = np.zeros((len(ids), width))
    for i, r in enumerate(ids):
        points[i, : len(r[0])] = r[0]
    points = spread_points(unit_rows(points), pivots)
    k = min(k, len(points))
    shared = min(shared, k)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pivot_orders(matrix(batch.column(batch.schema.get_field_index("vector")), width), points, k)
            found = pa.FixedSizeListArray.from_arrays(pa.array(order.astype(np.int32).ravel()), k).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "pivots"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields)
    index = checkpointed(classes.mapInArrow(described, f"{kinds}, pivots array<int>"))
    sizes = index.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()
    by_rarity = np.lexsort((np.arange(len(points)), [dict(map(tuple, sizes)).get(p, 0) for p in range(len(points))]))
    rank = np.empty(len(points), dtype=np.int64)
    rank[by_rarity] = np.arange(len(points))
    prefix = k - shared + 1
    ranks = F.array(*[F.lit(int(r)) for r in rank])
    described_by = F.array_sort(F.transform("pivots", lambda p: F.get(ranks, p)))
    ranked_index = index.select("row", "label", "copies", "vector", described_by.alias("ranks"))
    # Lists and blocks are made of thin rows; a vector is added where it is needed.
    lists = ranked_index.select("row", "label", F.explode(F.slice("ranks", 1, prefix)).alias("pivot"))
    lengths = lists.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = lists.join(lengths, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64("row"), "blocks"))
    units = blocked.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "row",
        "pivot",
        F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    paired = units.join(ranked_index, "row")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, first, second, _), rows in runs(batches, ["pivot", "first", "second", "key"]):
            side = rows.column("side").to_numpy()
            unit = unit_rows(matrix(rows.column("vector"), width))
            ranked = matrix(rows.column("ranks"), k, np.int64)
            has = np.zeros((len(side), len(points)), dtype=np.float32)
            np.put_along_axis(has, ranked, 1, axis=1)
            early = np.zeros((len(side), len(points)), dtype=bool)
            np.put_along_axis(early, ranked[:, :prefix], True, axis=1)
            left = np.flatnonzero(side == 0)
            right = left if first == second else np.flatnonzero(side == 1)
            a, b = np.nonzero(has[left] @ has[right].T >= shared)
            a, b = left[a], right[b]
            if first == second:
                a, b = a[a < b], b[a < b]
            near_a, near_b = [], []
            for at in range(0, len(a), VERIFIED):
                i, j = a[at : at + VERIFIED], b[at : at + VERIFIED]
                # In the first list that both are in, and nowhere else.
                here = (early[i] & early[j]).argmax(axis=1) == pivot
                i, j = i[here], j[here]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
                near_a.append(i[near])
                near_b.append(j[near])
            if not near_a:
                continue
            i, j = np.concatenate(near_a), np.concatenate(near_b)
            copies = rows.column("copies").to_numpy()
            n = np.bincount(i, copies[j], len(side)) + np.bincount(j, copies[i], len(side))
            root = local_roots(len(side), i, j)
            some = np.flatnonzero(n)
            row = rows.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[some]), pa.array(n[some].astype(np.int64)), pa.array(row[root[some]])], names=["row", "n", "root"]
            )

    keys = ["label", "pivot", "first", "second"]
    dealt = paired.withColumn("key", F.xxhash64("label")).repartition(*keys)
    return dealt.sortWithinPartitions(*keys).drop("label").mapInArrow(linked, "row long, n long, root long")


def near_duplicate_vectors(
    rows: DataFrame,
    vec_id: str,
    vector: str,
    label: str,
    least: float = 0.98,
    pivots: int = 128,
    k: int = 16,
    shared: int = 9,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors with the same label link where their cosine, in double precision, is ``least`` or more;
    equal vectors always do. ``n_links`` counts the other rows a row links with, ``component_id`` is
    the smallest id reachable by links. Rows with a null label, and vectors that are null, empty,
    zero or hold null or non-finite components, link with nothing and are their own component; no
    rows give none. Rows that share an id are rows of their own. A null id is the smallest of its
    component only if there is no other, and such a row is not kept.

    The index is fitted on ``pivots`` vectors and holds every vector; measured recall is in the tests.
    """
    classes = vector_classes(rows, vector, label, vec_id)
    found = checkpointed(near_links(classes, least, pivots, k, shared))
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    nodes = components(found, "row", "root").withColumnRenamed("node", "row")
    labelled = (
        classes.join(counts, "row", "left")
        .join(nodes, "row", "left")
        .select("label", "vector", "least", F.coalesce("component", "row").alias("component"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    known = labelled.join(smallest, "component").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), "n_links", "component_id", F.lit(True).alias("_linked")
    )
    joined = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    joined = joined.join(known, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
