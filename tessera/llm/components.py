"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import checkpointed


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for every node of ``links`` the smallest node it reaches.

    Large-star and small-star rounds: each round hangs a node's neighbours on the smallest of them,
    and ends when a round changes nothing. A round's links are written, so that lineage stays short
    and lost executors cost one round. Rows with a null side are no links; a link to itself only
    names the node. Repeated links count once; an empty table gives no rows.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna()
    alone = pairs.where("a = b").select(F.col("a").alias("node"))
    edges = checkpointed(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(lowest, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        edges = checkpointed(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    linked = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).unionByName(alone).distinct()
    roots = roots.join(linked, "node", "left_anti").withColumn("component", F.col("node"))
    return linked.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()
    return tuple(row)
