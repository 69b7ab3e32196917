"""A corpus made ready for training: quality, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.materialize import ensure_checkpoint_dir
from tessera.llm import attention, mixing, packing, simhash
from tessera.llm.frames import free_name, row_key
from tessera.llm.queries import GOOD, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of these documents."""
    model = attention.learned(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    score = free_name(docs, "score")
    return attention.scored(docs, docs.columns, "text", model, score).where(F.col(score) >= GOOD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link."""
    return simhash.representatives(docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole texts.

    A document's words taken, over its words, are rounded to a number of copies, half up: the mix
    ends inside a document once or twice per source. Documents without words are in no mix.
    """
    keys = {"_id": F.col("doc_id"), "_key": row_key(F.col("text")), "_source": F.col("source")}
    sized = docs.select(*[c.alias(k) for k, c in keys.items()], mixing.words(F.col("text")).alias("_size"))
    rows = mixing.mixed(sized, ["_id", "_key"], "_source", "_size")[1]
    copies = F.expr("bigint(floor(sum(taken) / max(_size) + 0.5D))").alias("_copies")
    counts = rows.where("taken > 0").groupBy(*keys).agg(F.count("*").alias("_rows"), copies)
    return mixing.copied(docs, keys, counts.where("_copies > 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.packed(packing.digests(packing.token_pieces(docs, "doc_id", "text")), "length")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Network scores, XXH64 and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written to the shared folder before the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
