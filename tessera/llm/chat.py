"""Chat logs: conversations that are prefixes of longer ones go, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import checkpointed, row_numbers, running_start

#: Turn numbers that share a stretch, and turns that share a part of a rendered conversation.
STRETCH, PART = 256, 256
HALVES = ("s1", "s2", "s3", "s4")


def _turns(logs: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Needed columns under fixed names, without repeated rows."""
    said = F.struct(F.col(role).isNull(), F.coalesce(role, F.lit("")), F.col(text).isNull(), F.coalesce(text, F.lit("")))
    return logs.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
        F.xxhash64(F.lit(1), said).alias("h1"),
        F.xxhash64(F.lit(2), said).alias("h2"),
        F.col(conv_id).isNull().alias("no_id"),
        F.coalesce(conv_id, F.lit(0)).alias("id"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position`` from 0 in their conversation."""
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("h1"), F.col("h2")]
    return row_numbers(rows, ["no_id", "id"], stretch, order, "position")


def maximal_conversations(logs: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): conversations that no other one begins with.

    A turn's hash covers position, role and text; the running sum over a conversation is the hash of
    its prefix up to there (128 bits in four sums). A conversation goes if its last hash is an inner
    prefix hash of another one; of equal conversations the smallest id stays.

    Turns are in order of ``turn``, null first, then role and text. Repeated rows are one turn. A
    null conv_id is an id like others, null roles and texts are values, an empty table gives no rows.
    Prefixes are made distinct and ends are combined before they meet, so a first turn that most
    conversations share is one row.
    """
    keys = ["no_id", "id"]
    rows = _turns(logs, conv_id, turn, role, text).select(*keys, "turn", "role", "h1", "h2").distinct()
    placed = _placed(rows)
    first, second = F.xxhash64("position", "h1"), F.xxhash64("h2", "position")
    halves = placed.withColumns(
        {
            "v1": F.shiftrightunsigned(first, 32),
            "v2": first.bitwiseAND(F.lit(0xFFFFFFFF)),
            "v3": F.shiftrightunsigned(second, 32),
            "v4": second.bitwiseAND(F.lit(0xFFFFFFFF)),
        }
    )
    stretch = F.floor(F.col("position") / STRETCH)
    sums = {f"v{k}": f"s{k}" for k in range(1, 5)}
    begun = running_start(halves, keys, stretch, [F.col("position")], sums)
    upto = begun.select(
        *keys, (F.col("position") + 1).alias("turns"), *[(F.col(f"s{k}") + F.col(f"v{k}")).alias(f"s{k}") for k in range(1, 5)]
    )
    prefixes = checkpointed(upto)
    ends = prefixes.groupBy(*keys).agg(F.max(F.struct("turns", *HALVES)).alias("end"))
    inner = (
        prefixes.join(ends.select(*keys, F.col("end.turns").alias("all_turns")), keys)
        .where("turns < all_turns")
        .select("turns", *HALVES)
        .distinct()
    )
    whole = ends.groupBy("end").agg(F.min(F.struct(*keys)).alias("kept")).select("kept.*", "end.*")
    kept = whole.join(inner, ["turns", *HALVES], "left_anti")
    return kept.select(_id(), "turns")


def _id() -> Column:
    return F.when(~F.col("no_id"), F.col("id")).alias("conv_id")


def rendered(logs: DataFrame, conv_id: str, turn: str, role: str, text: str, template: str = "<|%s|>\n%s<|end|>\n") -> DataFrame:
    """(conv_id, part, turns, text): maximal conversations as text, in parts of ``PART`` turns.

    ``template`` takes role and text of a turn; nulls are empty there. Parts in order make the whole
    conversation; only those of over ``PART`` turns have more than one, so no row holds an unbounded
    conversation.
    """
    kept = maximal_conversations(logs, conv_id, turn, role, text).select(F.col("conv_id").alias("_kept"))
    turns = _turns(logs, conv_id, turn, role, text)
    own = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi").distinct()
    line = F.format_string(template, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    lines = _placed(own).select(
        "no_id", "id", "position", F.expr(f"int(position div {PART})").alias("part"), line.alias("line")
    )
    parts = lines.groupBy("no_id", "id", "part").agg(
        F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("position", "line"))).alias("lines")
    )
    return parts.select(_id(), "part", "turns", F.array_join(F.col("lines.line"), "").alias("text"))
