"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import (
    checkpointed,
    found_again,
    free_name,
    repeated,
    row_numbers,
    running_start,
)

#: The golden ratio's fraction times 2**31, odd: its multiples step through all 2**31 points.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Slots of a schedule with large sources; blocks are as many words as this many slots need.
SLOTS = 1 << 20
#: A source with less than this part of the slots has shorter blocks, so that it has about as many.
PART, FEWEST = 1 / 4096, 64
#: Cells in which the points' owners are looked up, and slots a cell has at most on average.
CELLS, PER_CELL = 1024, 1024


def words(text: Column) -> Column:
    """Number of words, which are runs of anything but the six ASCII white spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: ``source``, its ``place`` from 0, ``source_size`` and ``target``.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all
    sizes by weight. A target stops at ``most`` times its source's size; what is above goes to the
    others by weight until none is above. That is one common rate for all that do not stop: sources
    are ordered by the rate at which they stop, and the rate left for the rest after each is a
    running sum. The windows meet one row per source. A source without words has target 0.
    """
    sums = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    order = Window.orderBy(F.col(source).asc_nulls_last())
    placed = sums.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    placed = placed.withColumn("cap", F.col("source_size") * F.lit(most))
    by_rate = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    after = by_rate.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rates = placed.withColumn("rate", left / F.sum("weight").over(after))
    # The first source that its rate does not stop has the rate of all that follow.
    free = rates.withColumn("free", F.col("rate") * F.col("weight") <= F.col("cap"))
    first = F.first(F.when(F.col("free"), F.col("rate")), ignorenulls=True).over(
        by_rate.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return free.withColumn("target", F.when(first.isNull(), F.col("cap")).otherwise(first * F.col("weight"))).select(
        source, "place", "source_size", "target"
    )


def schedule(targets: DataFrame, block: Column, slots: int = SLOTS) -> DataFrame:
    """(slot, place, turn): which source each slot of the mix draws from, and its rank there.

    Slot i falls on the fraction of i times the golden ratio, which is mapped through the sources'
    cumulative numbers of blocks, so that every stretch of the schedule holds the sources near their
    shares. ``block`` is a source's words a slot; there are as many slots as all targets need, up to
    ``slots``. Points and sources meet by the cell they fall in, so neither side is broadcast for
    this.
    """
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    many = max(CELLS, slots // PER_CELL)
    ranges = (
        targets.withColumn("_blocks", F.col("target") / block)
        .withColumn("_all", F.sum("_blocks").over(whole))
        .withColumn("_to", F.sum("_blocks").over(upto))
        .where("target > 0")
        .withColumn("low", (F.col("_to") - F.col("_blocks")) / F.col("_all"))
        # The last end is one; points are below it.
        .withColumn("high", F.when(F.col("_to") >= F.col("_all"), F.lit(1.0)).otherwise(F.col("_to") / F.col("_all")))
        .withColumn("_slots", F.ceil("_all"))
    )
    cells = ranges.withColumn(
        "cell",
        F.explode(F.expr(f"sequence(int(floor(low * {many})), int(least({many - 1}, floor(high * {many}))))")),
    )
    points = (
        targets.sparkSession.range(slots)
        .withColumnRenamed("id", "slot")
        .withColumn("point", (F.col("slot") % POINTS * GOLDEN % POINTS).cast("double") / POINTS)
        .withColumn("cell", F.floor(F.col("point") * many).cast("int"))
    )
    taken = points.join(cells, "cell").where("point >= low and point < high and slot < _slots").select("slot", "place")
    return row_numbers(taken, ["place"], F.expr("slot div 1024"), [F.col("slot")], "turn")


def filled_up(slotted: DataFrame, targets: DataFrame, slots: int) -> DataFrame:
    """``slotted`` with exactly ``_turns`` slots for each place that has any said in ``targets``.

    Points miss such a number by a few. Slots above it go; those missing follow after slot ``slots``.
    """
    said = targets.where("_turns is not null").select("place", "_turns")
    kept = slotted.join(said, "place", "left").where("_turns is null or turn < _turns").select("slot", "place", "turn")
    had = said.join(slotted.groupBy("place").agg(F.count("*").alias("_had")), "place", "left")
    had = had.withColumn("_had", F.coalesce("_had", F.lit(0))).where("_had < _turns")
    missing = had.withColumn("turn", F.explode(F.expr("sequence(_had, _turns - 1)")))
    sources = targets.agg(F.max("place")).first()[0] + 1
    slot = (F.lit(slots) + (F.col("turn") - F.col("_had")) * sources + F.col("place")).cast("long")
    return kept.unionByName(missing.select(slot.alias("slot"), "place", "turn"))


def mixed(
    docs: DataFrame,
    columns: list[str],
    source: str,
    size: str,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    slots: int = SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """Pieces of the mix, and every row with what the mix takes of it.

    Pieces: (slot, place, block, pass, columns, start, words): in slot order they are the mix;
    ``start`` is the first word taken of the row. Rows: ``columns``, ``source_size``, ``target``,
    ``taken``.

    A source's rows are shuffled by a hash of ``columns`` and laid end to end; the line is cut into
    blocks of equal words, the last one shorter. The source's n-th slot takes block n, beginning
    again after the last one, but never more than ``most`` times. Blocks have as many words as
    ``slots`` slots need for all targets, one at least; a source whose target is less than ``PART``
    of these slots (``FEWEST`` at least) has blocks that are shorter by as much, and its slots are
    rounded from its target. So a source misses its target by a few of its own blocks, of which it
    has that many, or of single words; the schedule outgrows ``slots`` only by those of small
    sources. Rows without words take none; a null source is a source; equal rows are rows of their
    own; no rows give none.
    """
    keep = list(dict.fromkeys([*columns, source, size]))
    sizes = checkpointed(docs.select(*keep))
    targets = checkpointed(source_targets(sizes, source, size, weights, share, most))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    common = max(1, math.ceil(min(share, most) * total / slots))
    parts = max(FEWEST, int(slots * PART))
    own = F.greatest(F.lit(1), F.least(F.lit(common), F.floor(F.col("target") / parts))).cast("long")
    turns = F.when(F.col("_words") < common, F.floor(F.col("target") / F.col("_words") + 0.5)).cast("long")
    targets = targets.withColumn("_words", own).withColumn("_turns", turns)
    need, small = targets.agg(F.sum(F.col("target") / F.col("_words")), F.count("_turns")).first()
    # Rounding may take a sum above the ceiling of another order's.
    slots = math.ceil(need or 0) + 1
    of = free_name(sizes, "_of_source")
    known = targets.drop("_turns").withColumnRenamed(source, of)
    rows = sizes.join(known, F.col(source).eqNullSafe(F.col(of))).drop(of)
    rows = checkpointed(
        running_start(
            rows.withColumn("_hash", F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]))),
            ["place"],
            F.substring("_hash", 1, 3),
            [F.col("_hash"), *[F.col(c).asc_nulls_first() for c in columns], F.col(size)],
            {size: "_from"},
        ).drop("_hash")
    )
    slotted = schedule(targets, F.col("_words"), slots)
    if small:
        slotted = filled_up(checkpointed(slotted), targets, slots)
    slotted = slotted.join(targets.select("place", "source_size", "_words"), "place")
    drawn = (
        slotted.withColumn("block", F.expr("turn % ((source_size + _words - 1) div _words)"))
        .withColumn("pass", F.expr("turn div ((source_size + _words - 1) div _words)"))
        .where(F.col("pass") < int(most))
        .select("slot", "place", "block", "pass")
    )
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    spans = numbered.where(F.col(size) > 0).select(
        "_row",
        "place",
        *columns,
        "_from",
        "_words",
        F.col(size).alias("_size"),
        F.explode(F.expr(f"sequence(_from div _words, (_from + `{size}` - 1) div _words)")).alias("block"),
    )
    begin = F.greatest(F.col("_from"), F.col("block") * F.col("_words"))
    end = F.least(F.col("_from") + F.col("_size"), (F.col("block") + 1) * F.col("_words"))
    pieces = spans.join(drawn, ["place", "block"]).select(
        "_row", "slot", "place", "block", "pass", *columns, (begin - F.col("_from")).alias("start"), (end - begin).alias("words")
    )
    sums = pieces.groupBy("_row").agg(F.sum("words").alias("taken"))
    whole = numbered.join(sums, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return pieces.drop("_row"), whole.drop("_row", "_from", "_words", "place")


def copied(docs: DataFrame, keys: dict[str, Column], counts: DataFrame) -> DataFrame:
    """``docs`` in whole rows, as often as ``counts`` (the keys' names, _rows, _copies) says.

    Rows with equal keys are told apart only by number: ``_copies`` counts for all of them. Rows
    that are not in ``counts`` go.
    """
    found, (copies,) = found_again(docs, keys, counts, ["_copies"])
    return repeated(found, copies).select(*docs.columns)
