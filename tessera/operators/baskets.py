"""Market baskets: transactions, frequent items and association rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.materialize import checkpointed
from tessera.functions.nulls import as_column


def visit_key(ticket: str | None = None) -> Column:
    """Customer and time of the ticket as one text; a missing part reads ``NA``.

    Lines with neither part say nothing about who bought together, and there may be any number of
    them. With ``ticket``, the ticket's column, each ticket is then a basket; without, they are one.
    """
    visit = F.concat(
        F.coalesce(F.col("ID_CLI").cast("string"), F.lit("NA")),
        F.lit("-"),
        F.coalesce(F.date_format("TIC_DATETIME", "yyyy-MM-dd HH:mm:ss"), F.lit("NA")),
    )
    if ticket is None:
        return visit
    unknown = F.col("ID_CLI").isNull() & F.col("TIC_DATETIME").isNull()
    number = F.concat(F.lit("NA-NA-"), F.coalesce(F.col(ticket).cast("string"), F.lit("NA")))
    return F.when(unknown, number).otherwise(visit)


def basket_items(
    tickets: DataFrame, item: str = "ID_ARTICOLO", key: Column | str | None = None
) -> DataFrame:
    """Distinct (basket_id, item) pairs of the lines with a positive amount.

    ``key`` is the basket, by default one customer at one time, or one ticket with neither.
    """
    ticket = "ID_SCONTRINO" if "ID_SCONTRINO" in tickets.columns else None
    basket = visit_key(ticket) if key is None else as_column(key)
    return (
        tickets.where("IMPORTO_LORDO > 0")
        .select(basket.cast("string").alias("basket_id"), F.col(item).cast("string").alias("item"))
        .distinct()
    )


def baskets_from_items(pairs: DataFrame) -> DataFrame:
    """Sorted item array per basket, from distinct pairs.

    The pairs are made distinct before they meet, so a basket never holds more elements than the
    catalogue has items, however many lines it has.
    """
    return pairs.groupBy("basket_id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def baskets(
    tickets: DataFrame, item: str = "ID_ARTICOLO", key: Column | str | None = None
) -> DataFrame:
    return baskets_from_items(basket_items(tickets, item, key))


def basket_sizes(pairs: DataFrame) -> DataFrame:
    """Baskets per number of items, to look at before mining rules."""
    return (
        pairs.groupBy("basket_id")
        .agg(F.count(F.lit(1)).alias("n_items"))
        .groupBy("n_items")
        .agg(F.count(F.lit(1)).alias("n_baskets"))
    )


def item_frequency(pairs: DataFrame, min_support: float = 0.0) -> DataFrame:
    """Baskets per item, and their share of all baskets, at or above ``min_support``."""
    total = pairs.agg(F.count_distinct("basket_id")).scalar()
    return (
        pairs.groupBy("item")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("support", F.try_divide("count", total))
        .where(F.col("support") >= min_support)
    )


def minable_baskets(pairs: DataFrame, min_support: float) -> DataFrame:
    """Baskets reduced to their frequent items, which loses no rule at this support.

    Baskets left without an item stay, as empty arrays, because supports are shares of all
    baskets. Frequent items number at most the mean basket size over ``min_support``, which bounds
    the length of every array.
    """
    frequent = item_frequency(pairs, min_support).select(F.col("item").alias("frequent_item"))
    reduced = pairs.join(frequent, F.col("item") == F.col("frequent_item"), "left").select(
        "basket_id", F.col("frequent_item").alias("item")
    )
    return baskets_from_items(reduced)


def association_rules(
    transactions: DataFrame,
    min_support: float = 0.001,
    min_confidence: float = 0.8,
    max_length: int | None = None,
) -> DataFrame:
    """Rules with one item on the right-hand side.

    Result: antecedent, consequent (sorted arrays), support, confidence, coverage, lift, count.
    Rules with an empty left-hand side are part of the result: they state that an item is in at
    least ``min_confidence`` of all baskets. ``max_length`` counts the items of both sides.
    """
    # read by the item counts, the pattern search and the total
    mined = checkpointed(transactions.select("items"))
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(mined)
    total = mined.agg(F.count(F.lit(1))).scalar()
    rules = model.associationRules
    if max_length is not None:
        rules = rules.where(F.size("antecedent") < max_length)
    rules = rules.select(
        F.array_sort("antecedent").alias("antecedent"),
        "consequent",
        "support",
        "confidence",
        "lift",
    )
    single = (
        model.freqItemsets.where(F.size("items") == 1)
        .withColumn("support", F.try_divide("freq", total))
        .where(F.col("support") >= min_confidence)
        .select(
            F.array().cast("array<string>").alias("antecedent"),
            F.col("items").alias("consequent"),
            "support",
            F.col("support").alias("confidence"),
            F.lit(1.0).alias("lift"),
        )
    )
    return rules.unionByName(single).select(
        "antecedent",
        "consequent",
        "support",
        "confidence",
        F.try_divide("support", "confidence").alias("coverage"),
        "lift",
        F.round(F.col("support") * total).cast("long").alias("count"),
    )


def frequent_itemsets(
    pairs: DataFrame, min_support: float = 0.001, max_length: int = 10
) -> tuple[DataFrame, int]:
    """(items, count) of the sets of up to ``max_length`` items in enough baskets, and all baskets.

    ``pairs`` are distinct (basket_id, item). Sets grow level by level and the search ends with
    ``max_length``, or where no set is left. The frequent sets that a basket holds are a table with
    the set they extend and their last item; two of a basket that extend the same set make one of the
    next level. Their baskets are counted by a grouped count, map-side first, so neither items nor
    sets reach the driver. A basket's items meet only as far as they are frequent together.
    """
    pairs = checkpointed(pairs)
    total = pairs.agg(F.count_distinct("basket_id")).first()[0]
    enough = F.col("count") >= F.lit(min_support) * F.lit(float(total))
    numbered = F.monotonically_increasing_id()
    single = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("count")).where(enough)
    single = checkpointed(single).withColumn("set", numbered)
    levels = [single.select(F.array("item").alias("items"), "count")]
    last = single.select("set", F.array("item").alias("items"))
    held = pairs.join(single.select("item", "set"), "item").select(
        "basket_id", F.lit(0).cast("long").alias("prefix"), "set", "item"
    )
    for length in range(2, max_length + 1):
        held = checkpointed(held)
        other = held.select(
            F.col("basket_id").alias("__basket"),
            F.col("prefix").alias("__prefix"),
            F.col("item").alias("__item"),
        )
        same = F.col("basket_id").eqNullSafe(F.col("__basket")) & (F.col("prefix") == F.col("__prefix"))
        grown = held.join(other, same & (F.col("item") < F.col("__item"))).select(
            "basket_id", F.col("set").alias("prefix"), F.col("__item").alias("item")
        )
        counts = grown.groupBy("prefix", "item").agg(F.count(F.lit(1)).alias("count")).where(enough)
        found = checkpointed(counts)
        if found.isEmpty():
            break
        found = found.withColumn("set", numbered)
        whole = last.withColumnRenamed("set", "prefix")
        named = found.join(whole, "prefix").select(
            "set", F.concat("items", F.array("item")).alias("items"), "count"
        )
        named = checkpointed(named)
        levels.append(named.select("items", "count"))
        last = named.select("set", "items")
        if length < max_length:
            held = grown.join(found.select("prefix", "item", "set"), ["prefix", "item"]).select(
                "basket_id", "prefix", "set", "item"
            )
    return reduce(DataFrame.unionByName, levels), total


def bounded_rules(
    pairs: DataFrame, min_support: float = 0.001, min_confidence: float = 0.8, max_length: int = 10
) -> DataFrame:
    """Rules as from ``association_rules``, from a search that ends at ``max_length`` items.

    Each frequent set gives a rule per item; its other items are looked up among the frequent sets,
    which hold all their parts. A rule with an empty left-hand side is covered by all baskets.
    """
    sets, total = frequent_itemsets(pairs, min_support, max_length)
    rules = sets.select("count", "items", F.explode("items").alias("__item")).select(
        F.array_sort(F.array_remove("items", F.col("__item"))).alias("antecedent"),
        F.array("__item").alias("consequent"),
        "count",
    )
    known = sets.select(F.col("items").alias("__items"), F.col("count").alias("__count"))
    one = known.where(F.size("__items") == 1).select(
        F.col("__items").alias("__one"), F.col("__count").alias("__one_count")
    )
    joined = (
        rules.join(known, F.col("antecedent") == F.col("__items"), "left")
        .withColumn("__count", F.when(F.size("antecedent") == 0, total).otherwise(F.col("__count")))
        .withColumn("confidence", F.col("count") / F.col("__count"))
        .where(F.col("confidence") >= min_confidence)
        .join(one, F.col("consequent") == F.col("__one"))
    )
    return joined.select(
        "antecedent",
        "consequent",
        (F.col("count") / total).alias("support"),
        "confidence",
        (F.col("__count") / total).alias("coverage"),
        (F.col("confidence") / (F.col("__one_count") / total)).alias("lift"),
        "count",
    )


def rule_count(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("n_rules"))


def top_rules(rules: DataFrame, n: int = 10, by: Sequence[str] = ("lift", "support")) -> DataFrame:
    """The first ``n`` rules by decreasing measures, ties by their items."""
    return rules.orderBy(*[F.desc(c) for c in by], "antecedent", "consequent").limit(n)
