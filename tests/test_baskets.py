import itertools

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessera.operators import baskets


def _transactions(spark, *groups):
    return spark.createDataFrame([(i, list(g)) for i, g in enumerate(groups)], "basket_id int, items array<string>")


def _short(rules):
    return sorted(
        ("".join(r["antecedent"]), "".join(r["consequent"]), round(r["support"], 4), round(r["confidence"], 4), round(r["lift"], 2), r["count"])
        for r in rules.collect()
    )


def test_rules(spark):
    found = baskets.association_rules(_transactions(spark, "ab", "abc", "ab", "c"), 0.2, 0.8)
    assert _short(found) == [
        ("a", "b", 0.75, 1.0, 1.33, 3),
        ("ac", "b", 0.25, 1.0, 1.33, 1),
        ("b", "a", 0.75, 1.0, 1.33, 3),
        ("bc", "a", 0.25, 1.0, 1.33, 1),
    ]
    assert rows(baskets.rule_count(found)) == [(4,)]
    assert baskets.top_rules(found, 2).count() == 2


def test_empty_left_side(spark):
    found = baskets.association_rules(_transactions(spark, "a", "ab"), 0.001, 0.8)
    assert ("", "a", 1.0, 1.0, 1.0, 2) in _short(found)


def test_rule_length(spark):
    data = _transactions(spark, "abc", "abc", "abc")
    lengths = {len(r["antecedent"]) + 1 for r in baskets.association_rules(data, 0.5, 0.5, 2).collect()}
    assert lengths == {1, 2}


@pytest.fixture
def lines(spark, time):
    return spark.createDataFrame(
        [
            (1, time("2018-01-01T10:00:00"), 5, 2.0),
            (1, time("2018-01-01T10:00:00"), 5, 3.0),
            (1, time("2018-01-01T10:00:00"), 7, 3.0),
            (1, time("2018-01-01T11:00:00"), 7, 3.0),
            (1, time("2018-01-01T11:00:00"), 8, -3.0),
            (None, time("2018-01-01T11:00:00"), 5, 1.0),
        ],
        "ID_CLI long, TIC_DATETIME timestamp, ID_ARTICOLO long, IMPORTO_LORDO double",
    )


def test_tickets_without_customer_and_time_stay_apart(spark):
    tickets = spark.createDataFrame(
        [(1, None, None, 5, 1.0), (2, None, None, 5, 1.0), (None, None, None, 6, 1.0)],
        "ID_SCONTRINO long, ID_CLI long, TIC_DATETIME timestamp, ID_ARTICOLO long, IMPORTO_LORDO double",
    )
    found = rows(baskets.basket_items(tickets))
    assert found == [("NA-NA-1", "5"), ("NA-NA-2", "5"), ("NA-NA-NA", "6")]
    assert rows(baskets.basket_items(tickets, key=baskets.visit_key())) == [("NA-NA", "5"), ("NA-NA", "6")]


def test_baskets(lines):
    assert rows(baskets.baskets(lines).withColumn("items", F.array_join("items", ","))) == [
        ("1-2018-01-01 10:00:00", "5,7"),
        ("1-2018-01-01 11:00:00", "7"),
        ("NA-2018-01-01 11:00:00", "5"),
    ]
    assert rows(baskets.basket_sizes(baskets.basket_items(lines))) == [(1, 2), (2, 1)]
    by_client = baskets.baskets(lines, key="ID_CLI")
    assert by_client.count() == 2


def test_item_frequency(lines):
    found = rows(baskets.item_frequency(baskets.basket_items(lines)))
    assert [(i, n, round(s, 4)) for i, n, s in found] == [("5", 2, 0.6667), ("7", 2, 0.6667)]


def test_reducing_to_frequent_items_loses_no_rule(spark):
    # one basket holds a third of all rows
    pairs = (
        spark.range(600)
        .selectExpr("CAST(id % 40 AS STRING) AS basket_id", "CAST(pmod(xxhash64(id), 12) AS STRING) AS item")
        .unionByName(spark.range(300).selectExpr("'0' AS basket_id", "CAST(id AS STRING) AS item"))
        .distinct()
    )
    reduced = baskets.minable_baskets(pairs, 0.4)
    assert reduced.count() == 40
    support, confidence = 0.4, 0.6
    found = {
        (frozenset(r["antecedent"]), r["consequent"][0]): (r["support"], r["confidence"])
        for r in baskets.association_rules(reduced, support, confidence, 3).collect()
    }
    groups = {}
    for b, i in pairs.collect():
        groups.setdefault(b, set()).add(i)
    sets = list(groups.values())

    def share(items):
        return sum(items <= s for s in sets) / len(sets)

    frequent = [i for i in {i for s in sets for i in s} if share({i}) >= support]
    expected = {}
    for n in range(0, 3):
        for left in itertools.combinations(sorted(frequent), n):
            for right in frequent:
                if right in left or share({*left, right}) < support:
                    continue
                trust = share({*left, right}) / share(set(left))
                if trust >= confidence:
                    expected[(frozenset(left), right)] = (share({*left, right}), trust)
    assert set(found) == set(expected)
    for key, (s, c) in expected.items():
        assert found[key] == (pytest.approx(s), pytest.approx(c))


@pytest.mark.parametrize("length", [1, 3, 10])
def test_bounded_rules_are_those_of_the_whole_search(spark, length):
    items = ["abcd", "abc", "ab", "acd", "bcd", "d", "abce", "e", "", "ad"]
    pairs = spark.createDataFrame([(str(i), x) for i, g in enumerate(items) for x in g or "z"], "basket_id string, item string")
    for support, confidence in ((0.1, 0.3), (0.3, 0.6)):
        whole = baskets.association_rules(baskets.minable_baskets(pairs, support), support, confidence, length)
        found = baskets.bounded_rules(pairs, support, confidence, length)
        assert _short(found) == _short(whole)
        assert found.columns == whole.columns


def test_sets_of_baskets(spark):
    groups = ["abc", "ab", "abd", "bc"]
    pairs = spark.createDataFrame([(str(i), x) for i, g in enumerate(groups) for x in g], "basket_id string, item string")
    sets, total = baskets.frequent_itemsets(pairs, 0.5, 3)
    assert total == 4
    found = {"".join(r["items"]): r["count"] for r in sets.collect()}
    expected = {}
    for size in (1, 2, 3):
        for chosen in itertools.combinations("abcd", size):
            n = sum(set(chosen) <= set(g) for g in groups)
            if n >= 2:
                expected["".join(chosen)] = n
    assert found == expected
    none, total = baskets.frequent_itemsets(pairs.where("false"), 0.5, 3)
    assert none.collect() == [] and total == 0
    assert baskets.bounded_rules(pairs.where("false")).collect() == []
