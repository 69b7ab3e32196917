"""Pruning against all pruned trees, cross-validation against a walk over each fold's tree, votes."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import churn, trees


def random_tree(seed, leaves):
    """A tree in preorder: (left, right, class counts)."""
    draw = random.Random(seed)
    left, right, counts = [], [], []

    def grow(n):
        node = len(left)
        left.append(-1)
        right.append(-1)
        counts.append(None)
        if n == 1:
            counts[node] = (draw.randint(0, 6), draw.randint(0, 6))
        else:
            cut = draw.randint(1, n - 1)
            left[node] = grow(cut)
            right[node] = grow(n - cut)
            counts[node] = tuple(map(sum, zip(counts[left[node]], counts[right[node]], strict=True)))
        return node

    grow(leaves)
    return left, right, counts


def prunings(left, right, node=0):
    """Every pruned tree, as the set of its leaves."""
    yield frozenset([node])
    if left[node] >= 0:
        for a, b in itertools.product(prunings(left, right, left[node]), prunings(left, right, right[node])):
            yield a | b


@pytest.mark.parametrize("seed", range(25))
def test_weakest_links(seed):
    left, right, counts = random_tree(seed, 2 + seed % 7)
    errors = [float(min(c)) for c in counts]
    cut, passed = trees.collapses(left, right, errors)
    every = list(prunings(left, right))
    assert [p[1] for p in passed] == sorted({p[1] for p in passed}, reverse=True) and passed[-1][1:] == (0, errors[0])
    starts = [p[0] for p in passed]
    for alpha in sorted({*starts, *[(a + b) / 2 for a, b in itertools.pairwise(starts)], starts[-1] + 1}):
        # The smallest of the best trees.
        best = min(every, key=lambda t: (round(sum(errors[n] for n in t) + alpha * len(t), 9), len(t)))
        now = [p for p in passed if p[0] <= alpha][-1]
        assert (now[1], now[2]) == (len(best) - 1, sum(errors[n] for n in best))
        ends = {n for n in best if left[n] >= 0}
        assert all(cut[n] <= alpha + 1e-9 for n in ends)


def table(spark, rows):
    return spark.createDataFrame(rows, "ID_CLI long, segment string, transaction_count long, recency_days long, amount double, CHURN int")


@pytest.fixture(scope="module")
def customers(spark):
    draw = random.Random(3)
    rows = []
    for i in range(160):
        recency, count = draw.randint(0, 60), draw.randint(1, 9)
        label = int(recency > 30) if draw.random() < 0.5 else int(count > 5)
        rows.append((i, draw.choice("abc"), count, recency, float(draw.randint(0, 40)), label))
    return table(spark, rows).repartition(2).cache()


def shallow(train, label="CHURN"):
    return churn.fit_decision_tree(train, label, max_depth=4)


def walked(nodes, row):
    """Nodes on a row's path."""
    path = [0]
    while nodes["LEFT_CHILD"][path[-1]] >= 0:
        n = nodes.loc[path[-1]]
        value = row[n["FEATURE"]]
        goes_left = value in n["LEVELS"] if n["LEVELS"] is not None else value <= n["THRESHOLD"]
        path.append(n["LEFT_CHILD"] if goes_left else n["RIGHT_CHILD"])
    return path


def as_frame(df):
    return pd.DataFrame([r.asDict() for r in df.orderBy("NODE").collect()]).astype({"LEVELS": object})


def test_complexity_table(spark, customers):
    found = trees.complexity_table(customers, folds=4, least=0.005, fit=shallow).collect()
    nodes = as_frame(trees.node_table(shallow(customers)))
    every = list(prunings(nodes["LEFT_CHILD"].tolist(), nodes["RIGHT_CHILD"].tolist()))
    errors = nodes[["N_0", "N_1"]].min(axis=1).tolist()
    root, cps = errors[0], [r["CP"] for r in found]
    assert cps == sorted(cps, reverse=True) and cps[-1] == 0.005 and len(cps) > 2

    def best(every, errors, alpha):
        return min(every, key=lambda t: (round(sum(errors[n] for n in t) + alpha * len(t), 9), len(t)))

    for r in found:
        tree = best(every, errors, r["CP"] * root)
        assert (r["NSPLIT"], r["REL_ERROR"]) == (len(tree) - 1, pytest.approx(sum(errors[n] for n in tree) / root))
    rows = customers.withColumn("fold", F.pmod(F.xxhash64(F.lit(42), "ID_CLI"), F.lit(4)))
    held = [r.asDict() for r in rows.collect()]
    middles = [float("inf")] + [(a * b) ** 0.5 for a, b in itertools.pairwise(cps)]
    wrong = [0] * len(cps)
    for k in range(4):
        part = as_frame(trees.node_table(shallow(rows.where(F.col("fold") != k))))
        every = list(prunings(part["LEFT_CHILD"].tolist(), part["RIGHT_CHILD"].tolist()))
        errors = part[["N_0", "N_1"]].min(axis=1).tolist()
        size = part["N_0"][0] + part["N_1"][0]
        for j, m in enumerate(middles):
            tree = frozenset([0]) if m == float("inf") else best(every, errors, m * root * size / len(held))
            for row in held:
                if row["fold"] == k:
                    end = next(n for n in walked(part, row) if n in tree)
                    wrong[j] += part["PREDICTED"][end] != row["CHURN"]
    assert [r["XERROR"] for r in found] == pytest.approx([w / root for w in wrong])
    assert found[0]["XSTD"] == pytest.approx((wrong[0] * (1 - wrong[0] / len(held))) ** 0.5 / root)


def test_nodes_follow_their_rules(customers):
    nodes = as_frame(trees.node_table(shallow(customers)))
    counts = dict.fromkeys(nodes["NODE"], 0)
    for r in customers.collect():
        for n in walked(nodes, r.asDict()):
            counts[n] += 1
    assert all(counts[n] == a + b for n, a, b in zip(nodes["NODE"], nodes["N_0"], nodes["N_1"], strict=True))
    assert nodes["RULE"][0] == "" and nodes["RULE"][1:].str.len().min() > 0
    assert all(nodes["DEPTH"][n] == nodes["DEPTH"][p] + 1 for n, p in zip(nodes["NODE"], nodes["PARENT"], strict=True) if p >= 0)


def test_one_class(spark):
    same = table(spark, [(i, "a", i, i, 1.0, 1) for i in range(8)])
    found = trees.complexity_table(same, folds=2, fit=lambda t, label: churn.fit_decision_tree(t, label))
    assert [tuple(r) for r in found.collect()] == [(0.01, 0, None, None, None)]


def test_votes_are_those_of_trees_that_left_the_row_out(customers):
    votes = {r["ID_CLI"]: (r["VOTES_0"], r["VOTES_1"]) for r in trees.left_out_votes(customers, trees=7, bags=3, max_depth=3).collect()}
    weights = customers.select("ID_CLI", *[churn.poisson_weight("ID_CLI", 42, k).alias(f"w{k}") for k in range(3)]).collect()
    expected = {r["ID_CLI"]: sum(n for k, n in enumerate((3, 2, 2)) if r[f"w{k}"] == 0) for r in weights}
    assert {i: sum(v) for i, v in votes.items()} == {i: n for i, n in expected.items() if n}
    shares = [sum(r[f"w{k}"] == 0 for r in weights) / len(weights) for k in range(3)]
    assert all(0.2 < s < 0.55 for s in shares)
    again = {r["ID_CLI"]: (r["VOTES_0"], r["VOTES_1"]) for r in trees.left_out_votes(customers, trees=7, bags=3, max_depth=3).collect()}
    assert again == votes


def test_rows_keep_their_nodes_and_trees_stay_the_same(customers, monkeypatch):
    made = []

    def forest(**settings):
        made.append(settings)
        return RandomForestClassifier(**settings)

    monkeypatch.setattr(churn, "RandomForestClassifier", forest)
    monkeypatch.setattr(trees, "RandomForestClassifier", forest)
    kept = [churn.fit_decision_tree(customers), churn.fit_random_forest(customers, trees=15)]
    trees.left_out_votes(customers, trees=2, bags=1, max_depth=3)
    assert len(made) == 2 and all(settings["cacheNodeIds"] for settings in made)
    for model, learner in zip(kept, (DecisionTreeClassifier, RandomForestClassifier), strict=True):
        assert model.stages[-1].getCacheNodeIds()
        settings = {"maxDepth": 30, "seed": 42} | ({"numTrees": 15, "featureSubsetStrategy": "sqrt"} if learner is RandomForestClassifier else {})
        stages = [*churn.feature_stages(False), learner(**settings)]
        led_down = Pipeline(stages=stages).fit(churn.labelled(customers, "CHURN")).stages[-1]
        assert led_down.toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]
        assert model.stages[-1].toDebugString.count("If") > 10


def test_left_out_error(spark):
    votes = spark.createDataFrame([(1, 0, 3, 1), (2, 0, 1, 2), (3, 1, 0, 4), (4, 1, 2, 2), (5, 1, 0, 1)], "ID_CLI long, CHURN int, VOTES_0 long, VOTES_1 long")
    found = {r["CHURN"]: tuple(r)[1:] for r in trees.left_out_error(votes).collect()}
    assert found == {0: (2, 1, 1, 0.5), 1: (3, 1, 2, pytest.approx(1 / 3)), None: (5, 2, 3, pytest.approx(0.4))}
    assert trees.left_out_error(votes.where("false")).collect() == []


def test_separated_terms(spark):
    rows = [(1, "a", 1, 5, 1.0, 0), (2, "a", 2, 6, 2.0, 0), (3, "b", 3, 6, 1.5, 1), (4, "b", 9, 8, 0.5, 0), (5, "c", 4, 9, 3.0, 1), (6, None, 5, 7, 3.0, 1)]
    found = {(r["TERM"], r["CLASS"], r["KIND"]) for r in churn.separated_terms(table(spark, rows)).collect()}
    assert found == {("segment=a", 0, "level"), ("segment=c", 1, "level")}
    ranged = table(spark, [(1, "a", 1, 9, 1.0, 0), (2, "a", 2, 8, 1.0, 0), (3, "a", 3, 8, 1.0, 1), (4, "a", 9, 7, 1.0, 1)])
    found = {(r["TERM"], r["CLASS"], r["KIND"], r["N_ROWS"]) for r in churn.separated_terms(ranged).collect()}
    assert found == {("transaction_count", 1, "complete", 4), ("recency_days", 0, "quasi", 4)}
    assert churn.separated_terms(table(spark, rows).where("CHURN = 1")).collect() == []
    assert churn.separated_terms(table(spark, rows).where("false")).collect() == []
