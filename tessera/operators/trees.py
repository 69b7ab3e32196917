"""Fitted trees as tables: their nodes, cost-complexity pruning, votes of trees on rows they left out."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.materialize import checkpointed, ensure_checkpoint_dir
from tessera.operators.churn import FEATURES, feature_stages, fit_decision_tree, labelled, poisson_weight

NODES = (
    "TREE int, NODE int, PARENT int, DEPTH int, LEFT_CHILD int, RIGHT_CHILD int, N_0 double, N_1 double,"
    " PREDICTED int, FEATURE string, THRESHOLD double, LEVELS array<string>, RULE string"
)


def node_table(model: PipelineModel, tree: int | None = None) -> DataFrame:
    """One row per node of a fitted tree or forest, as the learner saves it, with the rule of its path.

    Nodes are numbered in preorder from 0 per TREE; a leaf has children -1. N_0 and N_1 are the rows
    (or weights) of either class, PREDICTED the larger one. A row goes LEFT_CHILD if FEATURE is at most
    THRESHOLD, or among LEVELS. RULE is the path in words, empty for the root. A tree's rows meet in
    one task; the learner holds whole trees in memory, too.
    """
    stage, levels = model.stages[-1], model.stages[0].labels
    forest = isinstance(stage, RandomForestClassificationModel)
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4()}"
    stage.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    number = F.col("treeID") if forest else F.lit(0 if tree is None else tree)
    nodes = data.select(number.cast("int").alias("TREE"), "nodeData.*" if forest else "*")
    named = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("split.featureIndex") + 1)
    inner, categorical = F.col("leftChild") >= 0, F.col("split.numCategories") >= 0
    known = F.array(*[F.lit(x) for x in levels])
    left = F.transform("split.leftCategoriesOrThreshold", lambda x: F.coalesce(F.get(known, x.cast("int")), F.lit("other")))
    rows = nodes.select(
        "TREE",
        F.col("id").alias("NODE"),
        F.col("leftChild").alias("LEFT_CHILD"),
        F.col("rightChild").alias("RIGHT_CHILD"),
        F.get("impurityStats", F.lit(0)).alias("N_0"),
        F.get("impurityStats", F.lit(1)).alias("N_1"),
        F.col("prediction").cast("int").alias("PREDICTED"),
        F.when(inner, named).alias("FEATURE"),
        F.when(inner & ~categorical, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("THRESHOLD"),
        F.when(inner & categorical, F.array_sort(left)).alias("LEVELS"),
    )
    # small, and read by the pruning, the leaves and reports
    return checkpointed(rows.groupBy("TREE").applyInPandas(_with_paths, NODES))


def _with_paths(nodes: pd.DataFrame) -> pd.DataFrame:
    """Parent, depth and rule of each node; children come after their parent."""
    nodes = nodes.sort_values("NODE").reset_index(drop=True)
    parent, depth, rule = [-1] * len(nodes), [0] * len(nodes), [""] * len(nodes)
    for i, row in enumerate(nodes.itertuples()):
        if row.LEFT_CHILD < 0:
            continue
        if row.LEVELS is None:
            sides = (f"{row.FEATURE} <= {row.THRESHOLD:g}", f"{row.FEATURE} > {row.THRESHOLD:g}")
        else:
            listed = ", ".join(row.LEVELS)
            sides = (f"{row.FEATURE} in ({listed})", f"{row.FEATURE} not in ({listed})")
        for child, side in zip((row.LEFT_CHILD, row.RIGHT_CHILD), sides, strict=True):
            parent[child], depth[child] = i, depth[i] + 1
            rule[child] = f"{rule[i]} and {side}" if rule[i] else side
    nodes = nodes.assign(PARENT=parent, DEPTH=depth, RULE=rule)
    return nodes[[column.split()[0] for column in NODES.split(", ")]]


def collapses(left: Sequence[int], right: Sequence[int], errors: Sequence[float]) -> tuple[np.ndarray, list[tuple[float, int, float]]]:
    """Weakest-link pruning of one tree, given in preorder with the errors of each node as a leaf.

    A node's link is the errors its subtree saves per split; the weakest are cut, all of equal strength
    together, until the root is left. Returned are the complexity at which each node is cut or goes
    with one above it, and (complexity, splits, errors) of the trees in turn, the full one first.
    """
    count = len(errors)
    parent = [-1] * count
    for node in range(count):
        for child in (left[node], right[node]):
            if child >= 0:
                parent[child] = node
    below, splits = [float(e) for e in errors], [0] * count
    for node in range(count - 1, -1, -1):
        if left[node] >= 0:
            below[node] = below[left[node]] + below[right[node]]
            splits[node] = splits[left[node]] + splits[right[node]] + 1
    cut = np.full(count, np.inf)

    def strength(node: int) -> float:
        return (errors[node] - below[node]) / splits[node]

    links = [(strength(n), n, splits[n]) for n in range(count) if splits[n]]
    heapq.heapify(links)
    trees = [(0.0, splits[0], below[0])]
    now = 0.0
    while links:
        weakest, node, size = heapq.heappop(links)
        # An entry of before the last cut below the node, or of a node that is gone.
        if size != splits[node] or cut[node] < np.inf:
            continue
        if weakest > now + 1e-9 * max(1.0, abs(now)) or len(trees) == 1:
            now = max(now, weakest)
            trees.append((now, 0, 0.0))
        saved, fewer = errors[node] - below[node], splits[node]
        gone = [node]
        while gone:
            one = gone.pop()
            if cut[one] == np.inf:
                cut[one] = now
                gone += [c for c in (left[one], right[one]) if c >= 0]
        above = node
        while above >= 0:
            below[above] += saved
            splits[above] -= fewer
            if above != node and splits[above]:
                heapq.heappush(links, (strength(above), above, splits[above]))
            above = parent[above]
        trees[-1] = (now, splits[0], below[0])
    return cut, trees


def _arrays(nodes: pd.DataFrame) -> tuple[pd.DataFrame, list[int], list[int], list[float]]:
    nodes = nodes.sort_values("NODE").reset_index(drop=True)
    errors = nodes[["N_0", "N_1"]].min(axis=1).tolist()
    return nodes, nodes["LEFT_CHILD"].tolist(), nodes["RIGHT_CHILD"].tolist(), errors


def pruned_trees(nodes: DataFrame) -> DataFrame:
    """(TREE, COMPLEXITY, SPLITS, ERRORS) of the trees that pruning passes through, the full one first."""

    def each(table: pd.DataFrame) -> pd.DataFrame:
        table, *arrays = _arrays(table)
        found = pd.DataFrame(collapses(*arrays)[1], columns=["COMPLEXITY", "SPLITS", "ERRORS"])
        return found.assign(TREE=table["TREE"][0])[["TREE", "COMPLEXITY", "SPLITS", "ERRORS"]]

    return nodes.groupBy("TREE").applyInPandas(each, "TREE int, COMPLEXITY double, SPLITS int, ERRORS double")


def _leaf_classes(nodes: DataFrame, complexities: Sequence[float]) -> DataFrame:
    """(TREE, LEAF, CLASSES): what each leaf's rows are told at each complexity for one row of data."""

    def each(table: pd.DataFrame) -> pd.DataFrame:
        table, left, right, errors = _arrays(table)
        cut, _ = collapses(left, right, errors)
        rows = float(table["N_0"][0] + table["N_1"][0])
        classes = table["PREDICTED"].to_numpy()
        said = np.empty((len(table), len(complexities)), dtype=np.int64)
        fixed = np.zeros(said.shape, dtype=bool)
        bounds = np.array(complexities) * rows
        for node in range(len(table)):
            said[node] = np.where(fixed[node], said[node], classes[node])
            ends = fixed[node] | (cut[node] <= bounds)
            for child in (left[node], right[node]):
                if child >= 0:
                    said[child], fixed[child] = said[node], ends
        leaves = [n for n in range(len(table)) if left[n] < 0]
        return pd.DataFrame({"TREE": table["TREE"][0], "LEAF": range(len(leaves)), "CLASSES": [said[n].tolist() for n in leaves]})

    return nodes.groupBy("TREE").applyInPandas(each, "TREE int, LEAF int, CLASSES array<int>")


def complexity_table(
    train: DataFrame,
    label: str = "CHURN",
    id_column: str = "ID_CLI",
    folds: int = 10,
    least: float = 0.01,
    seed: int = 42,
    fit: Callable[..., PipelineModel] = fit_decision_tree,
) -> DataFrame:
    """CP, NSPLIT, REL_ERROR, XERROR and XSTD of a tree's pruned trees, the root first.

    CP is the complexity from which on a tree is the best, over the errors of the root; trees below
    ``least`` are left out, and the one that is best there ends the table. REL_ERROR counts errors on
    ``train``, XERROR those on rows of a fold by a tree of the other folds, pruned at the geometric
    mean of the complexity and the one before; both over the root's errors. XSTD is the deviation of
    XERROR. Folds follow from a hash of the id and ``seed``.

    The trees that pruning passes through are worked out per tree on executors; rows meet the trees
    of their fold by leaf, counted per leaf and class first. Only the table reaches the driver, which
    has at most one row per ``least``. A table of one class has one row.
    """
    spark = train.sparkSession
    nodes = node_table(fit(train, label))
    found = [tuple(r)[1:] for r in pruned_trees(nodes).orderBy("COMPLEXITY", F.desc("SPLITS")).collect()]
    root = found[-1][2]
    rows = sum(nodes.where("NODE = 0").select("N_0", "N_1").first())
    schema = "CP double, NSPLIT int, REL_ERROR double, XERROR double, XSTD double"
    if not root:
        return spark.createDataFrame([(float(least), 0, None, None, None)], schema)
    shown = [(a / root, s, e / root) for a, s, e in reversed(found) if a > least * root]
    # The tree that is best at ``least``.
    last = next((x for x in reversed(found) if x[0] <= least * root), found[0])
    shown.append((float(least), last[1], last[2] / root))
    cps = [cp for cp, _, _ in shown]
    # By row of data, so that they mean the same on fewer rows.
    middles = [math.inf] + [math.sqrt(a * b) for a, b in zip(cps, cps[1:], strict=False)]
    bounds = [m * root / rows for m in middles]
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(folds))
    dealt = train.withColumn("__fold", fold.cast("int"))
    parts = []
    for k in range(folds):
        rest, held = dealt.where(F.col("__fold") != k), dealt.where(F.col("__fold") == k)
        if rest.isEmpty():
            continue
        model = fit(rest.drop("__fold"), label)
        model.stages[-1].setLeafCol("__leaf")
        counts = model.transform(held).groupBy(F.col("__leaf").cast("int").alias("LEAF"), F.col(label).cast("int").alias("CLASS"))
        counted = counts.agg(F.count(F.lit(1)).alias("N"))
        parts.append(counted.join(_leaf_classes(node_table(model, k), bounds), "LEAF").select("CLASS", "N", "CLASSES"))
    wrong = None
    for part in parts:
        said = part.select("CLASS", "N", F.posexplode("CLASSES").alias("AT", "SAID"))
        errors = said.where("SAID <> CLASS").groupBy("AT").agg(F.sum("N").alias("N"))
        wrong = errors if wrong is None else wrong.unionByName(errors)
    missed = {} if wrong is None else {r["AT"]: r["N"] for r in wrong.groupBy("AT").agg(F.sum("N").alias("N")).collect()}
    table = []
    for k, (cp, splits, error) in enumerate(shown):
        n = float(missed.get(k, 0))
        table.append((cp, splits, error, n / root, math.sqrt(n * (1 - n / rows)) / root))
    return spark.createDataFrame(table, schema)


def left_out_votes(
    train: DataFrame,
    label: str = "CHURN",
    id_column: str = "ID_CLI",
    trees: int = 100,
    bags: int | None = None,
    max_depth: int = 30,
    seed: int = 42,
) -> DataFrame:
    """(id, label, VOTES_0, VOTES_1): what the trees of a forest say of the rows they have not seen.

    A bag is a Poisson(1) weight per row, drawn from a hash of id, ``seed`` and the bag's number, so
    no row is copied and every run draws the same. Each bag grows its own trees, over a random part of
    the features per split, and each of them has one vote on each row of weight 0. Each tree has a
    bag of its own unless ``bags`` says how many there are. A row that every bag holds has no votes.
    """
    bags = trees if bags is None else bags
    parts = []
    for number in range(bags):
        grown = trees // bags + (number < trees % bags)
        drawn = labelled(train, label).withColumn("__weight", poisson_weight(id_column, seed, number))
        inside, outside = drawn.where("__weight > 0"), drawn.where("__weight = 0")
        stages = PipelineModel([])
        for stage in feature_stages(False):
            fitted = stage.fit(stages.transform(inside)) if hasattr(stage, "fit") else stage
            stages = PipelineModel([*stages.stages, fitted])
        forest = RandomForestClassifier(
            numTrees=grown,
            featureSubsetStrategy="sqrt",
            maxDepth=max_depth,
            seed=seed + number,
            bootstrap=False,
            weightCol="__weight",
            cacheNodeIds=True,
        ).fit(stages.transform(inside))
        told = stages.transform(outside)
        for i, tree in enumerate(forest.trees):
            told = tree.setPredictionCol(f"__vote_{i}").setRawPredictionCol("").setProbabilityCol("").transform(told)
        ones = sum((F.col(f"__vote_{i}") for i in range(grown)), F.lit(0.0)).cast("long")
        parts.append(told.select(id_column, label, (grown - ones).alias("VOTES_0"), ones.alias("VOTES_1")))
    votes = parts[0]
    for part in parts[1:]:
        votes = votes.unionByName(part)
    return votes.groupBy(id_column, label).agg(F.sum("VOTES_0").alias("VOTES_0"), F.sum("VOTES_1").alias("VOTES_1"))


def left_out_error(votes: DataFrame, label: str = "CHURN") -> DataFrame:
    """Confusion of class and vote: a row per class with its error, and one of all rows (null class).

    Rows are told the class with more votes, class 0 if they are equal.
    """
    told = votes.withColumn("__said", (F.col("VOTES_1") > F.col("VOTES_0")).cast("int"))
    sets = told.rollup(F.col(label).cast("int").alias(label)).agg(
        F.count(F.lit(1)).alias("N_ROWS"),
        F.count_if(F.col("__said") == 0).alias("SAID_0"),
        F.count_if(F.col("__said") == 1).alias("SAID_1"),
        F.avg((F.col("__said") != F.col(label)).cast("double")).alias("ERROR"),
    )
    return sets.where("N_ROWS > 0")

