"""Churn label, train/test split and the three classifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.nulls import null_safe_join

FEATURES = ["segment", "transaction_count", "recency_days", "amount"]
NUMERIC_FEATURES = FEATURES[1:]
# Hash buckets per class in the split: bounds the counts that choose the cut.
SPLIT_BUCKETS = 4096


def active_line(start: str, end: str) -> Column:
    """Whether a line has a positive amount and lies strictly between the two dates."""
    return (
        (F.col("IMPORTO_LORDO") > 0)
        & (F.col("TIC_DATE") > F.lit(start).cast("date"))
        & (F.col("TIC_DATE") < F.lit(end).cast("date"))
    )


def active_customers(tickets: DataFrame, start: str, end: str) -> DataFrame:
    """Customers with an active line between the two dates."""
    active = tickets.where(active_line(start, end)).select("ID_CLI").distinct()
    return active.withColumn("CHURN", F.lit(0))


def label_churn(
    segments: DataFrame,
    tickets: DataFrame | None = None,
    start: str = "2018-10-01",
    end: str = "2019-01-01",
) -> DataFrame:
    """Features of each scored customer with CHURN 0 if active in the window, else 1.

    Where ``segments`` has CHURN already, as from ``rfm_customer_table`` with ``active``, the
    tickets are not read again.
    """
    if "CHURN" in segments.columns:
        return segments.select(F.col("customer_id").alias("ID_CLI"), *FEATURES, "CHURN")
    customers = segments.select(F.col("customer_id").alias("ID_CLI"), *FEATURES)
    labelled = null_safe_join(customers, active_customers(tickets, start, end), ["ID_CLI"], "left")
    return labelled.fillna({"CHURN": 1})


def stratified_split(
    df: DataFrame, label: str = "CHURN", id_column: str = "ID_CLI", p: float = 0.7, seed: int = 42
) -> DataFrame:
    """Add IS_TRAIN, true for exactly ``ceil(p * n)`` rows of each class.

    Rows of a class are ranked by a hash of id and seed, so the sample is the same on every run.
    The rank is the rank within one of 4096 hash buckets plus the size of the buckets before it;
    buckets are even whatever the ids, so no class is ordered in a single task.
    """
    hashed = df.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_column))).withColumn(
        "__bucket", F.pmod(F.shiftright("__hash", 52), F.lit(SPLIT_BUCKETS))
    )
    buckets = hashed.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    per_class = Window.partitionBy(label)
    before = per_class.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        label,
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.ceil(F.lit(float(p)) * F.sum("__n").over(per_class)).alias("__wanted"),
    )
    in_bucket = Window.partitionBy(label, "__bucket").orderBy("__hash", id_column)
    ranked = hashed.withColumn("__rank", F.row_number().over(in_bucket))
    return (
        null_safe_join(ranked, offsets, [label, "__bucket"])
        .withColumn("IS_TRAIN", F.col("__before") + F.col("__rank") <= F.col("__wanted"))
        .select(*df.columns, "IS_TRAIN")
    )


def feature_stages(one_hot: bool) -> list:
    """Unfitted stages that make ``features`` of the segment and the three measures."""
    indexer = StringIndexer(
        inputCol="segment", outputCol="segment_index", handleInvalid="keep"
    )
    if not one_hot:
        inputs = ["segment_index", *NUMERIC_FEATURES]
        return [indexer, VectorAssembler(inputCols=inputs, outputCol="features")]
    encoder = OneHotEncoder(
        inputCol="segment_index", outputCol="segment_vector", dropLast=True, handleInvalid="keep"
    )
    inputs = ["segment_vector", *NUMERIC_FEATURES]
    return [indexer, encoder, VectorAssembler(inputCols=inputs, outputCol="features")]


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def fit_decision_tree(
    train: DataFrame,
    label: str = "CHURN",
    max_depth: int = 30,
    min_rows: int = 1,
    min_gain: float = 0.0,
    seed: int = 42,
) -> PipelineModel:
    """Gini tree; ``stages[-1].toDebugString`` lists its splits.

    It grows to depth 30, the deepest the learner allows; ``min_rows`` per leaf and ``min_gain``
    stop it earlier. The node each row has reached is kept from level to level, see
    `fit_random_forest`.
    """
    tree = DecisionTreeClassifier(
        impurity="gini",
        maxDepth=max_depth,
        minInstancesPerNode=min_rows,
        minInfoGain=min_gain,
        seed=seed,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[*feature_stages(False), tree]).fit(labelled(train, label))


def fit_random_forest(
    train: DataFrame, label: str = "CHURN", trees: int = 100, max_depth: int = 30, seed: int = 42
) -> PipelineModel:
    """Forest of Gini trees on bootstrap samples, with two features tried per split.

    The node each row has reached in every tree is kept, and checkpointed now and then if there is a
    checkpoint directory. Otherwise each level would send the trees to all tasks and lead all rows
    down from the roots again. The forest grown is the same.
    """
    forest = RandomForestClassifier(
        numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed, cacheNodeIds=True
    )
    return Pipeline(stages=[*feature_stages(False), forest]).fit(labelled(train, label))


def fit_logistic(
    train: DataFrame, label: str = "CHURN", max_iter: int = 100, weight: str | None = None
) -> PipelineModel:
    """Unpenalised logistic regression on the one-hot segment and the three measures."""
    weights = {"weightCol": weight} if weight else {}
    model = LogisticRegression(regParam=0.0, maxIter=max_iter, tol=1e-9, **weights)
    return Pipeline(stages=[*feature_stages(True), model]).fit(labelled(train, label))


def importances(model: PipelineModel) -> dict[str, float]:
    """Importance of each feature of a fitted tree or forest."""
    values = model.stages[-1].featureImportances.toArray()
    return {name: float(v) for name, v in zip(FEATURES, values)}


def importance_table(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``importances`` as rows: one per feature."""
    return df.sparkSession.createDataFrame(
        list(importances(model).items()), "FEATURE string, IMPORTANCE double"
    )


def tree_sizes(
    train: DataFrame, test: DataFrame, depths: Sequence[int], label: str = "CHURN"
) -> DataFrame:
    """Leaves, and share of wrong predictions on both sets, of a tree per depth."""
    found = []
    for depth in depths:
        model = fit_decision_tree(train, label, max_depth=depth)
        tree = model.stages[-1]
        errors = [_error(predict(model, df, "tree", label=label), label) for df in (train, test)]
        found.append((depth, tree.depth, (tree.numNodes + 1) // 2, *errors))
    return train.sparkSession.createDataFrame(
        found,
        "MAX_DEPTH int, DEPTH int, LEAVES int, TRAIN_ERROR double, TEST_ERROR double",
    )


def _error(predicted: DataFrame, label: str) -> float | None:
    wrong = F.avg((F.col("PREDICTED") != F.col(label)).cast("double"))
    return predicted.agg(wrong).first()[0]


def poisson_weight(id_column: str, seed: int, number: int) -> Column:
    """A Poisson(1) weight of a row in resample ``number``, the same in every run."""
    drawn = F.xxhash64(F.lit(seed), F.lit(number), F.col(id_column))
    uniform = F.pmod(drawn, F.lit(1 << 40)) / F.lit(float(1 << 40))
    limits, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, 18):
        total += term
        limits.append(total)
        term /= k
    return reduce(add, [(uniform >= limit).cast("int") for limit in limits]).cast("double")


def resampled_accuracy(
    train: DataFrame,
    resamples: int = 25,
    label: str = "CHURN",
    id_column: str = "ID_CLI",
    seed: int = 42,
) -> DataFrame:
    """Accuracy of the logistic model on what each resample with replacement leaves out.

    A resample is a Poisson(1) weight per row, drawn from a hash of id, seed and number, so no row
    is copied and every run draws the same; rows of weight 0 are left out.
    """
    found = []
    for number in range(resamples):
        weighted = train.withColumn("__weight", poisson_weight(id_column, seed, number))
        model = fit_logistic(weighted.where("__weight > 0"), label, weight="__weight")
        left_out = predict(model, weighted.where("__weight = 0"), "logistic", id_column, label)
        hit = F.avg((F.col("PREDICTED") == F.col(label)).cast("double"))
        rows, accuracy = left_out.agg(F.count(F.lit(1)), hit).first()
        found.append((number, rows, accuracy))
    return train.sparkSession.createDataFrame(found, "RESAMPLE int, LEFT_OUT long, ACCURACY double")


def logistic_coefficients(
    train: DataFrame, label: str = "CHURN", reg_param: float = 0.0
) -> DataFrame:
    """Coefficient, standard error, z value and p value per term of the binomial model.

    The most frequent segment is the reference level. Weighted least squares needs terms that are
    not collinear; levels absent from ``train`` have no term. ``separated`` marks terms that decide
    the label alone (`separated_terms`): they have no finite estimate, and what is reported for them
    is where the iterations stopped. A reference level that decides it marks the intercept.
    """
    data = labelled(train, label)
    indexer = StringIndexer(inputCol="segment", outputCol="segment_index").fit(data)
    levels = indexer.labels
    terms = [
        F.when(F.col("segment") == level, 1.0).otherwise(0.0).alias(f"segment={level}")
        for level in levels[1:]
    ]
    names = [*[f"segment={level}" for level in levels[1:]], *NUMERIC_FEATURES]
    rows = data.select("label", *terms, *NUMERIC_FEATURES)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", regParam=reg_param, maxIter=25
    ).fit(assembled)
    summary = model.summary
    # statistics list the coefficients first and the intercept last
    estimates = [*model.coefficients.toArray().tolist(), model.intercept]
    decided = {r["TERM"] for r in separated_terms(train, label).select("TERM").collect()}
    if f"segment={levels[0]}" in decided:
        decided.add("(Intercept)")
    if reg_param:
        table = [(t, float(e), None, None, None) for t, e in zip([*names, "(Intercept)"], estimates)]
    else:
        table = [
            (term, float(e), float(se), float(z), float(pv))
            for term, e, se, z, pv in zip(
                [*names, "(Intercept)"],
                estimates,
                summary.coefficientStandardErrors,
                summary.tValues,
                summary.pValues,
            )
        ]
    schema = "term string, estimate double, std_error double, z_value double, p_value double"
    marked = [(*row, row[0] in decided) for row in table]
    return train.sparkSession.createDataFrame(marked, f"{schema}, separated boolean")


def separated_terms(df: DataFrame, label: str = "CHURN") -> DataFrame:
    """Terms whose logistic estimate is not finite: TERM, CLASS, KIND and N_ROWS.

    A segment all of whose rows are of one class decides it (KIND ``level``). A measure whose values
    in one class all lie above those in the other separates the classes, ``complete`` or, if the two
    ranges touch, ``quasi``; CLASS is the one above. One pass counts the classes per segment and takes
    the measures' ranges per class. A label of one class separates nothing. Separation by several
    measures together is not looked for.
    """
    cells = df.groupBy(F.col("segment"), F.col(label).cast("int").alias("__class")).agg(
        F.count(F.lit(1)).alias("__n"),
        *[f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in NUMERIC_FEATURES for n, f in (("low", F.min), ("high", F.max))],
    )
    levels = (
        cells.where("segment IS NOT NULL")
        .groupBy("segment")
        .agg(F.count_distinct("__class").alias("__classes"), F.min("__class").alias("CLASS"), F.sum("__n").alias("N_ROWS"))
        .where("__classes = 1")
        .select(F.concat(F.lit("segment="), "segment").alias("TERM"), "CLASS", F.lit("level").alias("KIND"), "N_ROWS")
    )
    by_class = [
        f(F.when(F.col("__class") == k, F.col(f"__{n}_{c}"))).alias(f"{n}_{k}_{c}")
        for c in NUMERIC_FEATURES
        for n, f in (("low", F.min), ("high", F.max))
        for k in (0, 1)
    ]
    ranges = cells.agg(F.sum("__n").alias("N_ROWS"), F.count_distinct("__class").alias("__classes"), *by_class)
    found = [levels]
    for c in NUMERIC_FEATURES:
        for above in (1, 0):
            low, high = F.col(f"low_{above}_{c}"), F.col(f"high_{1 - above}_{c}")
            kind = F.when(low > high, "complete").when(low == high, "quasi")
            # A measure of one value only separates nothing.
            spread = F.col(f"high_{above}_{c}") > F.col(f"low_{1 - above}_{c}")
            found.append(
                ranges.where(kind.isNotNull() & spread).select(
                    F.lit(c).alias("TERM"), F.lit(above).alias("CLASS"), kind.alias("KIND"), "N_ROWS"
                )
            )
    classes = df.agg(F.count_distinct(label)).scalar()
    return reduce(DataFrame.unionByName, found).where(classes > 1)


def predict(
    model: PipelineModel, df: DataFrame, name: str, id_column: str = "ID_CLI", label: str = "CHURN"
) -> DataFrame:
    """Class and probability of class 0 (the customer stays) for each row."""
    return model.transform(df).select(
        id_column,
        F.lit(name).alias("MODEL"),
        F.col(label).cast("int").alias(label),
        F.col("prediction").cast("int").alias("PREDICTED"),
        vector_to_array("probability")[0].alias("P_STAY"),
    )
