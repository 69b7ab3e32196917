"""Evaluation of classifiers: confusion matrix, gain and lift, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.nulls import null_safe_join
from tessera.functions.ordered import running_total
from tessera.operators.distribution import union_all


def confusion_matrix(
    predictions: DataFrame, predicted: str, actual: str, positive: int | str = 0
) -> DataFrame:
    """One row: the four counts and the measures derived from them, for two classes."""
    said, is_positive = F.col(predicted) == positive, F.col(actual) == positive

    def share(a: str, b: str) -> Column:
        return F.try_divide(F.expr(a), F.expr(b))

    chance = "((TP + FP) * (TP + FN) + (FN + TN) * (FP + TN)) / CAST(N AS DOUBLE) / N"
    return (
        predictions.agg(
            F.count_if(said & is_positive).alias("TP"),
            F.count_if(said & ~is_positive).alias("FP"),
            F.count_if(~said & is_positive).alias("FN"),
            F.count_if(~said & ~is_positive).alias("TN"),
        )
        .withColumn("N", F.expr("TP + FP + FN + TN"))
        .withColumn("ACCURACY", share("TP + TN", "N"))
        .withColumn("EXPECTED", F.expr(f"CASE WHEN N > 0 THEN {chance} END"))
        .withColumns(
            {
                "KAPPA": share("ACCURACY - EXPECTED", "1 - EXPECTED"),
                "SENSITIVITY": share("TP", "TP + FN"),
                "SPECIFICITY": share("TN", "TN + FP"),
                "PPV": share("TP", "TP + FP"),
                "NPV": share("TN", "TN + FN"),
                "PREVALENCE": share("TP + FN", "N"),
            }
        )
        .drop("EXPECTED")
    )


def accuracy_table(
    predictions: dict[str, DataFrame], predicted: str, actual: str
) -> DataFrame:
    """Accuracy per model name."""
    return union_all(
        *[
            confusion_matrix(df, predicted, actual).select(
                F.lit(name).alias("MODELS"), "ACCURACY"
            )
            for name, df in predictions.items()
        ]
    )


def ranked_scores(
    predictions: DataFrame, score: str, target: str, positive: int | str
) -> DataFrame:
    """Per distinct score, highest first: rows N and positives P, summed from the top and overall.

    Equal scores are one row, so a tree that gives a third of the customers the same score does
    not fill a task.
    """
    hit = F.col(target) == positive
    counts = (
        predictions.where(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("SCORE"))
        .agg(F.count(F.lit(1)).alias("N"), F.count_if(hit).alias("P"))
    )
    return running_total(counts, ["SCORE DESC"], {"N_TOP": "N", "P_TOP": "P"})


def gain_lift(
    predictions: DataFrame, score: str, target: str, positive: int | str = 1, segments: int = 10
) -> DataFrame:
    """Gain and lift of the best-scored 1/segments, 2/segments, ... of the rows.

    Gain is the share of all positives found, lift is gain over the share of rows looked at. A cut
    inside a group of equal scores takes the same part of the group's positives as of its rows.
    """

    def cut(k: Column) -> Column:
        return F.ceil(k * F.col("N_TOP_ALL") / F.lit(segments))

    def in_this_group(k: Column) -> Column:
        return (cut(k) > F.col("N_TOP") - F.col("N")) & (cut(k) <= F.col("N_TOP"))

    numbers = F.array(*[F.lit(k) for k in range(1, segments + 1)])
    found = (F.col("P_TOP") - F.col("P")) + F.col("P") * (
        F.col("CUT") - (F.col("N_TOP") - F.col("N"))
    ) / F.col("N")
    # every cut lies in one group of scores, so this leaves `segments` rows in all
    return (
        ranked_scores(predictions, score, target, positive)
        .withColumn("K", F.explode(F.filter(numbers, in_this_group)))
        .withColumn("CUT", cut(F.col("K")))
        .select(
            (F.col("K") * F.lit(100.0) / F.lit(segments)).alias("POPULATION"),
            F.try_divide(F.lit(100.0) * found, F.col("P_TOP_ALL")).alias("GAIN"),
            F.try_divide(
                found * F.col("N_TOP_ALL"), F.col("P_TOP_ALL") * F.col("CUT")
            ).alias("LIFT"),
            F.col("SCORE").alias("SCORE_POINT"),
        )
    )


def roc_points(
    predictions: DataFrame, score: str, target: str, positive: int | str = 1
) -> DataFrame:
    """True and false positive rate at each distinct score used as the threshold."""
    ranked = ranked_scores(predictions, score, target, positive)
    return ranked.select(
        "SCORE",
        F.try_divide("P_TOP", "P_TOP_ALL").alias("TPR"),
        F.try_divide(
            F.col("N_TOP") - F.col("P_TOP"), F.col("N_TOP_ALL") - F.col("P_TOP_ALL")
        ).alias("FPR"),
    )


def auc(
    predictions: DataFrame, score: str, target: str, positive: int | str = 1
) -> DataFrame:
    """Area under the ROC curve by trapezoids, exact: one row AUC."""
    ranked = ranked_scores(predictions, score, target, positive)
    negatives = F.col("N") - F.col("P")
    # each negative is passed by the positives scored above it, and by half of its ties
    passed = negatives * (F.col("P_TOP") - F.col("P") / F.lit(2.0))
    return ranked.agg(
        F.try_divide(F.sum(passed), F.sum("P").cast("double") * F.sum(negatives)).alias("AUC")
    )


def score_table(
    predictions: dict[str, DataFrame], column: str, id_column: str, label: str
) -> DataFrame:
    """One row per id with its label and a column per model, named after it."""
    names = list(predictions)
    whole = predictions[names[0]].select(id_column, label, F.col(column).alias(names[0]))
    for name in names[1:]:
        whole = null_safe_join(
            whole, predictions[name].select(id_column, F.col(column).alias(name)), [id_column]
        )
    return whole
