import pytest
from helpers import rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import churn, evaluation, rfm

TABLE = "customer_id long, number_of_orders long, revenue double, recency_days int"


def test_customer_table(spark, day):
    df = spark.createDataFrame(
        [
            (1, 1, 10.0, day("2019-12-01")),
            (1, 1, 20.0, day("2019-12-21")),
            (2, 1, -5.0, day("2019-12-30")),
            (3, 2, 7.0, day("2019-12-31")),
            (3, 2, -7.0, day("2019-12-31")),
            (1, 2, -1.0, day("2019-12-26")),
        ],
        "ID_CLI long, ID_SCONTRINO long, IMPORTO_LORDO double, TIC_DATE date",
    )
    found = rfm.rfm_customer_table(df)
    assert rows(found, "customer_id", "number_of_orders", "revenue", "recency_days") == [(1, 3, 29.0, 5)]
    by_ticket = rfm.rfm_customer_table(df, frequency="tickets")
    assert rows(by_ticket, "customer_id", "number_of_orders") == [(1, 2)]


@pytest.mark.parametrize(
    "values, frequency, recency",
    [
        ([1, 2, 4, 10], [1, 2, 4, 5], [5, 4, 2, 1]),
        ([5, 5, 5, 5], [5, 5, 5, 5], [1, 1, 1, 1]),
    ],
)
def test_scores(spark, values, frequency, recency):
    df = spark.createDataFrame([(i, v, float(v), v) for i, v in enumerate(values)], TABLE)
    found = rfm.rfm_score(df)
    wanted = sorted(zip(range(4), frequency, recency, frequency))
    assert rows(found, "customer_id", "frequency_score", "recency_score", "monetary_score") == wanted
    assert rows(found, "rfm_score") == sorted(
        (100 * r + 11 * f,) for f, r in zip(frequency, recency)
    )


def test_approximate_scores_stay_close(spark):
    df = spark.range(1000).selectExpr(
        "id AS customer_id", "id AS number_of_orders", "id * 1.0D AS revenue", "CAST(id AS INT) AS recency_days"
    )
    exact = rfm.rfm_score(df).select("customer_id", F.col("rfm_score").alias("a"))
    rough = rfm.rfm_score(df, approx=True).select("customer_id", F.col("rfm_score").alias("b"))
    assert exact.join(rough, "customer_id").where("a != b").count() <= 10


@pytest.mark.parametrize(
    "order, expected",
    [
        ("first", ["Champions", "At Risk", "Lost", "Others"]),
        ("last", ["Loyal Customers", "Can't Lose Them", "Lost", "Others"]),
    ],
)
def test_segments(spark, order, expected):
    df = spark.createDataFrame(
        [(0, 5, 5, 5), (1, 1, 5, 5), (2, 1, 1, 1), (3, 5, 1, 5)],
        "i int, recency_score int, frequency_score int, monetary_score int",
    )
    assert [s for _, s in rows(rfm.rfm_segment(df, on_overlap=order), "i", "segment")] == expected


@pytest.mark.parametrize("order", ["first", "last"])
def test_rules_as_a_table_are_the_chain(spark, order):
    cells = spark.range(6 * 6 * 6).selectExpr(
        "CAST(id div 36 AS INT) AS recency_score",
        "CAST(id div 6 % 6 AS INT) AS frequency_score",
        "IF(id % 6 = 0, NULL, CAST(id % 6 AS INT)) AS monetary_score",
        "'old' AS segment",
        "id AS R",
    )
    chain = rfm.rfm_segment(cells, on_overlap=order)
    joined = rfm.rfm_segment(cells, rfm.segment_rules_table(spark), order)
    assert sorted(map(str, joined.select(chain.columns).collect())) == sorted(map(str, chain.collect()))


def test_rule_table_with_open_empty_and_equal_boxes(spark):
    kind = rfm.segment_rules_table(spark).schema
    rules = spark.createDataFrame(
        [
            (1, "open", None, 2, None, None, 4, None),
            (2, "upside down", 5, 1, 1, 5, 1, 5),
            (3, "zebra", 3, 9, -4, 5, 1, 1),
            (3, "ant", 3, 3, 1, 5, 1, 1),
            (None, "nothing", 1, 5, 1, 5, 1, 5),
            (4, "outside", 6, 8, 1, 5, 1, 5),
            (5, None, 5, 5, 5, 5, 5, 5),
        ],
        kind,
    )
    scores = spark.createDataFrame(
        [(0, 1, 3, 5), (1, 3, 1, 1), (2, 4, 1, 1), (3, 5, 5, 5), (4, 2, 2, 2), (5, None, 1, 5)],
        "i int, recency_score int, frequency_score int, monetary_score int",
    )
    found = rows(rfm.rfm_segment(scores, rules, other="none"), "i", "segment")
    assert found == [(0, "open"), (1, "ant"), (2, "zebra"), (3, "none"), (4, "none"), (5, "none")]
    nothing = rfm.rfm_segment(scores, rules.where("false"), other="none")
    assert {r["segment"] for r in nothing.collect()} == {"none"} and nothing.count() == 6
    plan = rfm.rfm_segment(scores, rules, bins=50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_cell_against_the_rule_table(spark):
    cells = spark.range(125).selectExpr(
        "CAST(id div 25 + 1 AS INT) AS recency_score",
        "CAST(id div 5 % 5 + 1 AS INT) AS frequency_score",
        "CAST(id % 5 + 1 AS INT) AS monetary_score",
    )
    table = [tuple(r) for r in rfm.segment_rules_table(spark).orderBy("priority").collect()]
    for row in rfm.rfm_segment(cells).collect():
        r, f, m, segment = row
        hits = [
            t[1] for t in table if t[2] <= r <= t[3] and t[4] <= f <= t[5] and t[6] <= m <= t[7]
        ]
        assert segment == (hits[0] if hits else "Others")


def test_counts_medians_and_matrices(spark):
    df = spark.createDataFrame(
        [(i, i % 9, i * 3 % 50, float(i * 7 % 101), 1 + i % 2, 1, 2, f"s{i % 3}") for i in range(100)],
        "customer_id int, recency_days int, transaction_count int, amount double, recency_score int,"
        " frequency_score int, monetary_score int, segment string",
    )
    assert [tuple(r) for r in rfm.segment_counts(df).collect()] == [("s0", 34), ("s1", 33), ("s2", 33)]
    own = df.groupBy("segment").agg(
        F.median("amount"), F.median("transaction_count"), F.median("recency_days")
    )
    columns = ["segment", "median_monetary", "median_frequency", "median_recency"]
    assert rows(rfm.segment_medians(df), *columns) == rows(own)
    assert rfm.segment_medians(df, approx=True).count() == 3
    assert sum(r["n"] for r in rfm.score_counts(df).collect()) == 100
    assert rfm.monetary_heatmap(df).count() == 2
    assert sum(r["n"] for r in rfm.order_distribution(df).collect()) == 100


def test_churn_label(spark, day):
    scored = spark.createDataFrame(
        [(i, "Lost", 1, 1, 1.0) for i in (1, 2, 3, 4)],
        "customer_id long, segment string, transaction_count long, recency_days int, amount double",
    )
    lines = spark.createDataFrame(
        [
            (1, 5.0, day("2018-10-01")),
            (2, 5.0, day("2018-10-02")),
            (3, 5.0, day("2019-01-01")),
            (4, -5.0, day("2018-11-01")),
        ],
        "ID_CLI long, IMPORTO_LORDO double, TIC_DATE date",
    )
    assert rows(churn.label_churn(scored, lines), "ID_CLI", "CHURN") == [(1, 1), (2, 0), (3, 1), (4, 1)]


def test_stratified_split(spark):
    df = spark.range(2000).selectExpr("id AS ID_CLI", "IF(id < 691, 0, 1) AS CHURN")
    split = churn.stratified_split(df)
    sizes = rows(split.groupBy("CHURN", "IS_TRAIN").count())
    assert sizes == [(0, False, 207), (0, True, 484), (1, False, 392), (1, True, 917)]
    assert split.select("ID_CLI").distinct().count() == 2000
    again = churn.stratified_split(df.repartition(5))
    assert split.join(again, ["ID_CLI", "CHURN", "IS_TRAIN"]).count() == 2000
    other = churn.stratified_split(df, seed=7)
    assert split.join(other, ["ID_CLI", "CHURN", "IS_TRAIN"]).count() < 2000


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(600).selectExpr(
        "id AS ID_CLI",
        "element_at(array('Lost', 'Champions', 'Others'), CAST(id % 3 + 1 AS INT)) AS segment",
        "id % 40 AS transaction_count",
        "CAST(pmod(xxhash64(id), 300) AS INT) AS recency_days",
        "CAST(id * 13 % 997 AS DOUBLE) AS amount",
        "IF(pmod(xxhash64(id), 300) + pmod(xxhash64(id, 1), 60) > 170, 1, 0) AS CHURN",
    )


def test_models_learn_and_give_probabilities(labelled):
    split = churn.stratified_split(labelled).cache()
    train, test = split.where("IS_TRAIN"), split.where("NOT IS_TRAIN")
    models = {
        "tree": churn.fit_decision_tree(train),
        "forest": churn.fit_random_forest(train, trees=20, max_depth=5),
        "logistic": churn.fit_logistic(train),
    }
    predictions = {n: churn.predict(m, test, n) for n, m in models.items()}
    accuracy = {r["MODELS"]: r["ACCURACY"] for r in evaluation.accuracy_table(predictions, "PREDICTED", "CHURN").collect()}
    assert set(accuracy) == set(models) and min(accuracy.values()) > 0.8
    for name, scored in predictions.items():
        assert scored.count() == test.count(), name
        outside = scored.where("P_STAY < 0 OR P_STAY > 1 OR (P_STAY > 0.5) != (PREDICTED = 0)")
        assert outside.where("P_STAY != 0.5").count() == 0
    weights = churn.importances(models["tree"])
    assert max(weights, key=weights.get) == "recency_days"
    assert "recency" in churn.FEATURES[2] and "If" in models["tree"].stages[-1].toDebugString


def test_logistic_coefficients(labelled):
    found = {r["term"]: r for r in churn.logistic_coefficients(labelled).collect()}
    assert len(found) == 2 + 3 + 1
    assert found["recency_days"]["estimate"] > 0 and found["recency_days"]["p_value"] < 0.01
    assert found["amount"]["std_error"] > 0
    assert "(Intercept)" in found


def test_unseen_segment_is_scored(spark, labelled):
    model = churn.fit_logistic(labelled)
    new = spark.createDataFrame([(1, "New Customers", 3, 10, 5.0, 0)], labelled.schema)
    assert churn.predict(model, new, "logistic").count() == 1


def test_confusion_matrix(spark):
    cells = [(0, 0, 40), (1, 0, 10), (0, 1, 20), (1, 1, 30)]
    df = spark.createDataFrame([(p, a) for p, a, n in cells for _ in range(n)], "p int, a int")
    found = evaluation.confusion_matrix(df, "p", "a").collect()[0]
    assert (found["TP"], found["FN"], found["FP"], found["TN"]) == (40, 10, 20, 30)
    assert found["ACCURACY"] == pytest.approx(0.7) and found["KAPPA"] == pytest.approx(0.4)
    assert found["SENSITIVITY"] == 0.8 and found["SPECIFICITY"] == 0.6
    assert found["PPV"] == pytest.approx(40 / 60) and found["NPV"] == 0.75
    assert evaluation.auc(df, "p", "a").collect()[0]["AUC"] == pytest.approx(0.7)
    assert evaluation.roc_points(df, "p", "a").count() == 2


def test_confusion_matrix_without_rows(spark):
    empty = spark.createDataFrame([], "p int, a int")
    found = evaluation.confusion_matrix(empty, "p", "a").collect()[0]
    assert found["N"] == 0 and found["ACCURACY"] is None and found["KAPPA"] is None


def test_gain_and_lift(spark):
    df = spark.createDataFrame([(1.0 - i / 10, int(i in (0, 1, 4))) for i in range(10)], "s double, t int")
    found = rows(evaluation.gain_lift(df, "s", "t"), "POPULATION", "GAIN", "LIFT", "SCORE_POINT")
    gains = [round(g / 100, 6) for _, g, _, _ in found]
    assert gains == [round(x, 6) for x in [1 / 3, 2 / 3, 2 / 3, 2 / 3, 1, 1, 1, 1, 1, 1]]
    assert [round(found[i][2], 2) for i in (0, 4, 9)] == [3.33, 2.0, 1.0]
    assert found[0][3] == 1.0 and found[9][3] == pytest.approx(0.1)


def test_gain_with_ties_is_proportional(spark):
    df = spark.createDataFrame([(1.0, i % 2) for i in range(100)], "s double, t int")
    found = rows(evaluation.gain_lift(df, "s", "t"), "POPULATION", "GAIN", "LIFT")
    assert [(p, round(g, 6), round(x, 6)) for p, g, x in found] == [
        (10.0 * k, 10.0 * k, 1.0) for k in range(1, 11)
    ]


def test_auc_agrees_with_library(spark):
    df = spark.range(500).selectExpr(
        "pmod(xxhash64(id), 50) / 50.0D AS s",
        "CAST(pmod(xxhash64(id), 50) + pmod(xxhash64(id, 3), 40) > 45 AS INT) AS t",
    )
    raw = df.select(
        F.col("t").cast("double").alias("label"),
        array_to_vector(F.array(1 - F.col("s"), F.col("s"))).alias("rawPrediction"),
    )
    expected = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    assert evaluation.auc(df, "s", "t").collect()[0]["AUC"] == pytest.approx(expected, abs=1e-9)
