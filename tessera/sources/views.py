"""The seven inputs derived from the star-schema parquet tables in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.csv import with_event_times


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def fidelity(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "orders").selectExpr(
        "o_custkey AS ID_CLI",
        "o_orderkey AS ID_FID",
        "nullif(o_orderpriority, '4-NOT SPECIFIED') AS COD_FID",
        "CASE WHEN o_totalprice > 150000 THEN '1' ELSE '0' END AS TYP_CLI_FID",
        "o_orderstatus AS STATUS_FID",
        "o_orderkey % 50 AS ID_NEG",
        "CAST(o_orderdate AS DATE) AS DT_ACTIVE",
    )


def account(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "customer").where("c_custkey % 23 != 4").selectExpr(
        "c_custkey AS ID_CLI",
        "CAST(c_nationkey AS BIGINT) AS ID_ADDRESS",
        "CASE WHEN c_custkey % 17 != 0 THEN"
        " concat('prov', CAST(c_custkey % (1 + c_custkey % 40) AS STRING)) END AS EMAIL_PROVIDER",
        "CASE WHEN c_acctbal > 5000 THEN '1' END AS W_PHONE",
        "c_nationkey % 3 AS TYP_CLI_ACCOUNT",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN 'Non Dichiara'"
        " ELSE c_mktsegment END AS TYP_JOB",
    )


def address(spark: SparkSession, directory: str) -> DataFrame:
    places = table(spark, directory, "nation").join(
        table(spark, directory, "region"), F.expr("n_regionkey = r_regionkey")
    )
    shared = [
        "CAST(n_nationkey AS BIGINT) AS ID_ADDRESS",
        "lpad(CAST(n_nationkey * 137 AS STRING), 5, '0') AS CAP",
    ]
    first = places.selectExpr(
        *shared,
        "CASE WHEN n_nationkey = 7 THEN 'NA' WHEN n_nationkey % 6 = 5 THEN NULL"
        " ELSE n_name END AS PRV",
        "r_name AS REGION",
    )
    repeated = places.where("n_nationkey < 5").selectExpr(
        *shared, "n_name AS PRV", "r_name AS REGION"
    )
    return first.unionByName(repeated)


def privacy(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "customer").where("c_custkey % 29 != 6").selectExpr(
        "c_custkey AS ID_CLI",
        "CAST(c_custkey % 2 AS INT) AS FLAG_PRIVACY_1",
        "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS FLAG_PRIVACY_2",
        "CASE WHEN c_acctbal > 2500 THEN 1 ELSE 0 END AS FLAG_DIRECT_MKT",
    )


def campaign(spark: SparkSession, directory: str) -> DataFrame:
    return (
        table(spark, directory, "nation")
        .join(table(spark, directory, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "CAST(n_nationkey AS BIGINT) AS ID_CAMP",
            "r_name AS TYP_CAMP",
            "'EMAIL' AS CHANNEL_CAMP",
        )
    )


def event(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events").selectExpr(
        "event_id AS ID_EVENT",
        "user_id AS ID_CLI",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS K",
        "CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'V' WHEN 'click' THEN 'C'"
        " WHEN 'error' THEN 'E' ELSE 'B' END AS TYP_EVENT",
        "CAST(ts AS TIMESTAMP_NTZ) AS EVENT_DATETIME",
    )
    return with_event_times(
        events.selectExpr(
            "ID_EVENT",
            "ID_CLI",
            "K % 20 AS ID_CAMP",
            "K % 2 AS ID_DELIVERY",
            "TYP_EVENT",
            "EVENT_DATETIME",
        )
    )


def ticket(spark: SparkSession, directory: str, items: bool = False) -> DataFrame:
    """Ticket lines; ``items`` adds the department and group of the article from its own table.

    Some lines have no customer and some no amount.
    """
    lines = table(spark, directory, "lineitem").join(
        table(spark, directory, "orders"), F.expr("l_orderkey = o_orderkey")
    )
    of_item = []
    if items:
        lines = lines.join(table(spark, directory, "part"), F.expr("l_partkey = p_partkey"))
        of_item = ["p_brand AS COD_REPARTO", "p_type AS ITEM_GROUP"]
    gross = "CASE WHEN l_orderkey % 89 != 3 THEN l_extendedprice / 100 END"
    return lines.selectExpr(
        "l_orderkey AS ID_SCONTRINO",
        "CASE WHEN o_custkey % 50 != 7 THEN o_custkey END AS ID_CLI",
        "l_partkey AS ID_ARTICOLO",
        *of_item,
        "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DIREZIONE",
        f"CASE WHEN l_returnflag = 'R' THEN -({gross}) ELSE {gross} END AS IMPORTO_LORDO",
        "l_extendedprice / 100 * l_discount AS SCONTO",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 24 AS INT))"
        " AS TIC_DATETIME",
        "CAST(o_orderdate AS DATE) AS TIC_DATE",
        "CAST(o_orderkey % 24 AS INT) AS TIC_HOUR",
    )
