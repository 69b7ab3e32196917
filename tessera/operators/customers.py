"""Customer snapshot, account and address cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.nulls import fill_levels
from tessera.operators.quality import complete_cases


def customer_snapshot(subscriptions: DataFrame, strict_na: bool = False) -> DataFrame:
    """One row per customer from the first and last subscription.

    First is the earliest date, then the lowest ID_FID; last is the latest date, then the highest
    ID_FID. Customers without a dated subscription have no row; with ``strict_na`` neither have
    those with any undated one. Comparing structs gives date, tiebreak and payload at once. The
    first step is per subscription, so a frequent customer's rows meet only after they are few.
    """
    dated = F.col("DT_ACTIVE").isNotNull()
    last = F.struct("DT_ACTIVE", "ID_FID", "COD_FID", "TYP_CLI_FID", "STATUS_FID")
    first = F.struct("DT_ACTIVE", "ID_FID", "ID_NEG")
    found = (
        subscriptions.groupBy("ID_CLI", "ID_FID")
        .agg(
            F.max(F.when(dated, last)).alias("LAST"),
            F.min(F.when(dated, first)).alias("FIRST"),
            F.count_if(~dated).alias("UNDATED"),
        )
        .groupBy("ID_CLI")
        .agg(
            F.max("LAST").alias("LAST"),
            F.min("FIRST").alias("FIRST"),
            F.count(F.lit(1)).alias("NUM_FIDs"),
            F.sum("UNDATED").alias("UNDATED"),
        )
        .where(F.col("LAST").isNotNull())
    )
    if strict_na:
        found = found.where("UNDATED = 0")
    return found.select(
        "ID_CLI",
        F.col("LAST.ID_FID").alias("ID_FID"),
        F.col("LAST.COD_FID").alias("LAST_COD_FID"),
        F.col("LAST.TYP_CLI_FID").alias("LAST_TYP_CLI_FID"),
        F.col("LAST.STATUS_FID").alias("LAST_STATUS_FID"),
        F.col("LAST.DT_ACTIVE").alias("LAST_DT_ACTIVE"),
        F.col("FIRST.ID_NEG").alias("FIRST_ID_NEG"),
        F.col("FIRST.DT_ACTIVE").alias("FIRST_DT_ACTIVE"),
        "NUM_FIDs",
    )


def clean_accounts(accounts: DataFrame) -> DataFrame:
    """Missing phone flags mean ``0``; missing providers and jobs become a level of their own."""
    return fill_levels(
        accounts, {"W_PHONE": "0", "EMAIL_PROVIDER": "(missing)", "TYP_JOB": "(missing)"}
    )


def clean_addresses(addresses: DataFrame) -> DataFrame:
    """Distinct rows with postal code, province and region all present."""
    typed = addresses.withColumn("CAP", F.col("CAP").cast("string"))
    return complete_cases(typed, ["CAP", "PRV", "REGION"]).distinct()
