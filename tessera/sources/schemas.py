"""Declared schemas of the seven extracts. Text forms of dates stay text until parsed."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FIDELITY = _table(
    ID_CLI=T.LongType(),
    ID_FID=T.LongType(),
    COD_FID=T.StringType(),
    TYP_CLI_FID=T.StringType(),
    STATUS_FID=T.StringType(),
    ID_NEG=T.LongType(),
    DT_ACTIVE=T.StringType(),
)
ACCOUNT = _table(
    ID_CLI=T.LongType(),
    EMAIL_PROVIDER=T.StringType(),
    W_PHONE=T.StringType(),
    ID_ADDRESS=T.LongType(),
    TYP_CLI_ACCOUNT=T.StringType(),
    TYP_JOB=T.StringType(),
)
# Postal codes are text: as numbers they would lose their leading zeros.
ADDRESS = _table(
    ID_ADDRESS=T.LongType(),
    CAP=T.StringType(),
    PRV=T.StringType(),
    REGION=T.StringType(),
)
PRIVACY = _table(
    ID_CLI=T.LongType(),
    FLAG_PRIVACY_1=T.StringType(),
    FLAG_PRIVACY_2=T.StringType(),
    FLAG_DIRECT_MKT=T.StringType(),
)
CAMPAIGN = _table(
    ID_CAMP=T.LongType(),
    TYP_CAMP=T.StringType(),
    CHANNEL_CAMP=T.StringType(),
)
EVENT = _table(
    ID_EVENT=T.LongType(),
    ID_CLI=T.LongType(),
    ID_CAMP=T.LongType(),
    ID_DELIVERY=T.LongType(),
    TYP_EVENT=T.StringType(),
    EVENT_DATE=T.StringType(),
)
TICKET = _table(
    ID_SCONTRINO=T.LongType(),
    ID_CLI=T.LongType(),
    ID_ARTICOLO=T.LongType(),
    COD_REPARTO=T.StringType(),
    DIREZIONE=T.StringType(),
    IMPORTO_LORDO=MONEY,
    SCONTO=MONEY,
    DATETIME=T.StringType(),
)
