"""Reader for the ``;``-separated extracts with a decimal comma."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.times import EVENT_TIME, TICKET_TIME, parse_date, parse_timestamp
from tessera.sources import schemas


class Extract(NamedTuple):
    """The rows of an extract that parse, and the lines that do not with their file and reason."""

    rows: DataFrame
    rejected: DataFrame


#: Names of what the parser adds; no extract has them.
_LINE, _FILE = "__line", "__file"


def _reader(spark: SparkSession, missing: str | None) -> DataFrameReader:
    reader = (
        spark.read.option("sep", ";")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("locale", "it-IT")
    )
    return reader if missing is None else reader.option("nullValue", missing)


def _files_by_header(
    spark: SparkSession, path: str | Sequence[str], missing: str | None
) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header line; reads one line of each, and skips empty files."""
    found: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.text(path).inputFiles()):
        if header := tuple(_reader(spark, missing).csv(file).columns):
            found.setdefault(header, []).append(file)
    return found


def _parsed(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, missing: str | None
) -> DataFrame:
    """Columns of ``schema``, found by name in each file, with the line if something does not parse."""
    files = _files_by_header(spark, path, missing)
    parts = []
    for header, paths in files.items():
        absent = [name for name in schema.names if name not in header]
        if absent:
            raise ValueError(f"{paths[0]} lacks the columns {absent}")
        declared = {field.name: field for field in schema.fields}
        kinds = [declared.get(name, T.StructField(name, T.StringType())) for name in header]
        in_file_order = T.StructType([*kinds, T.StructField(_LINE, T.StringType())])
        raw = (
            _reader(spark, missing)
            .schema(in_file_order)
            # all fields of a line are counted
            .option("columnPruning", False)
            .option("columnNameOfCorruptRecord", _LINE)
            .csv(paths)
        )
        # a quoted empty field arrives as empty text
        columns = [
            F.nullif(F.col(name), F.lit("")).alias(name)
            if isinstance(field.dataType, T.StringType)
            else F.col(name)
            for name, field in declared.items()
        ]
        fields = F.size(F.split(F.regexp_replace(_LINE, r'"(?:[^"]|"")*"', ""), ";", -1))
        texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
        told = F.from_csv(F.col(_LINE), texts.simpleString()[7:-1].replace(":", " "), {"sep": ";", "escape": '"'})
        typed = [f for f in kinds if f.name in declared and not isinstance(f.dataType, T.StringType)]
        # Only fields that are read are parsed, so the line is read with all that may not parse.
        every = F.concat_ws("", *[F.col(n).cast("string") for n in {header[0]: 0, **{f.name: 0 for f in typed}}])
        line = F.when(F.length(every) >= 0, F.col(_LINE))
        wrong = [
            F.when(
                F.col(f.name).isNull() & (F.coalesce(told[f.name], F.lit("")) != "") & ~told[f.name].eqNullSafe(F.lit(missing)),
                F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), told[f.name]),
            )
            for f in typed
        ]
        reason = F.when(
            fields != len(header),
            F.concat(fields.cast("string"), F.lit(f" fields, the header has {len(header)}")),
        ).otherwise(F.coalesce(F.nullif(F.concat_ws("; ", *wrong), F.lit("")), F.lit("does not parse")))
        parts.append(
            raw.select(
                *columns,
                F.col("_metadata.file_path").alias(_FILE),
                line.alias(_LINE),
                F.when(line.isNotNull(), reason).alias("__reason"),
            )
        )
    if not parts:
        raise ValueError(f"{path} has no file with a header")
    return reduce(DataFrame.unionByName, parts)


def read_checked_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, missing: str | None = "NA"
) -> Extract:
    """Read as ``read_european_csv`` does, with lines that do not parse set apart.

    ``rejected`` holds FILE, LINE and REASON of each line with another number of fields than its
    header, or with a field that is no value of its declared type: the fields are named with their
    text. No line is in both, none in neither; blank lines are no lines.
    """
    parsed = _parsed(spark, path, schema, missing)
    rows = parsed.where(F.col(_LINE).isNull()).select(*schema.names)
    rejected = parsed.where(F.col(_LINE).isNotNull()).select(
        F.col(_FILE).alias("FILE"), F.col(_LINE).alias("LINE"), F.col("__reason").alias("REASON")
    )
    return Extract(rows, rejected)


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """Rejected lines per file and reason, field texts left out, most frequent first."""
    kind = F.regexp_replace("REASON", r"(is no [^:;]+): [^;]*", "$1")
    counts = rejected.groupBy("FILE", kind.alias("REASON")).agg(F.count(F.lit(1)).alias("N_LINES"))
    return counts.orderBy(F.desc("N_LINES"), "FILE", "REASON")


def read_european_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, missing: str | None = "NA"
) -> DataFrame:
    """Read the columns of ``schema`` by header name; other columns of the file are skipped.

    Each file of a path has a header of its own, so files may differ in the order of their columns;
    a file that lacks one fails. An empty field is always NULL. ``missing`` is one more text read as
    NULL; pass ``None`` where that text is a real value (``NA`` is a province code in the address
    file). The decimal comma is read by the locale, which applies to decimal columns, so money is
    declared as decimal. A field that does not parse is NULL here; ``read_checked_csv`` sets its line
    apart.
    """
    return _parsed(spark, path, schema, missing).select(*schema.names)


def read_fidelity(spark: SparkSession, path: str) -> DataFrame:
    raw = read_european_csv(spark, path, schemas.FIDELITY)
    return raw.withColumn("DT_ACTIVE", parse_date("DT_ACTIVE"))


def read_account(spark: SparkSession, path: str) -> DataFrame:
    return read_european_csv(spark, path, schemas.ACCOUNT)


def read_address(spark: SparkSession, path: str) -> DataFrame:
    return read_european_csv(spark, path, schemas.ADDRESS, missing=None)


def read_privacy(spark: SparkSession, path: str) -> DataFrame:
    return read_european_csv(spark, path, schemas.PRIVACY)


def read_campaign(spark: SparkSession, path: str) -> DataFrame:
    return read_european_csv(spark, path, schemas.CAMPAIGN)


def read_event(spark: SparkSession, path: str) -> DataFrame:
    raw = read_european_csv(spark, path, schemas.EVENT)
    return with_event_times(
        raw.withColumn("EVENT_DATETIME", parse_timestamp("EVENT_DATE", EVENT_TIME))
    )


def read_ticket(spark: SparkSession, path: str) -> DataFrame:
    raw = read_european_csv(spark, path, schemas.TICKET)
    timed = raw.withColumn("TIC_DATETIME", parse_timestamp("DATETIME", TICKET_TIME))
    return with_ticket_times(timed).drop("DATETIME")


def with_event_times(events: DataFrame) -> DataFrame:
    """Hour and date of each email event."""
    return events.withColumns(
        {"EVENT_HOUR": F.hour("EVENT_DATETIME"), "EVENT_DATE": F.to_date("EVENT_DATETIME")}
    )


def with_ticket_times(tickets: DataFrame) -> DataFrame:
    """Hour and date of each ticket line."""
    return tickets.withColumns(
        {"TIC_HOUR": F.hour("TIC_DATETIME"), "TIC_DATE": F.to_date("TIC_DATETIME")}
    )
