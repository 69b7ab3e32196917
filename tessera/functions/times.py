"""Parsing of the text dates and timestamps in the extracts; junk becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nulls import ColumnLike, as_column

# The two text forms of a timestamp.
EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss"
TICKET_TIME = "yyyy-MM-dd'T'HHmmss"
# A fraction of up to nine digits and a zone may follow either form.
FRACTION_AND_ZONE = "[.SSSSSSSSS][XXX]"


def parse_timestamp(column: ColumnLike, form: str = EVENT_TIME) -> Column:
    """Whole text to timestamp, in the session's zone unless the text names one; else NULL."""
    return F.try_to_timestamp(as_column(column), F.lit(form + FRACTION_AND_ZONE))


def parse_date(column: ColumnLike, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to date; day-first text is read with ``pattern="d/M/yyyy"``."""
    return F.try_to_date(as_column(column), pattern)


def year_text(column: ColumnLike) -> Column:
    return F.date_format(as_column(column), "yyyy")
