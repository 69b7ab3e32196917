"""Italian public holidays and the typing of days."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Italian public holidays on a fixed day, as (month, day, first year).
FIXED_HOLIDAYS = (
    (1, 1, 1),
    (1, 6, 1),
    (4, 25, 1),
    (5, 1, 1),
    (6, 2, 2000),
    (8, 15, 1),
    (11, 1, 1),
    (12, 8, 1),
    (12, 25, 1),
    (12, 26, 1),
)
# Fixed value: a closing day of one year only.
SINGLE_HOLIDAYS = ("1999-12-31",)
# Day numbers, 1 = Sunday ... 7 = Saturday.
SUNDAY, MONDAY, FRIDAY, SATURDAY = 1, 2, 6, 7


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter of a year: the Sunday after the first full moon of spring, by its cycles."""
    golden, century = year % 19, _div(year, 100)
    moved = _div(century - _div(century + 8, 25) + 1, 3)
    moon = (19 * golden + century - _div(century, 4) - moved + 15) % 30
    # the latest two moons come a day earlier, the second of them late in the cycle only
    early = (moon + (golden > 10).cast("int") > 28).cast("int")
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), (moon - early).cast("int"))
    return F.next_day(full, "Sunday")


def is_italian_holiday(date: Column) -> Column:
    """Whether a date of any year is a public holiday, from the date alone; NULL for no date."""
    year, month = F.year(date), F.month(date)
    day = 100 * month + F.dayofmonth(date)
    always = [100 * m + d for m, d, since in FIXED_HOLIDAYS if since == 1]
    later = [(day == 100 * m + d) & (year >= since) for m, d, since in FIXED_HOLIDAYS if since > 1]
    fixed = [day.isin(always), *later]
    single = [date == F.lit(d).cast("date") for d in SINGLE_HOLIDAYS]
    # Easter is worked out only for days that may follow it.
    may_be = (F.dayofweek(date) == MONDAY) & month.isin(3, 4)
    easter_monday = F.when(may_be, date == F.date_add(easter_sunday(year), 1)).otherwise(F.lit(False))
    return reduce(or_, [*fixed, *single, easter_monday])


def italian_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row HOLIDAY_DATE per public holiday of the years given, for reports."""
    days = F.sequence(
        F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(last_year), F.lit(12), F.lit(31)),
    )
    dates = spark.range(1).select(F.explode(days).alias("HOLIDAY_DATE"))
    return dates.where(is_italian_holiday(F.col("HOLIDAY_DATE")))


def classify_day(
    df: DataFrame,
    date: str = "TIC_DATE",
    weekend: Sequence[int] = (FRIDAY, SATURDAY),
    holidays: DataFrame | None = None,
    weekend_is_holiday: bool = True,
) -> DataFrame:
    """Add weekday number, holiday flag and day type (weekend, holiday, weekday, other).

    The defaults keep the reported figures: the weekend is Friday and Saturday, and the business
    calendar counts Saturday and Sunday as holidays, so Sundays are typed ``holiday``. For the
    calendar meaning pass ``weekend=(1, 7), weekend_is_holiday=False``. Holidays follow from the
    date itself, in any year, unless a table ``holidays`` (HOLIDAY_DATE) is given.
    """
    number = F.dayofweek(date)
    holiday = is_italian_holiday(F.col(date))
    if holidays is not None:
        known = holidays.select("HOLIDAY_DATE").distinct()
        df = df.join(known, F.col(date) == F.col("HOLIDAY_DATE"), "left")
        holiday = F.col("HOLIDAY_DATE").isNotNull()
    if weekend_is_holiday:
        holiday = holiday | number.isin(SUNDAY, SATURDAY)
    return (
        df.withColumns(
            {
                f"{date}_WEEKDAY": number,
                f"{date}_HOLIDAY": F.when(F.col(date).isNotNull(), holiday),
            }
        )
        .withColumn(
            f"{date}_TYP",
            F.when(F.col(f"{date}_WEEKDAY").isin(*weekend), "weekend")
            .when(F.col(f"{date}_HOLIDAY"), "holiday")
            .when(F.col(f"{date}_WEEKDAY").isNotNull(), "weekday")
            .otherwise("other"),
        )
        .drop("HOLIDAY_DATE")
    )
