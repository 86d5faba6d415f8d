"""Calendar periods: truncation to a period's first day, and filling gaps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("day", "week", "month")

# Metadata of a column that holds the first day of the month of ``event_day``.
MONTH_MARK = {"ferrybook_month_of": "event_day"}


def _check(unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, got {unit!r}")


def period_start(day: Column, unit: str) -> Column:
    """First day of the day, week (from Monday) or month that holds ``day``.

    ``trunc`` stays on dates. ``date_trunc`` would go through a timestamp and
    so depend on the session's time zone.
    """
    _check(unit)
    return day.cast("date") if unit == "day" else F.trunc(day, unit)


def fill_gaps(periods: DataFrame, unit: str) -> DataFrame:
    """Add the periods that are missing between the first and the last, as zeros.

    ``periods`` has one row per ``period``; all its other columns are measures.
    Each row is stretched up to the row that follows it, so no second pass over
    the input is needed to find the range. The window runs in one task, which
    sees one row per calendar period, whatever the number of transfers.
    """
    _check(unit)
    step = F.expr(f"interval 1 {unit}")
    period = F.col("period")
    following = F.lead("period").over(Window.orderBy("period"))
    until = F.coalesce((following - step).cast("date"), period)
    stretched = periods.withColumn("_until", until).withColumn(
        # The outer form keeps the row of transfers without a day.
        "_slot",
        F.explode_outer(F.sequence(period, F.col("_until"), step)),
    )
    original = F.col("_slot").eqNullSafe(period)
    measures = [
        F.when(original, F.col(f.name)).otherwise(F.lit(0).cast(f.dataType)).alias(f.name)
        for f in periods.schema
        if f.name != "period"
    ]
    return stretched.select(F.col("_slot").alias("period"), *measures)
