"""Choosing the transfers a report is about."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrybook.functions.periods import MONTH_MARK


def filter_flows(
    df: DataFrame,
    start: date | None = None,
    end: date | None = None,
    sources: Collection[str] | None = None,
    destinations: Collection[str] | None = None,
) -> DataFrame:
    """Flows with ``start <= event_day < end`` and, if given, only these places.

    Days are compared as a plain range, which reaches the Parquet scan. On a
    table from ``read_flows``, the same range also picks the month directories to
    read. Other columns never matter, whatever their names.
    """
    for bound in (start, end):
        if bound is not None and (not isinstance(bound, date) or isinstance(bound, datetime)):
            raise TypeError(f"day bounds must be dates, not {type(bound).__name__}")
    months = [f.name for f in df.schema if f.metadata == MONTH_MARK]
    if start is not None:
        df = df.filter(F.col("event_day") >= F.lit(start))
        for month in months:
            df = df.filter(F.col(month) >= F.lit(start.replace(day=1)))
    if end is not None:
        df = df.filter(F.col("event_day") < F.lit(end))
        for month in months:
            df = df.filter(F.col(month) < F.lit(end))
    if sources is not None:
        df = df.filter(F.col("source").isin(list(sources)))
    if destinations is not None:
        df = df.filter(F.col("destination").isin(list(destinations)))
    return df
