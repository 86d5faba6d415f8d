"""Reports that look along time.

Windows without a partition run in one task. Here they only see sums per
period, at most one row per calendar day however large the flows are.
"""

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ferrybook.functions.periods import fill_gaps, period_start
from ferrybook.functions.types import volume_type


def _volumes(df: DataFrame, unit: str, fill: bool) -> DataFrame:
    volumes = df.groupBy(period_start(F.col("event_day"), unit).alias("period")).agg(
        F.sum("amount").cast(volume_type(df)).alias("volume")
    )
    return fill_gaps(volumes, unit) if fill else volumes


def _in_order() -> WindowSpec:
    """Periods in order, apart from the row of transfers without a day."""
    return Window.partitionBy(F.col("period").isNull()).orderBy("period")


def cumulative(df: DataFrame, unit: str, fill: bool = False) -> DataFrame:
    """Volume per period and the running total up to it.

    Transfers without a day come in no order: their volume has a row of its own with
    no running total, and is in none of the others.
    """
    so_far = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("volume").over(so_far).cast(volume_type(df))
    running = F.when(F.col("period").isNotNull(), running)
    return _volumes(df, unit, fill).withColumn("cumulative_volume", running)


def period_change(df: DataFrame, unit: str, fill: bool = False) -> DataFrame:
    """Volume per period and its change from the previous one; null in the first.

    The previous period is the last one with transfers, or with ``fill`` the
    one before in the calendar. Transfers without a day have no previous period and
    are none: their row has a null change.
    """
    previous = F.lag("volume").over(_in_order())
    change = (F.col("volume") - previous).cast(volume_type(df))
    return _volumes(df, unit, fill).withColumn("change", change)


def trailing_volume(df: DataFrame, days: int) -> DataFrame:
    """Volume per day, over the last ``days`` calendar days, and that per day.

    Rows exist for days with transfers. The frame counts days, not rows, so
    days without transfers inside it count as zero.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    recent = Window.orderBy(F.unix_date("event_day")).rangeBetween(-(days - 1), 0)
    return (
        df.groupBy("event_day")
        .agg(F.sum("amount").cast(volume_type(df)).alias("volume"))
        .withColumn("trailing_volume", F.sum("volume").over(recent).cast(volume_type(df)))
        .withColumn("trailing_mean", F.col("trailing_volume").cast("double") / F.lit(days))
    )


def new_vs_returning(df: DataFrame, unit: str) -> DataFrame:
    """Users whose first ever period this is, and the other active users.

    Needs the whole history: choose days after this step, not before. Users are
    reduced to their distinct periods before they are shuffled by user, so even
    a user with a third of all transfers is a group of at most one row per
    period.
    """
    period = period_start(F.col("event_day"), unit)
    active = (
        df.filter(F.col("user_id").isNotNull())
        .select("user_id", period.alias("period"))
        .distinct()
    )
    first = F.min("period").over(Window.partitionBy("user_id"))
    is_new = F.col("period").eqNullSafe(F.col("_first"))
    return (
        active.withColumn("_first", first)
        .groupBy("period")
        .agg(
            F.count(F.when(is_new, True)).alias("new_users"),
            F.count(F.when(~is_new, True)).alias("returning_users"),
        )
    )
