"""Reading any transfer table into the common shape, and storing it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DecimalType

from ferrybook.functions.periods import MONTH_MARK
from ferrybook.functions.types import AMOUNT, exact_decimal

ROLES = ("source", "destination", "user_id", "event_day", "amount")
JDBC_SPLIT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def as_flows(
    df: DataFrame,
    source: str = "source",
    destination: str = "destination",
    user_id: str = "user_id",
    event_day: str = "event_day",
    amount: str = "amount",
    amount_type: DecimalType = AMOUNT,
) -> DataFrame:
    """Name the five roles of any transfer table; one output row per input row.

    Amounts become ``amount_type``, by default 18 digits with 4 of them after the
    point, and all reports keep its scale. A value that it cannot hold exactly makes
    the query fail: nothing is rounded silently (doubles: see ``exact_decimal``). Give
    a type with more places, ``DecimalType(18, 6)`` say, for finer amounts. Exact
    medians need a type of at most 18 digits.
    """
    given = df.select(F.col(amount)).schema[0].dataType
    return df.select(
        F.col(source).cast("string").alias("source"),
        F.col(destination).cast("string").alias("destination"),
        F.col(user_id).alias("user_id"),
        F.col(event_day).cast("date").alias("event_day"),
        exact_decimal(F.col(amount), given, amount_type, "amount").alias("amount"),
    )


def read_transfers(
    spark: SparkSession,
    source_format: str,
    roles: Mapping[str, str] | None = None,
    path: str | None = None,
    amount_type: DecimalType = AMOUNT,
    **options: str,
) -> DataFrame:
    """Read transfers with any Spark data source, a warehouse connector included.

    ``roles`` maps role names (see ``as_flows``, also for ``amount_type``) to the
    table's column names.
    Connectors outside Spark's own need their jar on the class path.
    """
    roles = dict(roles or {})
    unknown = set(roles) - set(ROLES)
    if unknown:
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    if source_format.lower() == "jdbc":
        given = {name.lower() for name in options}
        missing = [name for name in JDBC_SPLIT if name.lower() not in given]
        if missing:
            # Without them Spark pulls the whole table through a single task.
            raise ValueError(f"a JDBC read needs {', '.join(missing)} to run in parallel")
    reader = spark.read.format(source_format).options(**options)
    table = reader.load(path) if path else reader.load()
    return as_flows(table, **roles, amount_type=amount_type)


def write_flows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store flows as Parquet, one directory per month.

    Deriving flows can take several joins, so reports on large data should read
    this table instead. The rebalance hint lets Spark split a month that holds
    a large part of all rows over many tasks and files.
    """
    (
        df.withColumn("event_month", F.trunc("event_day", "month"))
        .hint("rebalance", F.col("event_month"))
        .sortWithinPartitions("event_month", "event_day")
        .write.mode(mode)
        .partitionBy("event_month")
        .parquet(path)
    )


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_flows`` stored; ``filter_flows`` then skips whole months.

    The column ``event_month`` carries a mark in its metadata that says it is the month
    of ``event_day``. Only a column with this mark is used for skipping; drop it before
    changing ``event_day``.
    """
    stored = spark.read.parquet(path)
    month = F.col("event_month").alias("event_month", metadata=MONTH_MARK)
    return stored.select(*(month if c == "event_month" else F.col(c) for c in stored.columns))
