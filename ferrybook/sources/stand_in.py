"""Transfers derived from the order tables: goods moving between nations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item that goes from one nation to another.

    Nation names are joined to suppliers and customers first, so a filter on
    places reaches those smaller tables. Line items meet orders before
    suppliers: a filter on days then thins them out before their second
    shuffle. The amount is computed at the scan and travels as one long. No
    side is marked for broadcast: the planner does that by size, and adaptive
    execution splits the partition of a hot order, supplier or customer.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nation = table("nation").select("n_nationkey", "n_name")
    suppliers = (
        table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_nationkey", F.col("n_name").alias("source"))
    )
    customers = (
        table("customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_nationkey", F.col("n_name").alias("destination"))
    )
    orders = (
        table("orders")
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("event_day"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    lines = table("lineitem").select(
        "l_orderkey", "l_suppkey", (price * (1 - discount)).alias("amount")
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter(F.col("s_nationkey") != F.col("c_nationkey"))
        .select(
            "source",
            "destination",
            F.col("o_custkey").alias("user_id"),
            "event_day",
            "amount",
        )
    )
