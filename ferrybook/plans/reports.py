"""Every operator as a named report over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ferrybook.operators import aggregates, series
from ferrybook.operators.filters import filter_flows
from ferrybook.sources.stand_in import flows
from ferrybook.sources.transfers import as_flows

# Parameters the reports share with the SQL in plans/sql.py.
START, END = date(1996, 3, 15), date(1998, 9, 1)
SOURCES = ("NATION_3", "NATION_8", "NATION_19")
DESTINATIONS = ("NATION_3", "NATION_5", "NATION_7", "NATION_11")
EDGES = (1_000, 10_000, 25_000, 50_000, 100_000)

Report = Callable[[SparkSession, str], DataFrame]


def _over_flows(operator: Callable[..., DataFrame], *args, **kwargs) -> Report:
    return lambda spark, sf_dir: operator(flows(spark, sf_dir), *args, **kwargs)


def _top_routes_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filter_flows(flows(spark, sf_dir), START, END, sources=SOURCES)
    return aggregates.top_routes(chosen, 10)


def _line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transfers from their return flag to their status."""
    return as_flows(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
        source="l_returnflag",
        destination="l_linestatus",
        user_id="l_suppkey",
        event_day="l_shipdate",
        amount="l_extendedprice",
    )


def reports() -> dict[str, Report]:
    return {
        "flows": flows,
        "as_flows": _line_flows,
        "filter_flows": _over_flows(filter_flows, START, END, SOURCES, DESTINATIONS),
        "totals": _over_flows(aggregates.totals),
        "by_day": _over_flows(aggregates.by_period, "day"),
        "by_day_filled": _over_flows(aggregates.by_period, "day", fill=True),
        "by_week": _over_flows(aggregates.by_period, "week"),
        "by_month": _over_flows(aggregates.by_period, "month"),
        "by_week_filled": _over_flows(aggregates.by_period, "week", fill=True),
        "by_month_filled": _over_flows(aggregates.by_period, "month", fill=True),
        "cumulative_day_filled": _over_flows(series.cumulative, "day", fill=True),
        "cumulative_week": _over_flows(series.cumulative, "week"),
        "cumulative_month": _over_flows(series.cumulative, "month"),
        "period_change_day_filled": _over_flows(series.period_change, "day", fill=True),
        "period_change_month": _over_flows(series.period_change, "month"),
        "trailing_volume_7": _over_flows(series.trailing_volume, 7),
        "trailing_volume_30": _over_flows(series.trailing_volume, 30),
        "top_routes": _over_flows(aggregates.top_routes, 10),
        "top_routes_filtered": _top_routes_filtered,
        "net_flow": _over_flows(aggregates.net_flow),
        "new_vs_returning_week": _over_flows(series.new_vs_returning, "week"),
        "new_vs_returning_month": _over_flows(series.new_vs_returning, "month"),
        "size_buckets": _over_flows(aggregates.size_buckets, EDGES),
        "route_rollup": _over_flows(aggregates.route_rollup),
        "route_median": _over_flows(aggregates.route_median),
    }
