"""Report-ready metrics over a table of transfers, as Spark DataFrames."""

from ferrybook.functions.median import exact_median
from ferrybook.functions.periods import fill_gaps, period_start
from ferrybook.operators.aggregates import (
    by_period,
    net_flow,
    route_median,
    route_rollup,
    size_buckets,
    top_routes,
    totals,
)
from ferrybook.operators.filters import filter_flows
from ferrybook.operators.series import (
    cumulative,
    new_vs_returning,
    period_change,
    trailing_volume,
)
from ferrybook.sources.stand_in import flows
from ferrybook.sources.transfers import as_flows, read_flows, read_transfers, write_flows

__all__ = [
    "as_flows",
    "by_period",
    "cumulative",
    "exact_median",
    "fill_gaps",
    "filter_flows",
    "flows",
    "net_flow",
    "new_vs_returning",
    "period_change",
    "period_start",
    "read_flows",
    "read_transfers",
    "route_median",
    "route_rollup",
    "size_buckets",
    "top_routes",
    "totals",
    "trailing_volume",
    "write_flows",
]
