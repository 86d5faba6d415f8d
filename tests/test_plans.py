"""Plans that must hold at any scale: what is read, shuffled and joined how."""

import datetime as dt

import pytest
from plan_nodes import count, input_rows, plan_nodes

from ferrybook import filter_flows, flows, read_flows, totals, write_flows
from ferrybook.plans.reports import reports
from ferrybook.plans.settings import session_settings

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """A session that plans as for tables too large to broadcast."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return session


@pytest.mark.parametrize("name", sorted(reports()))
def test_input_is_computed_once(name, large):
    nodes = plan_nodes(reports()[name](large, DATA))
    if name == "as_flows":
        assert count(nodes, "FileSourceScanExec", "/lineitem.parquet") == 1
        return
    for table in ("lineitem", "orders", "customer", "supplier"):
        assert count(nodes, "FileSourceScanExec", f"/{table}.parquet") == 1
    assert count(nodes, "SortMergeJoinExec", "l_orderkey") == 1
    assert count(nodes, "CartesianProductExec") == 0
    assert count(nodes, "BroadcastNestedLoopJoinExec") == 0
    # Without codegen-friendly aggregates Spark falls back to these.
    assert count(nodes, "SortAggregateExec") == 0
    assert count(nodes, "ObjectHashAggregateExec") == 0
    # The two ranges of the overall median are all that is ever broadcast by hint.
    broadcasts = count(nodes, "BroadcastExchangeExec")
    assert broadcasts == (2 if name == "totals" else 0)


def test_scans_read_only_used_columns(large):
    nodes = plan_nodes(reports()["new_vs_returning_month"](large, DATA))
    scan = next(d for k, d in nodes if k == "FileSourceScanExec" and "/lineitem" in d)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in scan


def test_filters_reach_the_scans(large):
    chosen = filter_flows(
        flows(large, DATA), dt.date(1996, 1, 1), dt.date(1996, 2, 1), sources=["NATION_3"]
    )
    scans = [d for k, d in plan_nodes(chosen) if k == "FileSourceScanExec"]
    orders = next(d for d in scans if "/orders" in d)
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in orders
    assert "LessThan(o_orderdate,1996-02-01" in orders
    assert any("/nation" in d and "EqualTo(n_name,NATION_3)" in d for d in scans)


def test_windows_over_one_partition_see_only_aggregates(large):
    # Each single-partition shuffle sits above a grouping, never above the joins.
    for name in ("cumulative_month", "trailing_volume_7", "top_routes", "by_day_filled"):
        report = reports()[name](large, DATA)
        rows = input_rows(report, "WindowExec")
        assert rows, name
        # 1,094 days or 240 routes at most, of 5,765 flows.
        assert all(n <= 1094 for n in rows), (name, rows)


def test_stored_flows_are_pruned_by_month(spark, tmp_path):
    path = str(tmp_path / "flows")
    write_flows(flows(spark, DATA), path)
    stored = read_flows(spark, path)
    chosen = filter_flows(stored, dt.date(1996, 3, 15), dt.date(1996, 5, 1))
    nodes = plan_nodes(chosen)
    scan = next(d for k, d in nodes if k == "FileSourceScanExec")
    assert "PartitionFilters: [isnotnull(event_month" in scan
    months = {r.event_month for r in chosen.select("event_month").distinct().collect()}
    assert months == {dt.date(1996, 3, 1), dt.date(1996, 4, 1)}
    same = filter_flows(flows(spark, DATA), dt.date(1996, 3, 15), dt.date(1996, 5, 1))
    assert sorted(chosen.drop("event_month").collect()) == sorted(same.collect())
    assert totals(stored).collect() == totals(flows(spark, DATA)).collect()


def test_settings_scale_with_the_shuffle():
    small = session_settings(0, cores=8)
    huge = session_settings(30 * 10**12, cores=8000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    # Blocks of a shuffle are map tasks times partitions: bounded at 100 TB, while a
    # partition stays small enough to be sorted with some spilling.
    largest = session_settings(100 * 10**12, cores=8000)
    for settings, size in ((huge, 30 * 10**12), (largest, 100 * 10**12)):
        partitions = int(settings["spark.sql.shuffle.partitions"])
        map_tasks = size / int(settings["spark.sql.files.maxPartitionBytes"])
        assert map_tasks * partitions < 4e9
        assert partitions >= 8000 and size / partitions < 6 * 2**30
    medium = session_settings(64 * 2**30, cores=8)
    assert int(medium["spark.sql.shuffle.partitions"]) == 512
    with pytest.raises(ValueError):
        session_settings(-1, cores=8)
