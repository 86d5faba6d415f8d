"""One order, supplier and customer with a third of all rows each."""

import random

import pytest
from plan_nodes import count, plan_nodes

from ferrybook import flows
from ferrybook.plans.reports import reports
from ferrybook.plans.sql import report_sql


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    n_orders, n_lines = 6000, 60000
    tables = {
        "nation": (
            [(i, f"NATION_{i}", 0) for i in range(6)],
            "n_nationkey int, n_name string, n_regionkey int",
        ),
        "supplier": (
            [(i, rng.randrange(6)) for i in range(300)],
            "s_suppkey bigint, s_nationkey int",
        ),
        "customer": (
            [(i, rng.randrange(6)) for i in range(900)],
            "c_custkey bigint, c_nationkey int",
        ),
        "orders": (
            [
                (i, 5 if i % 3 == 0 else rng.randrange(900), f"2024-{1 + i % 12:02d}-11")
                for i in range(n_orders)
            ],
            "o_orderkey bigint, o_custkey bigint, day string",
        ),
        "lineitem": (
            [
                (
                    77 if i % 3 == 0 else rng.randrange(n_orders),
                    13 if i % 3 == 1 else rng.randrange(300),
                    rng.randrange(100, 10**7) / 100,
                    rng.randrange(11) / 100,
                )
                for i in range(n_lines)
            ],
            "l_orderkey bigint, l_suppkey bigint, l_extendedprice double, l_discount double",
        ),
    }
    path = tmp_path_factory.mktemp("skewed")
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.selectExpr("*", "cast(day as timestamp_ntz) as o_orderdate").drop("day")
        files = 8 if name in ("lineitem", "orders") else 1
        df.repartition(files).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


@pytest.fixture
def eager(spark):
    """Splits partitions from a few kilobytes on, so that the test data shows it."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.files.openCostInBytes": "128MB",
    }.items():
        session.conf.set(key, value)
    return session


def test_hot_keys_are_split_in_every_join(eager, skewed_dir):
    nodes = plan_nodes(flows(eager, skewed_dir))
    for key in ("l_orderkey", "l_suppkey", "o_custkey"):
        assert count(nodes, "SortMergeJoinExec", key) == 1
        joins = [d for k, d in nodes if k == "SortMergeJoinExec" and key in d]
        assert "skew=true" in joins[0], key


@pytest.mark.parametrize(
    "name",
    ["by_month", "net_flow", "new_vs_returning_month", "route_median", "top_routes", "totals"],
)
def test_reports_on_skewed_tables(name, eager, skewed_dir, duck_dirs):
    report = reports()[name](eager, skewed_dir)
    columns = sorted(report.columns)

    def order(row):
        return tuple((v is not None, v) for v in row)

    actual = sorted((tuple(r) for r in report.select(columns).collect()), key=order)
    con = duck_dirs(skewed_dir)
    expected = con.sql(report_sql()[name]).select(*columns).fetchall()
    assert actual == sorted(expected, key=order)
