"""No amount, edge or period is changed or mixed up silently."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql.types import DecimalType

import ferrybook as fb

SIX, FINE = DecimalType(18, 6), DecimalType(38, 18)


def amounts(spark, kind, *values):
    rows = [("A", "B", 1, dt.date(2024, 1, 1), v) for v in values]
    return spark.createDataFrame(
        rows, f"source string, destination string, user_id long, event_day date, amount {kind}"
    )


@pytest.mark.parametrize(
    "kind, value, wanted",
    [
        ("decimal(38,18)", D("0.000049"), SIX),
        ("decimal(38,18)", D("0.000000000000000049"), FINE),
        ("double", 0.1, SIX),
        ("double", 1e-6, SIX),
        ("float", 0.5, SIX),
        ("string", "0.000049", SIX),
        ("string", " 1e-6 ", SIX),
        ("bigint", 12, SIX),
    ],
)
def test_amounts_that_fit_are_kept(spark, kind, value, wanted):
    df = fb.as_flows(amounts(spark, kind, value, None), amount_type=wanted)
    assert df.schema["amount"].dataType == wanted
    got = [r.amount for r in df.collect()]
    assert got[0] == D(str(value).strip()) and got[1] is None


@pytest.mark.parametrize(
    "kind, value",
    [
        ("decimal(38,18)", D("0.000049")),
        ("decimal(38,18)", D("123456789012345.5")),
        ("double", 0.00001),
        ("double", 0.1 + 0.2),
        ("double", 1e300),
        ("double", float("nan")),
        ("string", "0.00005"),
        ("string", "many"),
        ("bigint", 10**15),
    ],
)
def test_amounts_that_do_not_fit_fail(spark, kind, value):
    with pytest.raises(Exception, match="does not fit decimal"):
        fb.as_flows(amounts(spark, kind, value)).collect()


def test_finer_amounts_go_through_all_reports(spark):
    df = fb.as_flows(amounts(spark, "decimal(38,18)", D("0.000049"), D("0.000049")), amount_type=SIX)
    assert fb.totals(df).first()[2:] == (D("0.000098"), D("0.0000490"))
    assert fb.totals(df, approximate=True).first()[3] == D("0.0000490")
    assert fb.route_median(df).first().median_amount == D("0.0000490")
    bands = {r.band: r.transfers for r in fb.size_buckets(df, [D("0.00005")]).collect()}
    assert bands == {0: 2}
    for report in (
        fb.by_period(df, "day"), fb.cumulative(df, "day"), fb.top_routes(df, 1), fb.route_rollup(df),
        fb.trailing_volume(df, 2),
    ):
        assert report.first().volume == D("0.000098")
    assert {r.place: r.net for r in fb.net_flow(df).collect()} == {"A": D("-0.000098"), "B": D("0.000098")}
    wide = fb.as_flows(amounts(spark, "decimal(38,18)", D("1e-18")), amount_type=FINE)
    assert fb.by_period(wide, "day").first().volume == D("1e-18")
    with pytest.raises(TypeError, match="18 digits"):
        fb.route_median(wide)


@pytest.mark.parametrize(
    "edges, error",
    [
        ([D("1.00004")], ValueError),
        ([D("1.00001"), D("1.00002")], ValueError),
        ([D(10) ** 14], ValueError),
        ([D("NaN")], ValueError),
        ([0.1], TypeError),
        ([True], TypeError),
        ([2, 1], ValueError),
        ([], ValueError),
    ],
)
def test_edges_must_fit(spark, edges, error):
    df = fb.as_flows(amounts(spark, "double", 1.0))
    with pytest.raises(error):
        fb.size_buckets(df, edges)


def test_edges_that_fit(spark):
    df = fb.as_flows(amounts(spark, "double", 1.0, 1.0001))
    got = fb.size_buckets(df, [D("-5.0"), D("0E+3"), D("1.00010000"), 10**13]).collect()
    assert {(r.band, r.low, r.transfers) for r in got} == {(2, D(0), 1), (3, D("1.0001"), 1)}


def test_a_foreign_month_column_never_filters(spark):
    df = amounts(spark, "decimal(18,4)", D(1)).selectExpr("*", "date '2024-01-31' as event_month")
    assert fb.filter_flows(df, dt.date(2024, 1, 1), dt.date(2024, 1, 5)).count() == 1
    text = df.withColumn("event_month", df.source)
    assert fb.filter_flows(text, dt.date(2024, 1, 1), dt.date(2024, 1, 5)).count() == 1


@pytest.mark.parametrize("values", [(D(0), D(0)), (D(5), D(-5)), (None,)])
def test_shares_of_nothing_are_null(spark, values):
    rows = fb.top_routes(amounts(spark, "decimal(18,4)", *values), 10).collect()
    assert len(rows) == 1 and rows[0].share is None and rows[0].transfers == len(values)


@pytest.fixture
def undated(spark):
    rows = [
        ("A", "B", 1, None, D(100)),
        ("A", "B", 1, dt.date(2024, 1, 9), D(5)),
        ("A", "B", 1, dt.date(2024, 3, 9), D(7)),
    ]
    return spark.createDataFrame(
        rows, "source string, destination string, user_id long, event_day date, amount decimal(18,4)"
    )


@pytest.mark.parametrize("fill", [False, True])
def test_undated_transfers_are_no_period(undated, fill):
    january, february, march = (dt.date(2024, m, 1) for m in (1, 2, 3))
    change = {r.period: (r.volume, r.change) for r in fb.period_change(undated, "month", fill).collect()}
    running = {r.period: r.cumulative_volume for r in fb.cumulative(undated, "month", fill).collect()}
    assert change[None] == (D(100), None) and change[january] == (D(5), None)
    assert change[march] == (D(7), D(7) if fill else D(2))
    assert running == {None: None, january: D(5), march: D(12)} | ({february: D(5)} if fill else {})


@pytest.mark.parametrize("name", ["_n", "_mid", "_top", "_rows", "_lower", "_value", "_key0", "_median"])
def test_median_takes_any_key_name(spark, name):
    df = spark.createDataFrame([(1, D(2)), (1, D(4)), (2, None)], f"`{name}` int, v decimal(9,2)")
    got = {r[0]: r[1] for r in fb.exact_median(df, [name], "v").collect()}
    assert got == {1: D("3.000"), 2: None}


def test_nations_are_told_by_key_not_by_name(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("nation", [(1, "SAME"), (2, "SAME")], "n_nationkey int, n_name string")
    save("supplier", [(1, 1)], "s_suppkey long, s_nationkey int")
    save("customer", [(1, 2), (2, 1)], "c_custkey long, c_nationkey int")
    day = dt.datetime(2024, 1, 1)
    save("orders", [(1, 1, day), (2, 2, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    save(
        "lineitem",
        [(1, 1, 10.0, 0.0), (2, 1, 20.0, 0.0)],
        "l_orderkey long, l_suppkey long, l_extendedprice double, l_discount double",
    )
    assert [(r.source, r.user_id) for r in fb.flows(spark, str(tmp_path)).collect()] == [("SAME", 1)]


def test_days_of_instants(spark):
    rows = [("A", "B", 1, dt.datetime(2024, 1, 1, h), D(1)) for h in (1, 2, 3)]
    df = spark.createDataFrame(
        rows, "source string, destination string, user_id long, event_day timestamp_ntz, amount decimal(18,4)"
    )
    assert [tuple(r) for r in fb.by_period(df, "day").collect()] == [(dt.date(2024, 1, 1), 3, 1, D(3))]


def test_approximate_forms_stay_within_their_bounds(spark):
    df = spark.range(20000).selectExpr(
        "'A' as source", "'B' as destination", "id as user_id", "date '2024-01-01' as event_day",
        "cast(id as decimal(18,4)) as amount",
    )
    row = fb.totals(df, approximate=True, user_error=0.01, accuracy=1000).first()
    assert abs(row.users - 20000) < 4 * 0.01 * 20000
    assert abs(float(row.median_amount) - 10000) <= 20000 / 1000
    users = fb.by_period(df, "day", approximate=True, user_error=0.01).first().users
    assert abs(users - 20000) < 4 * 0.01 * 20000
    middle = fb.route_median(df, approximate=True, accuracy=1000).first().median_amount
    assert abs(float(middle) - 10000) <= 20000 / 1000
