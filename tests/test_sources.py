"""Reading transfer tables of any shape, and storing flows."""

import datetime as dt
from decimal import Decimal as D

import pytest

import ferrybook as fb

ROLES = {
    "source": "from_place", "destination": "to_place", "user_id": "wallet",
    "event_day": "sent_at", "amount": "value",
}


@pytest.fixture
def transfers(spark):
    return spark.createDataFrame(
        [
            ("A", "B", "w1", dt.datetime(2024, 1, 1, 23, 59), 1.25),
            ("B", "A", "w2", dt.datetime(2024, 2, 1, 0, 0), 2.5),
            (None, "A", None, None, None),
        ],
        "from_place string, to_place string, wallet string, sent_at timestamp_ntz, value double",
    )


EXPECTED = [
    ("A", "B", "w1", dt.date(2024, 1, 1), D("1.2500")),
    ("B", "A", "w2", dt.date(2024, 2, 1), D("2.5000")),
    (None, "A", None, None, None),
]


def test_as_flows_names_the_roles(transfers):
    df = fb.as_flows(transfers, **ROLES)
    assert [f.simpleString() for f in df.schema] == [
        "source:string", "destination:string", "user_id:string",
        "event_day:date", "amount:decimal(18,4)",
    ]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(EXPECTED, key=str)
    # Any kind of user key works; the report treats it as opaque.
    assert fb.totals(df).first()[:3] == (3, 2, D("3.7500"))


@pytest.mark.parametrize("source_format", ["parquet", "orc", "json", "csv"])
def test_read_transfers(source_format, transfers, spark, tmp_path):
    path = str(tmp_path / "table")
    table = transfers.withColumn("sent_at", transfers.sent_at.cast("string"))
    table.write.format(source_format).option("header", "true").save(path)
    options = {"header": "true"} if source_format == "csv" else {}
    df = fb.read_transfers(spark, source_format, ROLES, path, **options)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(EXPECTED, key=str)


def test_read_transfers_checks_its_arguments(spark):
    with pytest.raises(ValueError, match="unknown roles"):
        fb.read_transfers(spark, "parquet", {"target": "x"})
    with pytest.raises(ValueError, match="numPartitions"):
        fb.read_transfers(spark, "jdbc", url="jdbc:none", dbtable="transfers")


def test_stored_flows_keep_every_row(transfers, spark, tmp_path):
    path = str(tmp_path / "flows")
    df = fb.as_flows(transfers, **ROLES)
    fb.write_flows(df, path)
    stored = fb.read_flows(spark, path)
    back = stored.select(df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(EXPECTED, key=str)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        fb.write_flows(df, path)
    fb.write_flows(df, path, mode="append")
    assert fb.read_flows(spark, path).count() == 6


def test_a_month_with_most_rows_is_split_over_files(spark, tmp_path):
    path = str(tmp_path / "flows")
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    df = session.range(0, 200000, 1, 8).selectExpr(
        "'A' as source", "'B' as destination", "id as user_id",
        "if(id % 10 = 0, date '2024-02-01', date '2024-01-01') as event_day",
        "cast(xxhash64(id) % 1000000 as decimal(18,4)) as amount",
    )
    fb.write_flows(df, path)
    files = fb.read_flows(session, path).inputFiles()
    assert sum("event_month=2024-01-01" in f for f in files) > 1
    assert fb.read_flows(session, path).count() == 200000
