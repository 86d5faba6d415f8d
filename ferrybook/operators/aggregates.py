"""Totals, periods, routes, places and size bands."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ferrybook.functions.median import exact_median, median_of_counts
from ferrybook.functions.periods import fill_gaps, period_start
from ferrybook.functions.types import volume_type


def _transfers() -> Column:
    return F.count(F.lit(1)).alias("transfers")


def _volume(df: DataFrame) -> Column:
    return F.sum("amount").cast(volume_type(df)).alias("volume")


def _users(approximate: bool, error: float) -> Column:
    # The exact form is planned as a first grouping by user, so its state is
    # spread over all tasks also where one period holds most of the rows.
    if approximate:
        return F.approx_count_distinct("user_id", error).alias("users")
    return F.count_distinct("user_id").alias("users")


def _approximate_median(df: DataFrame, accuracy: int) -> Column:
    kind = volume_type(df)
    middle = DecimalType(min(38, df.schema["amount"].dataType.precision + 2), min(38, kind.scale + 1))
    return F.percentile_approx("amount", 0.5, accuracy).cast(middle).alias("median_amount")


def totals(
    df: DataFrame, approximate: bool = False, user_error: float = 0.05, accuracy: int = 10_000
) -> DataFrame:
    """Transfers, distinct users, volume and median amount, in one row.

    With ``approximate``, users have a relative standard error of ``user_error``, and
    the median's rank is off by at most ``1 / accuracy`` of the number of transfers.

    One grouping counts the transfers of each user and of each amount. All four
    figures come from its result, so the flows are read and shuffled once.
    """
    if approximate:
        middle = _approximate_median(df, accuracy)
        return df.agg(_transfers(), _users(True, user_error), _volume(df), middle)
    counts = df.groupingSets([["user_id"], ["amount"]], "user_id", "amount").agg(
        F.grouping("user_id").alias("_by_amount"), F.count(F.lit(1)).alias("_n")
    )
    # Rows that count a user have no amount, so sums and median pass over them.
    transfers = F.sum(F.when(F.col("_by_amount") == 1, F.col("_n")))
    return counts.agg(
        F.coalesce(transfers, F.lit(0)).cast("bigint").alias("transfers"),
        F.count("user_id").alias("users"),
        F.sum(F.col("amount") * F.col("_n")).cast(volume_type(df)).alias("volume"),
    ).withColumn("median_amount", median_of_counts(counts, [], "amount").scalar())


def by_period(
    df: DataFrame,
    unit: str,
    approximate: bool = False,
    fill: bool = False,
    user_error: float = 0.05,
) -> DataFrame:
    """Transfers, distinct users and volume per day, week or month.

    Distinct users do not add up over periods, so each unit is computed from
    the flows. ``fill`` adds the periods without transfers. With ``approximate``,
    users have a relative standard error of ``user_error``.
    """
    periods = df.groupBy(period_start(F.col("event_day"), unit).alias("period")).agg(
        _transfers(), _users(approximate, user_error), _volume(df)
    )
    return fill_gaps(periods, unit) if fill else periods


def _routes(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "destination").agg(_transfers(), _volume(df))


def top_routes(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` routes with the largest volume, their share of all and their rank.

    Only ``k`` rows reach the ranking window; the top-k itself is distributed. Where
    all volume sums to 0, a share has no meaning and is null.
    """
    routes = _routes(df)
    # Both measures are summed so that this branch needs the same columns as the
    # main one, and Spark computes the routes once for the two.
    whole = routes.agg(
        F.struct(F.sum("volume").alias("volume"), F.sum("transfers").alias("transfers"))
    ).scalar()
    order = [F.col("volume").desc(), F.col("source"), F.col("destination")]
    share = F.try_divide(F.col("volume").cast("double"), whole["volume"].cast("double"))
    return (
        routes.orderBy(*order)
        .limit(k)
        .select(
            F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
            "source",
            "destination",
            "transfers",
            "volume",
            F.round(share, 10).alias("share"),
        )
    )


def net_flow(df: DataFrame) -> DataFrame:
    """Outflow, inflow and their difference (in minus out) per place.

    Flows are read once and summed per route; only the route sums are doubled
    into an outgoing and an incoming entry.
    """
    kind = volume_type(df)
    none = F.lit(0).cast(kind)
    volume = F.coalesce(F.col("volume"), none)
    entries = _routes(df).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("source").alias("place"),
                    volume.alias("out"),
                    none.alias("in"),
                ),
                F.struct(
                    F.col("destination").alias("place"),
                    none.alias("out"),
                    volume.alias("in"),
                ),
            )
        )
    )
    places = entries.groupBy("place").agg(
        F.sum("out").cast(kind).alias("outflow"), F.sum("in").cast(kind).alias("inflow")
    )
    return places.withColumn("net", (F.col("inflow") - F.col("outflow")).cast(kind))


def _exact_edge(edge: Decimal | int, kind: DecimalType) -> Decimal:
    if isinstance(edge, bool) or not isinstance(edge, (int, Decimal)):
        raise TypeError(f"edges must be int or Decimal, not {type(edge).__name__}")
    value = Decimal(edge)
    if not value.is_finite():
        raise ValueError(f"{edge} is not a number that an edge can be")
    _, digits, exponent = value.normalize(Context(prec=max(1, len(value.as_tuple().digits)))).as_tuple()
    whole = len(digits) + exponent
    if -exponent > kind.scale or (value and whole > kind.precision - kind.scale):
        raise ValueError(f"edge {edge} does not fit {kind.simpleString()} exactly")
    return value


def size_buckets(df: DataFrame, edges: Sequence[Decimal | int]) -> DataFrame:
    """Transfers and volume per band ``low <= amount < high`` between the edges.

    The bands below the first and from the last edge on are open (null ``low``
    or ``high``), so all transfers are counted. ``band`` numbers them from 0 and
    is null for transfers without an amount. An edge must fit the amount's type
    exactly; give fractions as ``Decimal``, as a float is rarely what it looks like.
    """
    volume_type(df)
    kind = df.schema["amount"].dataType
    bounds = [_exact_edge(edge, kind) for edge in edges]
    if not bounds or any(a >= b for a, b in zip(bounds, bounds[1:])):
        raise ValueError("edges must be given in increasing order")

    def pick(per_band: Sequence) -> Column:
        chosen = F.when(F.col("amount").isNull(), F.lit(None))
        for edge, item in zip(bounds, per_band):
            chosen = chosen.when(F.col("amount") < F.lit(edge).cast(kind), item)
        return chosen.otherwise(per_band[-1])

    numbers = [F.lit(i).cast("bigint") for i in range(len(bounds) + 1)]
    sums = df.groupBy(pick(numbers).alias("band")).agg(_transfers(), _volume(df))
    edge_of = F.array(*(F.lit(edge).cast(kind) for edge in bounds))
    return sums.select(
        "band",
        F.get(edge_of, F.col("band").cast("int") - 1).alias("low"),
        F.get(edge_of, F.col("band").cast("int")).alias("high"),
        "transfers",
        "volume",
    )


def route_rollup(df: DataFrame) -> DataFrame:
    """Transfers and volume by route, by source and in total.

    The flags are 1 where a row covers all destinations or all sources. Flows
    are summed per route first, so the threefold expansion of a rollup works on
    routes and not on transfers.
    """
    return (
        _routes(df)
        .rollup("source", "destination")
        .agg(
            F.sum("transfers").alias("transfers"),
            F.sum("volume").cast(volume_type(df)).alias("volume"),
            F.grouping("source").cast("bigint").alias("all_sources"),
            F.grouping("destination").cast("bigint").alias("all_destinations"),
        )
    )


def route_median(
    df: DataFrame, approximate: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Median amount per route.

    With ``approximate``, the median's rank is off by at most ``1 / accuracy`` of the
    route's number of transfers.
    """
    if approximate:
        middle = _approximate_median(df, accuracy)
        return df.groupBy("source", "destination").agg(middle)
    return exact_median(df, ["source", "destination"], "amount", "median_amount")
