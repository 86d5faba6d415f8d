"""Exact medians whose memory use does not depend on the size of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# A decimal of at most 18 digits is an integer below 2**60 in its smallest unit.
# Three steps of 20 bits cover it, and no step ranks more than 2**21 buckets
# (both signs) of one group.
STEP_BITS = 20


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """Exact median of the decimal column ``value`` per ``keys``.

    The built-in ``median`` keeps a map of all values of a group in one task,
    which a group with a third of all rows would overflow. Here equal values are
    counted first (combined before the shuffle), then counted again in coarse
    and coarser value ranges. From the coarsest level down, the range that holds
    the middle rank is picked, and a join keeps only its rows for the next level.

    The three levels share one shuffle of the value counts, so ``df`` is
    computed once. With keys, the join on the picked ranges shuffles the value
    counts a second time before it can drop any. Nulls are skipped, as in SQL; a group with nothing but nulls
    gets a null median. Without keys the result is always one row.
    """
    df = df.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col(value).alias("_value"))
    inner = [f"_key{i}" for i in range(len(keys))]
    counts = df.groupBy(*inner, "_value").agg(F.count(F.lit(1)).alias("_n"))
    found = median_of_counts(counts, inner, "_value", "_median")
    return found.select(*(F.col(i).alias(k) for i, k in zip(inner, keys)), F.col("_median").alias(name))


def median_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """``exact_median`` of values that are already counted, in column ``_n``.

    Keys must not begin with an underscore, but for those ``exact_median`` gives.
    """
    keys = list(keys)
    kind = counts.schema[value].dataType
    if not isinstance(kind, DecimalType) or kind.precision > 18:
        raise TypeError(f"{value} must be a decimal of at most 18 digits, not {kind}")

    counts = counts.select(*keys, F.col(value).alias("_value"), "_n")
    units = (F.col("_value") * F.lit(10**kind.scale)).cast("bigint")
    fine = counts.withColumn("_mid", F.shiftright(units, STEP_BITS))
    mid = fine.groupBy(*keys, "_mid").agg(F.sum("_n").alias("_n"))
    mid = mid.withColumn("_top", F.shiftright("_mid", STEP_BITS))
    top = mid.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"))

    # Ranks of the two middle rows (the same row where the count is odd).
    top = top.withColumn("_n", F.when(F.col("_top").isNull(), 0).otherwise(F.col("_n")))
    rows = F.sum("_n").over(Window.partitionBy(*keys))
    top = (
        top.withColumn("_rows", rows)
        .withColumn("_lower", F.expr("(_rows + 1) div 2"))
        .withColumn("_upper", F.expr("_rows div 2 + 1"))
    )
    ranked = _rank(top, keys, "_top")
    in_top = _middle(ranked).select(*keys, "_top", "_lower", "_upper")
    in_mid = _middle(_rank(_within(mid, in_top, keys, "_top"), [*keys, "_top"], "_mid"))
    in_mid = in_mid.select(*keys, "_mid", "_lower", "_upper")
    found = _middle(_rank(_within(fine, in_mid, keys, "_mid"), [*keys, "_mid"], "_value"))

    # Half of a sum needs one more place than the values have.
    half = ((F.col("_low") + F.col("_high")) / F.lit(2)).cast(
        DecimalType(kind.precision + 2, kind.scale + 1)
    )
    medians = (
        found.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_lower").isNotNull(), F.col("_value"))).alias("_low"),
            F.max(F.when(F.col("_upper").isNotNull(), F.col("_value"))).alias("_high"),
        )
        .select(*keys, half.alias(name))
    )
    if not keys:
        return medians
    only_nulls = ranked.filter(F.col("_rows") == 0).select(
        *keys, F.lit(None).cast(medians.schema[name].dataType).alias(name)
    )
    return medians.unionByName(only_nulls)


def _within(level: DataFrame, picked: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Rows of ``level`` inside the picked ranges, with the ranks to find there.

    The match is null-safe for keys that are null. It also keeps Spark from
    adding a not-null filter to this use of ``level`` alone, which would make its
    shuffle differ from the other levels' and compute the input again for each.
    """
    names = [*keys, part]
    picked = picked.select(*(F.col(c).alias(f"_at_{c}") for c in names), "_lower", "_upper")
    if not keys:
        picked = F.broadcast(picked)  # two rows at most
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in names]
    joined = level.join(picked, reduce(lambda a, b: a & b, same))
    return joined.drop(*(f"_at_{c}" for c in names))


def _rank(level: DataFrame, group: list[str], order: str) -> DataFrame:
    """Turn ranks within ``group`` into ranks within each row; null where outside."""
    window = Window.partitionBy(*group).orderBy(order)
    running = F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("_until") - F.col("_n")

    def local(rank: str):
        here = (F.col(rank) > before) & (F.col(rank) <= F.col("_until"))
        return F.when(here, F.col(rank) - before)

    return level.withColumn("_until", running).withColumns(
        {"_lower": local("_lower"), "_upper": local("_upper")}
    )


def _middle(level: DataFrame) -> DataFrame:
    return level.filter(F.col("_lower").isNotNull() | F.col("_upper").isNotNull())
