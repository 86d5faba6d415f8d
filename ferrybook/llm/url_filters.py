"""Allow and block rules over URLs, as a sort-merge range join.

A host is written with its labels in reverse and a closing dot, so
``www.example.net`` becomes ``net.example.www.``. All subdomains of a host then
share its key as a prefix, and a rule covers one interval of keys. Intervals are
nested or apart. A sweep over URLs and interval ends in key order carries the
stack of the rules that are open at that point.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrybook.llm.common import lower_ascii

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path) as a table."""
    names = ("verdict", "host", "path")
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, rule))) for rule in rules]
    kind = "array<struct<verdict:string,host:string,path:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1))
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, "[.]", -1))
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _events(rules: DataFrame) -> DataFrame:
    """Both ends of each rule host's interval, with the stack that holds from there.

    The stack of a host is its own rules and those of the hosts above it, found by
    an equi-join on the prefixes of its key that end with a label.
    """
    host = lower_ascii(F.coalesce(F.col("host"), F.lit("")))
    path = F.coalesce(F.col("path"), F.lit(""))
    rules = rules.select(host.alias("host"), path.alias("path"), F.col("verdict")).filter(
        "host <> ''"
    )
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("length"),
        F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict"),
        F.col("path"),
    )
    hosts = rules.groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_set(rule).alias("rules")
    )
    labels = F.split("key", "[.]", -1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")),
    )
    upper = hosts.select(F.col("key").alias("above"), F.col("rules").alias("above_rules"))
    stacks = (
        hosts.select("key", F.explode(above).alias("above"))
        .join(upper, "above")
        .groupBy("key")
        .agg(
            F.flatten(F.collect_list("above_rules")).alias("stack"),
            F.flatten(
                F.collect_list(F.when(F.col("above") != F.col("key"), F.col("above_rules")))
            ).alias("outer"),
        )
    )
    # "/" follows "." in byte order and occurs in no host.
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    return stacks.select(
        F.inline(
            F.array(
                F.struct(F.col("key"), F.col("stack")),
                F.struct(end.alias("key"), F.col("outer").alias("stack")),
            )
        )
    )


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    salts: int | None = None,
) -> DataFrame:
    """Rule and verdict of every row: ``id_col``, url, host, path, rule, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path. The longest rule (host and path together, then host) wins; of two
    equal rules with different verdicts, ``block`` does. Without a rule the verdict
    is ``default`` and ``rule`` is null.

    URLs are dealt over ``salts`` sorted runs by a hash of the row, whatever their
    host, so a host with most of the rows is spread like any other. The ends of
    the rule intervals are copied to each run; the copies grow with rules times
    runs, not with the URLs. Results do not depend on ``salts``.

    A null URL or one without ``://`` has an empty host and path. Repeated rows are
    all kept. Empty tables give empty results; without rules every row gets
    ``default``. Rules without a host are passed over. Other columns of ``urls``
    are not read.
    """
    spark = urls.sparkSession
    salts = salts or max(512, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.select("id", "url", host.alias("host"), path.alias("path")).select(
        F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int").alias("salt"),
        host_key(F.col("host")).alias("key"),
        F.lit(1).alias("turn"),
        "id",
        "url",
        "host",
        "path",
    )
    events = _events(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        "key",
        F.lit(0).alias("turn"),
        "stack",
    )
    sweep = Window.partitionBy("salt").orderBy("key", "turn")
    active = F.last("stack", ignorenulls=True).over(
        sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fitting = F.filter(
        F.coalesce(F.col("active"), F.array()), lambda r: F.startswith(F.col("path"), r["path"])
    )
    return (
        urls.unionByName(events, allowMissingColumns=True)
        .withColumn("active", active)
        .filter("turn = 1")
        .withColumn("best", F.array_max(fitting))
        .select(
            F.col("id").alias(id_col),
            "url",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        )
    )
