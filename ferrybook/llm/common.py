"""Helpers shared by the operators: tables, word splitting, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts: space and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and leave all other letters alone."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster that would be
    the driver's own disk, which no executor sees.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="ferrybook-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def quoted(name: str) -> str:
    """A column name that may hold dots, blanks or backticks."""
    return "`" + name.replace("`", "``") + "`"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_stage(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a Parquet table in the same folder.

    Parquet is smaller than a checkpoint and lets later reads pick columns. The
    table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)
