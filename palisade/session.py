"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of at most this many rows may be broadcast (a few MB of interval rows).
BROADCAST_ROWS = 50_000


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side is small; else a shuffle join.

    At most ``rows + 1`` rows reach the driver.  A small side is then fixed as the
    rows just read, so that several joins with it in one plan do not derive it again.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that each is evaluated exactly once per row.

    A plain projection would be inlined wherever its column is named again, and a
    filter on it would be pushed below it and evaluate it a second time.  Catalyst
    does neither across a one-element ``explode``, which costs next to nothing.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    staged = df.select("*", F.explode(F.array(fields)).alias("_once"))
    return staged.withColumns({name: F.col("_once")[name] for name in columns}).drop("_once")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Spread a table that is stored in fewer pieces than there are cores.

    For a plain table scan followed by costly expressions.  Large tables have more
    pieces than cores and stay as they are, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or tempfile.mkdtemp(prefix="palisade-")


def hadoop_path(spark: SparkSession, path: str):
    """``(FileSystem, Path)`` of a path, through the session's own configuration."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, pattern: str) -> bool:
    fs, target = hadoop_path(spark, pattern)
    found = fs.globStatus(target)
    return found is not None and len(found) > 0
