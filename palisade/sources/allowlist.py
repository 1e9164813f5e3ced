"""Allow list: addresses, networks and ranges as key intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.ip import strip, with_bounds
from palisade.options import Options
from palisade.session import path_exists


def entry_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Entries of allow-list text: comments, inline comments and blanks removed."""
    text = strip(F.split_part(strip(F.col(value)), F.lit("#"), F.lit(1)))
    return lines.select(text.alias("entry")).where(F.col("entry") != "")


def intervals(entries: DataFrame) -> DataFrame:
    """Distinct valid intervals ``(entry, kind, lo, hi)``; invalid entries are dropped."""
    bounded = with_bounds(entries.select(strip(F.col("entry")).alias("entry"))).where(F.col("lo").isNotNull())
    return bounded.groupBy("kind", "lo", "hi").agg(F.min("entry").alias("entry")).select("entry", "kind", "lo", "hi")


def inline_entries(spark: SparkSession, entries: Iterable[str]) -> DataFrame:
    values = F.array(*[F.lit(e) for e in entries]).cast("array<string>")
    return spark.range(1).select(F.explode(values).alias("entry"))


def read_allow_file(spark: SparkSession, path: str) -> DataFrame:
    return entry_lines(spark.read.text(path))


def allow_table(spark: SparkSession, entries: Iterable[str] = (), file: str | None = None) -> DataFrame:
    """Inline entries and the file, united and without repeats; re-read on every use."""
    found = inline_entries(spark, entries)
    if file and path_exists(spark, file):
        found = found.unionByName(read_allow_file(spark, file))
    return intervals(found)


def allow_from_options(spark: SparkSession, options: Options) -> DataFrame:
    return allow_table(spark, options.allow_entries, options.allow_file)


def add_entries(allow: DataFrame, entries: Iterable[str]) -> DataFrame:
    more = intervals(inline_entries(allow.sparkSession, entries))
    return intervals(allow.select("entry").unionByName(more.select("entry")))


def allow_counts(allow: DataFrame) -> DataFrame:
    return allow.groupBy("kind").agg(F.count("*").alias("entries"))
