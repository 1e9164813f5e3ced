"""Log files to lines and records: globs, exclusions, per-source switches, the log table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.options import DEFAULT_SOURCES, Options
from palisade.session import hadoop_path, path_exists
from palisade.sources.growing import GrowingText
from palisade.sources.parsers import ENTRY_FIELDS, ParseContext, parse_lines

LOG_SCHEMA = (
    "seq bigint, timestamp timestamp, ip string, source string, method string, path string, status int, "
    "user_agent string, raw string, extra map<string,string>"
)


def wildcard_regex(pattern: str) -> str:
    """A file wildcard as a regular expression; ``**`` also crosses folders."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    tokens = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", pattern)
    return "".join(
        parts.get(t, t.replace("[!", "[^") if re.fullmatch(r"\[[^\]]+\]", t) else re.escape(t)) for t in tokens
    )


def file_name_matches(patterns: Sequence[str], name: Column) -> Column:
    """Does a base name match any of the wildcards?"""
    if not patterns:
        return F.lit(False)
    return name.rlike("^(?:" + "|".join(wildcard_regex(p) for p in patterns) + ")$")


def _path_regex(pattern: str) -> str:
    lead = "" if re.match(r"^[a-z0-9]+:", pattern) else r"^[a-z0-9]+:(?://[^/]*)?"
    return lead + wildcard_regex(pattern) + "$"


def valid_text(value: Column) -> Column:
    """Text without its undecodable bytes."""
    dropped = F.regexp_replace(F.make_valid_utf8(value), "�", "")
    return F.when(F.is_valid_utf8(value), value).otherwise(dropped)


def read_lines(spark: SparkSession, paths: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Lines (``value``, ``file``) of all files the wildcards name, each file once.

    Wildcards without a file are skipped.  File conditions are on constants of the
    scan, so they prune files and not rows.
    """
    found, earlier = [], []
    for pattern in dict.fromkeys(paths):
        root, recursive, _ = pattern.partition("/**")
        regex = _path_regex(pattern)
        if path_exists(spark, root if recursive else pattern):
            reader = spark.read.option("recursiveFileLookup", "true" if recursive else "false")
            path = F.col("_metadata.file_path")
            kept = ~file_name_matches(exclude, F.col("_metadata.file_name"))
            kept = kept & path.rlike(regex) if recursive else kept
            for seen in earlier:
                kept = kept & ~path.rlike(seen)
            text = reader.text(root if recursive else pattern).where(kept)
            found.append(text.select(valid_text(F.col("value")).alias("value"), path.alias("file")))
        earlier.append(regex)
    if not found:
        return spark.createDataFrame([], "value string, file string")
    return reduce(DataFrame.unionByName, found)


def read_source(
    spark: SparkSession,
    source: str,
    paths: Sequence[str] = (),
    exclude: Sequence[str] = (),
    ctx: ParseContext | None = None,
) -> DataFrame:
    """Records of one source; its default paths when none are given."""
    default = DEFAULT_SOURCES.get(source)
    paths = paths or (default.paths if default else ())
    return parse_lines(read_lines(spark, paths, exclude), source, ctx).select(*ENTRY_FIELDS)


def number(records: DataFrame) -> DataFrame:
    """Give records a position ``seq``: stable for the same files, ascending within one."""
    return records.select(F.monotonically_increasing_id().alias("seq"), *ENTRY_FIELDS)


def read_logs(spark: SparkSession, options: Options, ctx: ParseContext | None = None) -> DataFrame:
    """Records of all enabled sources, in source order."""
    ctx = ctx or ParseContext.current(options.naive_time_zone)
    parts = [
        read_source(spark, name, source.paths, source.exclude, ctx)
        for name, source in options.sources.items()
        if source.enabled
    ]
    if not parts:
        return spark.createDataFrame([], LOG_SCHEMA)
    return number(reduce(DataFrame.unionByName, parts))


def stream_source(
    spark: SparkSession,
    source: str,
    paths: Sequence[str] = (),
    exclude: Sequence[str] = (),
    ctx: ParseContext | None = None,
    from_end: bool = False,
) -> DataFrame:
    """Records of one source as a stream: what its files hold by now, and what they grow by.

    ``from_end`` starts behind what is there already.
    """
    spark.dataSource.register(GrowingText)
    default = DEFAULT_SOURCES.get(source)
    paths = paths or (default.paths if default else ())
    reader = spark.readStream.format("growing_text").option("paths", ",".join(paths)).option("exclude", ",".join(exclude))
    lines = reader.option("startingOffsets", "latest" if from_end else "earliest").load().select("value", "seq")
    return parse_lines(lines, source, ctx).select("seq", *ENTRY_FIELDS)


def stream_logs(spark: SparkSession, options: Options, ctx: ParseContext | None = None, from_end: bool = False) -> DataFrame:
    """Records of all enabled sources as one stream, each numbered by its file and place in it."""
    ctx = ctx or ParseContext.current(options.naive_time_zone)
    parts = [
        stream_source(spark, name, source.paths, source.exclude, ctx, from_end)
        for name, source in options.sources.items()
        if source.enabled
    ]
    if not parts:
        raise ValueError("no source is enabled")
    return reduce(DataFrame.unionByName, parts)


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write records to the log table, partitioned by source and day.

    ``overwrite`` replaces the sources and days that ``logs`` holds and keeps all others.  The
    rebalance hint evens out file sizes and splits a partition that is far larger than the
    others.
    """
    dated = logs.withColumns({"log_date": F.to_date("timestamp"), "created_at": F.current_timestamp()})
    writer = dated.hint("rebalance", "source", "log_date").write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("source", "log_date").parquet(path)


def read_log_table(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored records, of some days (``yyyy-MM-dd``, both included) if given; other days' files are not opened."""
    logs = spark.read.parquet(path)
    logs = logs.where(F.col("log_date") >= F.lit(since).cast("date")) if since else logs
    return logs.where(F.col("log_date") <= F.lit(until).cast("date")) if until else logs


def purge_log_table(spark: SparkSession, path: str, as_of: date, days: int) -> int:
    """Drop the days that ended more than ``days`` days before ``as_of``; returns how many folders went.

    A day is one folder per source and is dropped whole: nothing is read or rewritten, and
    the files of all other days stay as they are.  0 days keeps everything.
    """
    if days <= 0:
        return 0
    fs, _ = hadoop_path(spark, path)
    first = as_of - timedelta(days=days)
    gone = 0
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/source=*/log_date=*")) or ():
        day = status.getPath().getName().partition("=")[2]
        if re.fullmatch(r"\d{4}-\d\d-\d\d", day) and date.fromisoformat(day) < first:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def log_table_stats(logs: DataFrame) -> DataFrame:
    """Stored records per source: how many, on how many days, the first and the last day."""
    return logs.groupBy("source").agg(
        F.count("*").alias("entries"), F.countDistinct("log_date").alias("days"),
        F.min("log_date").alias("first_day"), F.max("log_date").alias("last_day"),
    )
