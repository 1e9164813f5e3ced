"""Hits to threats: one row per address, scored and graded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.options import Options

FINDING_COLUMNS = ("ip", "analyzer", "reason", "rank", "score", "hits", "first_seen", "first_seq", "last_seen")


def threat_level(score: Column, options: Options = Options()) -> Column:
    """Level name of a score; NONE below the lowest cut."""
    level = F.lit("NONE")
    for name, cut in options.levels:
        level = F.when(score >= cut, F.lit(name)).otherwise(level)
    return level


def findings(hits: DataFrame) -> DataFrame:
    """One row per (ip, analyzer, reason): the score counts once, hits add up.

    All aggregates combine on the map side, so a busy address costs one row per
    reason and task in the shuffle.
    """
    first = F.min(F.struct("timestamp", "seq", "rank")).alias("_first")
    return (
        hits.groupBy("ip", "analyzer", "reason")
        .agg(F.max("score").alias("score"), F.sum("hits").alias("hits"), first, F.max("last_seen").alias("last_seen"))
        .select(
            "ip", "analyzer", "reason", F.col("_first.rank").alias("rank"), "score", "hits",
            F.col("_first.timestamp").alias("first_seen"), F.col("_first.seq").alias("first_seq"), "last_seen",
        )
    )


def merge_findings(*parts: DataFrame) -> DataFrame:
    """Fold findings of several scans or micro-batches into one row per reason."""
    united = reduce(DataFrame.unionByName, parts)
    first = F.min(F.struct("first_seen", "first_seq", "rank")).alias("_first")
    return (
        united.groupBy("ip", "analyzer", "reason")
        .agg(F.max("score").alias("score"), F.sum("hits").alias("hits"), first, F.max("last_seen").alias("last_seen"))
        .select(
            "ip", "analyzer", "reason", F.col("_first.rank").alias("rank"), "score", "hits",
            F.col("_first.first_seen").alias("first_seen"), F.col("_first.first_seq").alias("first_seq"), "last_seen",
        )
    )


def threats(found: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings added up per address; reasons in first-seen order."""
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", "first_seq", "rank", "reason")))
    totals = found.groupBy("ip").agg(
        F.sum("score").cast("int").alias("score"),
        F.array_distinct(F.transform(ordered, lambda r: r["reason"])).alias("reasons"),
        F.sum("hits").alias("hit_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return totals.select(
        "ip", "score", threat_level(F.col("score"), options).alias("threat_level"),
        "reasons", "hit_count", "first_seen", "last_seen",
    )
