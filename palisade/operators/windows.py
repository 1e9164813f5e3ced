"""Sliding-window counts that hold up when one address sends a third of all rows.

The rule counted is "rows of this address in ``(t - W, t]``, row by row in (time,
seq) order".  No window runs over raw rows of one address:

* rows are first counted per (address, instant), combined on the map side;
* the counts are partitioned by (address, stretch of W seconds), each stretch with
  a copy of the one before it, which is all a trailing window can reach.

With whole-second log times such a partition holds at most ``2 W`` rows, however
many rows the address sent.  Within one instant the count grows row by row, so how
many rows exceed the limit follows from the count before the instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def _stretch(t: str, window: int) -> Column:
    """Number of the stretch of ``window`` seconds an instant lies in."""
    size = f"bigint('{window * MICROS}')"
    return F.expr(f"({t} - pmod({t}, {size})) div {size}")


def instants(rows: DataFrame) -> DataFrame:
    """Rows counted per (address, instant in microseconds)."""
    return rows.groupBy("ip", F.unix_micros("timestamp").alias("t")).agg(F.count("*").alias("n"))


def trailing_counts(counted: DataFrame, window: int) -> DataFrame:
    """Add ``before``: rows of the address in ``(t - W, t)``, strictly earlier than ``t``.

    ``counted`` has columns ip, t, n with one row per (ip, t).
    """
    stretch = _stretch("t", window)
    part = Window.partitionBy("ip", "_part").orderBy("t")
    # Two running sums rather than one sliding frame: each row is added once.
    earlier = F.sum("n").over(part.rangeBetween(Window.unboundedPreceding, -1))
    expired = F.sum("n").over(part.rangeBetween(Window.unboundedPreceding, -window * MICROS))
    return (
        counted.withColumn("_own", stretch)
        .withColumn("_part", F.explode(F.array("_own", F.col("_own") + 1)))
        .withColumn("before", F.coalesce(earlier, F.lit(0)) - F.coalesce(expired, F.lit(0)))
        .where(F.col("_part") == F.col("_own"))
        .drop("_own", "_part")
    )


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str | None = None, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group (numbered, if ``rank`` is given), trimmed before they are shuffled together.

    Spark trims a rank filter on the map side only up to a limit.  Beyond it, rows are first
    ranked inside parts of a group, so that a busy group is spread over ``parts`` tasks.
    """
    spark = rows.sparkSession
    bound = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > bound:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(parts)))
        inside = Window.partitionBy(*by, "_salt").orderBy(*order)
        rows = salted.withColumn("_rn", F.row_number().over(inside)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    number = rank or "_rn"
    ranked = rows.withColumn(number, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranked = ranked.where(F.col(number) <= n)
    return ranked if rank else ranked.drop(number)


def counted_instants(rows: DataFrame, first: int, by: list[str]) -> DataFrame:
    """``n`` and ``rows`` per group of ``by`` (an instant ``t`` among them): how many, and the first ones by seq with their statuses."""
    timed = rows.withColumn("t", F.unix_micros("timestamp"))
    some = first_rows(timed.select(*by, "seq", "status"), by, [F.col("seq")], first)
    some = some.groupBy(*by).agg(F.collect_list(F.struct("seq", "status")).alias("rows"))
    return timed.groupBy(*by).agg(F.count("*").alias("n")).join(some, by)


def merge_instants(a: DataFrame, b: DataFrame, first: int, by: list[str]) -> DataFrame:
    """Counts of both added up; the first rows of both together."""
    rows = F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, first).alias("rows")
    return a.unionByName(b).groupBy(*by).agg(F.sum("n").alias("n"), rows)


def violations(rows: DataFrame, window: int, limit: int) -> DataFrame:
    """Instants with rows above the limit: ip, t, n, before, over (rows above it)."""
    return over_limit(trailing_counts(instants(rows), window), limit)


def over_limit(counted: DataFrame, limit: int) -> DataFrame:
    above = counted.where(F.col("before") + F.col("n") > limit)
    return above.withColumn("over", F.least(F.col("n"), F.col("before") + F.col("n") - limit))


def crossings(violating: DataFrame) -> DataFrame:
    """First crossing per address, and what followed: ip, t_cross, hits, t_last."""
    return violating.groupBy("ip").agg(
        F.min("t").alias("t_cross"), F.sum("over").alias("hits"), F.max("t").alias("t_last")
    )


def crossing_window(rows: DataFrame, crossed: DataFrame, window: int, limit: int) -> DataFrame:
    """The ``limit + 1`` rows in the window at which each address first crossed.

    The last of them (``_rn = limit + 1``) is the crossing row itself; columns of
    ``crossed`` are kept.  Rows and
    crossings meet on (address, stretch), so a busy address is spread over its
    stretches, and the per-address rank keeps only ``limit + 1`` rows per task
    before anything is shuffled on the address.
    """
    own = _stretch("t_cross", window)
    reach = crossed.select("*", F.explode(F.array(own, own - 1)).alias("_part"))
    placed = rows.withColumn("t", F.unix_micros("timestamp")).withColumn("_part", _stretch("t", window))
    inside = placed.join(reach, ["ip", "_part"]).where(
        (F.col("t") > F.col("t_cross") - window * MICROS) & (F.col("t") <= F.col("t_cross"))
    )
    return first_rows(inside, ["ip"], [F.col("t"), F.col("seq")], limit + 1, "_rn")


def top_statuses(inside: DataFrame, top: int) -> DataFrame:
    """Crossing row and most frequent statuses per address, from its crossing window.

    One row per address: seq, timestamp, hits, t_last, and ``top_statuses`` as
    ``code:count,...``; ties keep first-seen order.
    """
    last = F.max(F.struct("_rn", "seq", "timestamp", "hits", "t_last"))
    by_status = inside.groupBy("ip", "status").agg(
        F.count("*").alias("_n"), F.min("_rn").alias("_first"), last.alias("_last")
    )
    ranked = by_status.groupBy("ip").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), "_first", "status"))).alias("_top"),
        F.max("_last").alias("_last"),
    )
    text = F.transform(
        F.slice("_top", 1, top),
        lambda s: F.concat(s["status"].cast("string"), F.lit(":"), (-s["o"]).cast("string")),
    )
    return ranked.select(
        "ip", "_last.seq", "_last.timestamp", "_last.hits", "_last.t_last", F.array_join(text, ",").alias("top_statuses")
    )


def sliding_counts(rows: DataFrame, window: int) -> DataFrame:
    """Every row with its own trailing count ``window_count``, row by row.

    Rows of one instant are numbered within (address, instant); the count before
    the instant is joined to them.
    """
    before = trailing_counts(instants(rows), window).select("ip", "t", "before")
    timed = rows.withColumn("t", F.unix_micros("timestamp"))
    number = F.row_number().over(Window.partitionBy("ip", "t").orderBy("seq"))
    return (
        timed.withColumn("_k", number)
        .join(before, ["ip", "t"])
        .withColumn("window_count", F.col("before") + F.col("_k"))
        .drop("t", "_k", "before")
    )


def nth_rows(rows: DataFrame, n: int) -> DataFrame:
    """The ``n``-th row of each address in (time, seq) order.

    The rank filter is applied on the map side first (at most ``n`` rows per
    address and task are shuffled).
    """
    return first_rows(rows, ["ip"], [F.col("timestamp"), F.col("seq")], n, "_rn").where(F.col("_rn") == n).drop("_rn")
