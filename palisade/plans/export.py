"""Block lists: formatting, writing with de-duplication, reading back, backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palisade.functions.ip import strip
from palisade.functions.times import display_text
from palisade.plans.reports import at_or_above
from palisade.session import path_exists

# The header of a detailed list.
TITLE = "# IP威胁记录 - 更新时间: "
LEGEND = "# 格式: IP | 等级 | 原因 | 命中次数 | 首次发现 | 最后活动"
RULE = "#" + "=" * 80


def detailed_line() -> Column:
    reasons = F.array_join("reasons", ",")
    return F.concat_ws(
        " | ",
        F.col("ip"),
        F.coalesce("threat_level", F.lit("UNKNOWN")),
        F.when(F.coalesce(reasons, F.lit("")) == "", "-").otherwise(reasons),
        F.col("hit_count").cast("string"),
        display_text(F.col("first_seen")),
        display_text(F.col("last_seen")),
    )


def block_lines(threats: DataFrame, fmt: str = "detailed") -> DataFrame:
    """Lines of a block list (``value``), with what orders them."""
    line = F.col("ip") if fmt == "simple" else detailed_line()
    return threats.select("ip", "score", "last_seen", line.alias("value"))


def header_lines(spark: SparkSession, as_of: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if as_of is None else as_of
    title = F.concat(F.lit(TITLE), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    lines = F.array(title, F.lit(LEGEND), F.lit(RULE))
    return spark.range(1).select(F.posexplode(lines).alias("_n", "value"))


def listed_ips(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct addresses of block-list text, header and blank lines skipped."""
    text = strip(F.col(value))
    first = F.split_part(strip(F.split_part(text, F.lit("|"), F.lit(1))), F.lit(" "), F.lit(1))
    return lines.where((text != "") & ~text.startswith("#")).select(first.alias("ip")).where("ip <> ''").distinct()


def read_block_list(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], "ip string")
    return listed_ips(spark.read.text(path))


def not_listed(threats: DataFrame, listed: DataFrame) -> DataFrame:
    return threats.join(listed.select("ip"), "ip", "left_anti")


def export_block_list(
    threats: DataFrame,
    path: str,
    fmt: str = "detailed",
    append: bool = False,
    deduplicate: bool = True,
    as_of: Column | None = None,
) -> int:
    """Write a block list as text files, best first, and return the number of addresses.

    Appending skips addresses that are listed already; overwriting writes the full
    selection.  A new detailed list starts with its header.
    """
    spark = threats.sparkSession
    fresh = not append or not path_exists(spark, path)
    if append and deduplicate and not fresh:
        threats = not_listed(threats, read_block_list(spark, path))
    written = Observation("block_list")
    ordered = block_lines(threats, fmt).select(
        F.lit(1).alias("_part"), F.col("score"), F.col("last_seen"), F.lit(0).alias("_n"), "value"
    )
    if fresh and fmt == "detailed":
        head = header_lines(spark, as_of).select(
            F.lit(0).alias("_part"), F.lit(None).cast("int").alias("score"),
            F.lit(None).cast("timestamp").alias("last_seen"), "_n", "value",
        )
        ordered = head.unionByName(ordered)
    ordered = ordered.orderBy("_part", "_n", F.desc("score"), F.desc("last_seen"), "value")
    # Counted above the sort: below it the sampling pass would count as well.
    counted = ordered.observe(written, F.count_if(F.col("_part") == 1).alias("n"))
    counted.select("value").write.mode("append" if append else "overwrite").text(path)
    return int(written.get["n"])


def export_level(threats: DataFrame, level: str = "LOW", fmt: str = "txt") -> DataFrame:
    """Threats from a level on, best first: the address, or the whole row as JSON text."""
    chosen = at_or_above(threats, level)
    columns = F.struct(*[c for c in threats.columns])
    value = F.to_json(columns, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}) if fmt == "json" else F.col("ip")
    return chosen.orderBy(F.desc("score"), "ip").select(value.alias("value"))


def backup_lines(threats: DataFrame) -> DataFrame:
    return threats.orderBy(F.desc("score"), "ip").select(F.col("ip").alias("value"))


def backup_before_purge(threats: DataFrame, expiring: DataFrame, folder: str, stamp: str) -> str | None:
    """Write all addresses to ``folder/ip_<stamp>.txt`` when any threat is about to expire."""
    if expiring.isEmpty():
        return None
    target = f"{folder.rstrip('/')}/ip_{stamp}.txt"
    backup_lines(threats).write.mode("overwrite").text(target)
    return target
