"""Queries over the threat table: selections, lists, statistics and display columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.detectors import suspicious_status
from palisade.options import LEVELS

# Sortable columns and display texts, first matching keyword wins.
SORTS = ("score", "hit_count", "first_seen", "last_seen", "ip")
CRITICAL_WORDS = ("SQL注入", "WAF拦截", "命令注入", "Java反序列化", "SSH登录失败")
HIGH_WORDS = ("XSS", "路径遍历", "文件包含", "SSRF", "XXE", "模板注入")
MEDIUM_WORDS = ("敏感路径", "恶意UA")
DESCRIPTIONS = (
    ("高频访问", "短时间内发送大量请求，可能是爬虫、扫描器或DDoS攻击"),
    ("敏感路径扫描", "尝试访问敏感文件或目录，如配置文件、后台入口等"),
    ("SQL注入特征", "请求中包含SQL注入攻击代码"),
    ("XSS攻击特征", "请求中包含跨站脚本攻击代码"),
    ("路径遍历攻击", "尝试通过../等方式访问系统文件"),
    ("命令注入特征", "请求中包含系统命令注入代码"),
    ("文件包含攻击", "尝试利用文件包含漏洞读取或执行文件"),
    ("SSRF攻击特征", "尝试服务端请求伪造攻击"),
    ("XXE攻击特征", "XML外部实体注入攻击"),
    ("模板注入特征", "服务端模板注入攻击"),
    ("Java反序列化攻击", "Java反序列化漏洞利用"),
    ("恶意UA", "使用已知的攻击工具User-Agent"),
    ("WAF拦截", "被Web应用防火墙拦截的恶意请求"),
    ("SSH登录失败", "SSH暴力破解尝试"),
    ("大量错误响应", "触发大量4xx/5xx错误，可能是扫描或攻击行为"),
)
OTHER_DESCRIPTION = "检测到可疑行为"
FULL_SCORE = 15
PREVIEW = 3


# --- selections -----------------------------------------------------------------


def levels_from(level: str) -> list[str]:
    return list(LEVELS[LEVELS.index(level):]) if level in LEVELS else list(LEVELS)


def at_or_above(threats: DataFrame, level: str) -> DataFrame:
    return threats.where(F.col("threat_level").isin(levels_from(level)))


def select_threats(
    threats: DataFrame, min_level: str | None = None, unexported_only: bool = False, limit: int | None = None
) -> DataFrame:
    """Threats by score and recency, optionally from a level on and not yet exported."""
    chosen = at_or_above(threats, min_level) if min_level in LEVELS else threats
    chosen = chosen.where(~F.col("exported")) if unexported_only else chosen
    ordered = chosen.orderBy(F.desc("score"), F.desc("last_seen"), "ip")
    return ordered.limit(limit) if limit else ordered


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reasons_json(c: Column) -> Column:
    return F.to_json(c)


def reasons_from_json(c: Column) -> Column:
    """Reasons of a JSON text; a text that is no JSON list is one reason itself."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array(c))


def search(threats: DataFrame, text: str) -> DataFrame:
    """Substring search in address and reasons; ``%`` and ``_`` are wildcards, ASCII case is ignored."""
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    pattern = "%" + lowered.replace("\\", "\\\\") + "%"
    found = [_ascii_lower(c).like(pattern) for c in (F.col("ip"), reasons_json(F.col("reasons")))]
    return threats.where(reduce(or_, found))


def matching(threats: DataFrame, level: str = "", text: str = "") -> DataFrame:
    chosen = threats.where(F.col("threat_level") == level) if level else threats
    return search(chosen, text) if text else chosen


def list_threats(
    threats: DataFrame,
    level: str = "",
    text: str = "",
    sort: str = "score",
    order: str = "desc",
    page: int = 1,
    per_page: int = 20,
) -> DataFrame:
    """One page of the filtered list; an unknown sort column means score."""
    column = sort if sort in SORTS else "score"
    key = F.desc(column) if order.lower() == "desc" else F.asc(column)
    return matching(threats, level, text).orderBy(key, "ip").offset((page - 1) * per_page).limit(per_page)


def page_info(threats: DataFrame, level: str = "", text: str = "", per_page: int = 20) -> DataFrame:
    total = F.count("*")
    return matching(threats, level, text).agg(
        total.alias("total"), F.ceil(total / per_page).cast("bigint").alias("pages")
    )


# --- statistics -----------------------------------------------------------------


def level_stats(threats: DataFrame) -> DataFrame:
    """Totals by level and of unexported threats, as one row."""
    by_level = [F.count_if(F.col("threat_level") == level).alias(level.lower()) for level in LEVELS]
    return threats.agg(F.count("*").alias("total"), *by_level, F.count_if(~F.col("exported")).alias("unexported"))


def new_on(threats: DataFrame, day: str) -> DataFrame:
    return threats.where(F.to_date("first_seen") == F.lit(day).cast("date")).agg(F.count("*").alias("today"))


def trend(threats: DataFrame, last_day: str, days: int = 7) -> DataFrame:
    """New threats on each of the last days, zero-filled, with their share of the maximum."""
    last = F.lit(last_day).cast("date")
    calendar = threats.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")
    )
    counted = (
        threats.select(F.to_date("first_seen").alias("day"))
        .where(F.col("day").between(F.date_sub(last, days - 1), last))
        .groupBy("day")
        .agg(F.count("*").alias("n"))
    )
    filled = calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    top = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))  # over the few calendar rows
    return filled.withColumn("ratio", F.col("n") / top)


def request_count(logs: DataFrame, ip: str, as_of: Column, seconds: int) -> DataFrame:
    """Requests of one address in the last seconds before ``as_of``."""
    recent = F.col("timestamp") > as_of - F.expr(f"interval {seconds} seconds")
    return logs.where((F.col("ip") == ip) & recent).agg(F.count("*").alias("requests"))


def error_count(logs: DataFrame, ip: str, as_of: Column, seconds: int) -> DataFrame:
    """Suspicious error responses to one address in the last seconds before ``as_of``."""
    errors = logs.where(suspicious_status(F.col("status")))
    return request_count(errors, ip, as_of, seconds).withColumnRenamed("requests", "errors")


# --- display columns ------------------------------------------------------------


def _has_any(reason: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [reason.contains(w) for w in words])


def reason_severity(reason: Column) -> Column:
    return (
        F.when(_has_any(reason, CRITICAL_WORDS), "critical")
        .when(_has_any(reason, HIGH_WORDS), "high")
        .when(_has_any(reason, MEDIUM_WORDS), "medium")
        .otherwise("")
    )


def reason_description(reason: Column) -> Column:
    (word, text), *others = DESCRIPTIONS
    described = F.when(reason.contains(word), text)
    for word, text in others:
        described = described.when(reason.contains(word), text)
    return described.otherwise(OTHER_DESCRIPTION)


def score_percent(score: Column) -> Column:
    return F.least(score / FULL_SCORE * 100, F.lit(100.0))


def reason_preview(reasons: Column) -> Column:
    """The first reasons, and how many more there are."""
    more = F.size(reasons) - PREVIEW
    shown = F.array_join(F.slice(reasons, 1, PREVIEW), ",")
    return F.when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"))).otherwise(shown)
