"""Detectors: ``logs -> hits``.

A hit row is ``(ip, seq, timestamp, last_seen, analyzer, rank, reason, score,
hits)``.  It stands for ``hits`` detections of one reason, the first of them at
(timestamp, seq); row-level detectors give one row per detection.  ``rank`` orders
reasons found on the same record.  Logs are expected after ``operators.allow.admit``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators import windows as W
from palisade.operators.rulebook import BY_CODE, CATEGORIES, Rulebook, searchable, sql_text
from palisade.options import Options

Detector = Callable[[DataFrame], DataFrame]

HIT_COLUMNS = ("ip", "seq", "timestamp", "last_seen", "analyzer", "rank", "reason", "score", "hits")

# Analyzers, reasons outside the rule base, counted error statuses.
FREQUENCY, PATTERN, STATUS = "frequency", "pattern", "status_code"
WAF_REASON, FREE_WAF_REASON, SSH_REASON = "WAF拦截", "免费WAF拦截", "SSH登录失败"
FREQUENCY_REASON = "高频访问({n}次/{window}秒)"
ERROR_REASON = "大量错误响应({n}次,"
SUSPICIOUS_STATUS = (403, 500, 501, 502, 503, 504, 505)
TOP_STATUSES = 3

# Order of reasons on one record: rate first, then the pattern checks, then errors.
RANK = {FREQUENCY: 0, "waf_block": 1, "free_waf_block": 1, "ssh_failed": 2} | {
    c.code: 3 + i for i, c in enumerate(CATEGORIES)
}
RANK["error_flood"] = 3 + len(CATEGORIES)


def suspicious_status(c: Column) -> Column:
    return c.isin(*SUSPICIOUS_STATUS)


def _bracketed(reason: str, detail: str) -> str:
    plain = sql_text(reason)
    return f"case when coalesce({detail}, '') <> '' then concat({sql_text(reason + '(')}, {detail}, ')') else {plain} end"


def _check(code: str, rules: Rulebook, options: Options) -> str:
    """SQL text of a row-level check: a finding struct, NULL when it does not apply."""
    scores = options.scores
    if code == "waf_block":
        test, reason, score = "source = 'waf'", _bracketed(WAF_REASON, "extra['attack_type']"), scores.waf_block
    elif code == "free_waf_block":
        test, reason = "source = 'free_waf'", _bracketed(FREE_WAF_REASON, "extra['rule_type']")
        score = max(1, scores.waf_block // 2)
    elif code == "ssh_failed":
        test, reason = "source = 'ssh' and extra['failed'] = 'true'", sql_text(SSH_REASON)
        score = scores.ssh_bruteforce
    else:
        category = BY_CODE[code]
        test, score = rules.matches_sql(code), getattr(scores, category.score_field)
        reason = sql_text(category.reason)
        if category.on_agent:
            reason = f"concat({sql_text(category.reason + '(')}, {rules.first_pattern_sql(code)}, ')')"
    return f"case when {test} then named_struct('rank', {RANK[code]}, 'reason', {reason}, 'score', {score}) end"


ROW_CHECKS = ("waf_block", "free_waf_block", "ssh_failed") + tuple(c.code for c in CATEGORIES if not c.literal)


def checks_array(rules: Rulebook, options: Options, checks: Sequence[str] = ROW_CHECKS) -> Column:
    """All checks that apply to a ``searchable`` record, as an array of findings."""
    return F.expr(f"array_compact(array({', '.join(_check(c, rules, options) for c in checks)}))")


def pattern_hits(
    logs: DataFrame,
    rules: Rulebook | None = None,
    options: Options = Options(),
    checks: Sequence[str] = ROW_CHECKS,
) -> DataFrame:
    """One hit row per record and matching check, from one pass over the records."""
    found = checks_array(rules or Rulebook(), options, checks)
    return found_hits(searchable(logs, [c for c in checks if c in BY_CODE]).withColumn("found", found))


def found_hits(records: DataFrame) -> DataFrame:
    """Hit rows of records whose checks are in ``found``."""
    return records.select("ip", "seq", "timestamp", F.explode("found").alias("_f")).select(
        "ip", "seq", "timestamp",
        F.col("timestamp").alias("last_seen"),
        F.lit(PATTERN).alias("analyzer"),
        "_f.rank", "_f.reason", "_f.score",
        F.lit(1).cast("bigint").alias("hits"),
    )


def sensitive_rows(logs: DataFrame, rules: Rulebook | None = None) -> DataFrame:
    """Records whose path contains a sensitive literal."""
    slim = searchable(logs.select("ip", "seq", "timestamp", "path"), ["sensitive_path"])
    return slim.where((rules or Rulebook()).matches("sensitive_path")).select("ip", "seq", "timestamp")


def sensitive_summary_rows(rows: DataFrame, options: Options, hits: Column, last: Column) -> DataFrame:
    category = BY_CODE["sensitive_path"]
    return rows.select(
        "ip", "seq", "timestamp", last.alias("last_seen"),
        F.lit(PATTERN).alias("analyzer"), F.lit(RANK["sensitive_path"]).alias("rank"),
        F.lit(category.reason).alias("reason"), F.lit(options.scores.sensitive_path).alias("score"),
        hits.cast("bigint").alias("hits"),
    )


def sensitive_path_hits(
    logs: DataFrame, rules: Rulebook | None = None, options: Options = Options()
) -> DataFrame:
    """Row-level hits: every sensitive record from the ``n``-th of its address on."""
    rows = sensitive_rows(logs, rules)
    from_here = W.nth_rows(rows, options.max_sensitive_hits).select(
        "ip", F.struct("timestamp", "seq").alias("_from")
    )
    counted = rows.join(from_here, "ip").where(F.struct("timestamp", "seq") >= F.col("_from"))
    return sensitive_summary_rows(counted, options, F.lit(1), F.col("timestamp"))


def sensitive_path_summary(
    logs: DataFrame, rules: Rulebook | None = None, options: Options = Options()
) -> DataFrame:
    """The same hits folded to one row per address, without a join on record level."""
    return sensitive_summary(sensitive_rows(logs, rules), options)


def sensitive_summary(rows: DataFrame, options: Options = Options()) -> DataFrame:
    totals = rows.groupBy("ip").agg(F.count("*").alias("_n"), F.max("timestamp").alias("_last"))
    nth = W.nth_rows(rows, options.max_sensitive_hits).join(totals, "ip")
    return sensitive_summary_rows(nth, options, F.col("_n") - (options.max_sensitive_hits - 1), F.col("_last"))


def window_hits(first: DataFrame, analyzer: str, code: str, score: int) -> DataFrame:
    """Hit rows from one row per address: ip, seq, timestamp, t_last, hits, reason."""
    return first.select(
        "ip", "seq", "timestamp", F.timestamp_micros("t_last").alias("last_seen"),
        F.lit(analyzer).alias("analyzer"), F.lit(RANK[code]).alias("rank"),
        "reason", F.lit(score).alias("score"), F.col("hits").cast("bigint").alias("hits"),
    )


def frequency_reason(window: int, limit: int) -> Column:
    """The count at the first crossing is always ``limit + 1``: a record raises it by one at most."""
    return F.lit(FREQUENCY_REASON.format(n=limit + 1, window=window))


def error_reason(limit: int) -> Column:
    return F.concat(F.lit(ERROR_REASON.format(n=limit + 1)), F.col("top_statuses"), F.lit(")"))


def frequency_hits(logs: DataFrame, options: Options = Options()) -> DataFrame:
    """Addresses above the request rate, one row each."""
    return rate_hits(logs.select("ip", "seq", "timestamp"), options)


def rate_hits(rows: DataFrame, options: Options = Options()) -> DataFrame:
    window, limit = options.frequency_window, options.max_requests
    crossed = W.crossings(W.violations(rows, window, limit))
    first = W.crossing_window(rows, crossed, window, limit).where(F.col("_rn") == limit + 1)
    named = first.withColumn("reason", frequency_reason(window, limit))
    return window_hits(named, FREQUENCY, FREQUENCY, options.scores.frequency_violation)


def error_flood_hits(logs: DataFrame, options: Options = Options()) -> DataFrame:
    """Addresses above the error rate, one row each, with the top statuses in the reason."""
    return error_hits(logs.where(suspicious_status(F.col("status"))).select("ip", "seq", "timestamp", "status"), options)


def error_hits(rows: DataFrame, options: Options = Options()) -> DataFrame:
    window, limit = options.error_window, options.max_errors
    crossed = W.crossings(W.violations(rows, window, limit))
    first = W.top_statuses(W.crossing_window(rows, crossed, window, limit), TOP_STATUSES)
    return window_hits(first.withColumn("reason", error_reason(limit)), STATUS, "error_flood", options.scores.error_flood)
