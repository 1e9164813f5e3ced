"""Threat table, block lists, reports and the scheduled job."""

import glob
import os
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from catalogue import inputs as I
from palisade.options import Options, SourceOptions
from palisade.plans import export, reports, store
from palisade.plans.job import publish, run_scan
from palisade.plans.store import Snapshots
from palisade.sources.lines import log_table_stats, purge_log_table, read_log_table, write_logs

T0 = datetime(2025, 12, 9, 10)
SCAN = "ip string, score int, threat_level string, reasons array<string>, hit_count bigint, first_seen timestamp, last_seen timestamp"


def scanned(spark, *rows):
    return spark.createDataFrame(list(rows), SCAN)


def at(ts):
    return F.lit(ts).cast("timestamp")


def test_merge_adds_and_regrades(spark):
    a = scanned(spark, ("1.1.1.1", 3, "LOW", ["x"], 2, T0, T0), ("2.2.2.2", 5, "MEDIUM", ["y"], 1, T0, T0))
    stored = store.mark_exported(store.new_records(a, at(T0)), a)
    later = T0 + timedelta(hours=1)
    new = scanned(spark, ("1.1.1.1", 5, "MEDIUM", ["z", "x"], 1, later, later), ("3.3.3.3", 1, "NONE", ["w"], 1, later, later))
    got = {r.ip: r for r in store.merge_threats(stored, new, Options(), at(later)).collect()}
    one = got["1.1.1.1"]
    assert (one.score, one.threat_level, one.reasons, one.hit_count) == (8, "CRITICAL", ["x", "z"], 3)
    assert (one.first_seen, one.last_seen, one.exported, one.created_at, one.updated_at) == (T0, later, False, T0, later)
    assert got["2.2.2.2"].exported and got["3.3.3.3"].threat_level == "NONE"


def test_purge_delete_lookup(spark):
    rows = store.new_records(scanned(spark, ("1.1.1.1", 3, "LOW", ["x"], 2, T0, T0), ("2.2.2.2", 5, "MEDIUM", [], 1, T0, T0 + timedelta(days=9))), at(T0))
    now = at(T0 + timedelta(days=10))
    assert [r.ip for r in store.purge_threats(rows, now, 5).collect()] == ["2.2.2.2"]
    assert store.purge_threats(rows, now, 0).count() == 2 and store.expired(rows, now, 0).count() == 0
    assert [r.ip for r in store.expired(rows, now, 5).collect()] == ["1.1.1.1"]
    assert store.lookup(rows, "2.2.2.2").count() == 1
    assert [r.ip for r in store.delete_threats(rows, spark.createDataFrame([("2.2.2.2",)], "ip string")).collect()] == ["1.1.1.1"]


def test_snapshots_are_complete_and_repeatable(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "ip string, n bigint", keep=2)
    assert table.read().count() == 0
    for n in range(4):
        table.write(spark.createDataFrame([("a", n)], "ip string, n bigint"), f"batch{n}")
    assert table.read().first().n == 3 and table.read("batch3").first().n == 2
    assert table.tags() == {"batch2", "batch3"}
    (tmp_path / "t" / "snapshot-00000009-broken").mkdir()  # a write that never finished
    assert table.read().first().n == 3


def test_block_list_files(spark, tmp_path):
    path = str(tmp_path / "block")
    first = scanned(spark, ("192.168.1.100", 9, "CRITICAL", ["a", "b"], 15, T0, T0 + timedelta(minutes=110)), ("2.2.2.2", 2, "LOW", [], 1, None, T0))
    assert export.export_block_list(first, path, append=True, as_of=at(T0)) == 2
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == sorted([
        "# IP威胁记录 - 更新时间: 2025-12-09 10:00:00", export.LEGEND, export.RULE,
        "192.168.1.100 | CRITICAL | a,b | 15 | 2025-12-09 10:00:00 | 2025-12-09 11:50:00",
        "2.2.2.2 | LOW | - | 1 | - | 2025-12-09 10:00:00",
    ])
    more = first.unionByName(scanned(spark, ("3.3.3.3", 4, "MEDIUM", ["c"], 1, T0, T0)))
    assert export.export_block_list(more, path, append=True) == 1
    assert sorted(r.ip for r in export.read_block_list(spark, path).collect()) == ["192.168.1.100", "2.2.2.2", "3.3.3.3"]
    assert export.export_block_list(more, path, fmt="simple") == 3
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["192.168.1.100", "2.2.2.2", "3.3.3.3"]


def test_reports(spark):
    rows = store.new_records(scanned(
        spark, ("1.1.1.1", 9, "CRITICAL", ["WAF拦截(a)", "XSS攻击特征", "恶意UA(z)", "q"], 2, T0, T0),
        ("2.2.2.2", 5, "MEDIUM", ["高频访问(7次/60秒)"], 4, T0 - timedelta(days=2), T0), ("3.3.3.3", 1, "NONE", ["w"], 1, T0, T0),
    ), at(T0))
    assert [r.ip for r in reports.select_threats(rows, limit=2).collect()] == ["1.1.1.1", "2.2.2.2"]
    assert reports.select_threats(rows, "LOW").count() == 2
    assert [r.ip for r in reports.list_threats(rows, sort="drop table", order="asc", per_page=1, page=2).collect()] == ["2.2.2.2"]
    assert [r.ip for r in reports.search(rows, "waf").collect()] == ["1.1.1.1"]
    assert reports.search(rows, "2_2.%2").count() == 1 and reports.search(rows, "\\").count() == 0
    assert reports.page_info(rows, per_page=2).first().asDict() == {"total": 3, "pages": 2}
    assert reports.level_stats(rows).first().asDict() == {"total": 3, "low": 0, "medium": 1, "high": 0, "critical": 1, "unexported": 3}
    assert reports.new_on(rows, "2025-12-09").first().today == 2
    assert [r.n for r in reports.trend(rows, "2025-12-09").orderBy("day").collect()] == [0, 0, 0, 0, 1, 0, 2]
    shown = rows.select("ip", reports.reason_preview(F.col("reasons")).alias("p"), reports.score_percent(F.col("score")).alias("s"))
    assert shown.where("ip = '1.1.1.1'").first().p == "WAF拦截(a),XSS攻击特征,恶意UA(z) +1" and shown.agg(F.max("s")).first()[0] == 60.0
    words = spark.createDataFrame([("免费WAF拦截(url)",), ("模板注入特征",), ("敏感路径扫描",), ("w",)], "r string")
    assert [r[0] for r in words.select(reports.reason_severity(F.col("r"))).collect()] == ["critical", "high", "medium", ""]
    texts = spark.createDataFrame([('["a","b"]',), ("plain",)], "t string")
    assert [r[0] for r in texts.select(reports.reasons_from_json(F.col("t"))).collect()] == [["a", "b"], ["plain"]]


def test_scheduled_run(spark, tmp_path):
    lines = ['%s - - [%s] "GET %s HTTP/1.1" 200 1 "-" "curl"' % (ip, f"09/Dec/2025:10:00:{i:02d} +0000", path)
             for i, (ip, path) in enumerate([("5.5.5.5", "/?q=union+select"), ("66.249.64.1", "/?q=union+select"), ("6.6.6.6", "/ok")])]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    options = Options(
        sources={"nginx": SourceOptions((f"{tmp_path}/*.log",))}, allow_entries=("66.249.64.0/24",), threat_retention_days=0
    )
    block, folder = str(tmp_path / "block"), str(tmp_path / "work")
    result = run_scan(spark, folder, block, options)
    assert (result["entries_processed"], result["threats_exported"], result["threats"]["medium"]) == (2, 1, 1)
    again = run_scan(spark, folder, block, options)
    assert again["threats_exported"] == 0 and again["threats"]["critical"] == 1  # 5 + 5
    table = Snapshots(spark, f"{folder}/threats")
    assert publish(table, block, options, append=False, min_level="LOW") == 1
    assert table.read().first().exported


def test_options_from_config():
    options = Options.from_dict({
        "thresholds": {"frequency": {"window_seconds": 60}, "path_scan": {"max_sensitive_hits": 2}},
        "threat_scores": {"sql_injection": 7, "unknown": 1}, "threat_levels": {"LOW": 1},
        "log_sources": {"ssh": {"enabled": False}}, "whitelist": ["1.1.1.1"], "output": {"format": "simple"},
    })
    assert (options.frequency_window, options.max_requests, options.max_sensitive_hits) == (60, 100, 2)
    assert options.scores.sql_injection == 7 and dict(options.levels)["LOW"] == 1
    assert not options.sources["ssh"].enabled and options.sources["nginx"].enabled
    assert options.allow_entries == ("1.1.1.1",) and options.output_format == "simple"


def test_log_table_keeps_other_days_and_drops_old_ones(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = I.logs(spark, "/root/testdata/sf0.001").where("timestamp < timestamp '2024-01-06'")
    write_logs(logs, path)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    one = logs.where("to_date(timestamp) = date '2024-01-03' and source = 'nginx'").limit(2)
    write_logs(one, path, mode="overwrite")  # replaces this source and day only
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    untouched = {f for f in before if "source=nginx/log_date=2024-01-03" not in f}
    assert {f: after.get(f) for f in untouched} == {f: before[f] for f in untouched}
    assert read_log_table(spark, path, "2024-01-03", "2024-01-03").where("source = 'nginx'").count() == 2
    plan = read_log_table(spark, path, "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "log_date#" in plan
    assert purge_log_table(spark, path, date(2024, 1, 6), 0) == 0
    assert purge_log_table(spark, path, date(2024, 1, 6), 3) > 0
    left = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    assert left == {f: t for f, t in after.items() if f.split("log_date=")[1][:10] >= "2024-01-03"}
    stats = {r.source: r.first_day for r in log_table_stats(read_log_table(spark, path)).collect()}
    assert min(stats.values()) == date(2024, 1, 3)
