"""The named queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import inputs as I
from palisade.functions import ip as ipf
from palisade.functions.times import iso_text, parse_timestamp
from palisade.operators import detectors as D
from palisade.operators import windows as W
from palisade.operators.allow import allow_audit, longest_rule
from palisade.operators.rulebook import BY_CODE, searchable
from palisade.operators.scoring import findings, threat_level, threats
from palisade.options import SourceOptions
from palisade.plans import export, reports, store
from palisade.plans.scan import detector_metrics, scan, scan_findings, source_metrics
from palisade.session import shared_dir
from palisade.sources.allowlist import allow_counts, entry_lines, intervals
from palisade.sources.lines import log_table_stats, purge_log_table, read_log_table, stream_logs, write_logs
from palisade.sources.parsers import (
    FREE_WAF_FALLBACK,
    FREE_WAF_OBJECT,
    ParseContext,
    parse_lines,
    register_source,
)
from palisade.streaming.live import LiveScan

Query = Callable[[SparkSession, str], DataFrame]

NOW = "2024-02-01 00:00:00"
register_source("free_waf_object", FREE_WAF_OBJECT)
register_source("free_waf_fallback", FREE_WAF_FALLBACK)


def _ntz(df: DataFrame) -> DataFrame:
    """Times as the plain UTC times the oracle compares, lists as text."""
    kinds = dict(df.dtypes)
    shown: list[Column] = []
    for name in df.columns:
        if kinds[name] == "timestamp":
            shown.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif kinds[name] == "array<string>":
            shown.append(F.array_join(name, "|").alias(name))
        else:
            shown.append(F.col(name))
    return df.select(*shown)


def _as_of(text: str = I.AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def _parsed(df: DataFrame, *extra: str) -> DataFrame:
    picked = [F.col("extra")[key].alias(f"x_{key}") for key in extra]
    plain = ("seq", "timestamp", "ip", "source", "method", "path", "status", "user_agent", "raw")
    return _ntz(df.select(*plain, *picked))


def _parse(spark: SparkSession, lines: DataFrame, source: str, *extra: str) -> DataFrame:
    return _parsed(parse_lines(lines, source, ParseContext.at(NOW)), *extra)


# --- parsing --------------------------------------------------------------------


def parse_nginx(spark, sf_dir):
    return _parse(spark, I.lines(spark, sf_dir, "nginx"), "nginx", "referer", "bytes", "user", "protocol")


def parse_waf_json(spark, sf_dir):
    return _parse(spark, I.lines(spark, sf_dir, "waf"), "waf", "rule_id", "action", "attack_type")


def parse_free_waf(spark, sf_dir):
    keys = ("rule_type", "rule_detail", "raw_request", "action", "domain")
    return _parse(spark, I.lines(spark, sf_dir, "free_waf"), "free_waf", *keys)


def parse_free_waf_object(spark, sf_dir):
    """Object lines: the WAF lines hold the same keys."""
    return _parse(spark, I.lines(spark, sf_dir, "waf"), "free_waf_object", "rule_type", "action", "domain")


def parse_free_waf_fallback(spark, sf_dir):
    return _parse(spark, I.lines(spark, sf_dir, "ssh"), "free_waf_fallback", "action")


def parse_ssh(spark, sf_dir):
    return _parse(spark, I.lines(spark, sf_dir, "ssh"), "ssh", "action", "failed", "host")


def parse_auto(spark, sf_dir):
    lines = I.lines(spark, sf_dir)
    noise = lines.select("seq", F.expr("case seq % 4 when 0 then '' when 1 then '# comment' "
                                       "when 2 then 'no match here' else '[1,{\"a\":2}]' end").alias("value"))  # fmt: skip
    return _parse(spark, lines.unionByName(noise), "auto")


def parse_times(spark, sf_dir):
    """One instant in every accepted time format."""
    shapes = """case seq % 6
        when 0 then date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss +0000')
        when 1 then date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')
        when 2 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
        when 3 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        when 4 then date_format(timestamp, 'MMM  d HH:mm:ss')
        else date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss') end"""
    texts = I.logs(spark, sf_dir).select("seq", F.expr(shapes).alias("text"))
    return _ntz(texts.select("seq", parse_timestamp(F.col("text"), year=F.lit(2024)).alias("parsed")))


def record_json(spark, sf_dir):
    rows = I.logs(spark, sf_dir)
    return rows.select(
        "seq", iso_text(F.col("timestamp")).alias("timestamp"),
        F.to_json(F.struct("ip", "source", "method", "path", "status", "user_agent")).alias("record"),
    )


# --- addresses and the allow list -----------------------------------------------

DECORATED = """case seq % 7 when 0 then concat(ip, ':8080') when 1 then concat('  ', ip, ' ')
    when 2 then concat(ip, ', 10.0.0.1') when 3 then concat('[', ip, ']') when 4 then concat(ip, '.5')
    when 5 then concat('0', ip) else ip end"""
MADE_IP = """case user_id % 8 when 0 then concat('10.1.', user_id % 256, '.7') when 1 then concat('192.168.0.', user_id % 256)
    when 2 then concat('172.', 10 + user_id % 30, '.0.1') when 3 then concat('8.8.', user_id % 256, '.8')
    when 4 then concat('100.', user_id % 256, '.0.1') when 5 then concat('169.', user_id % 256, '.1.1')
    when 6 then concat('198.', user_id % 64, '.3.4') else concat('300.1.1.', user_id % 256) end"""

MADE_IP6 = f"""case event_id % 8 when 0 then concat('fd00::', user_id % 1000) when 1 then concat('2606:4700::', user_id % 1000)
    when 2 then concat('::ffff:10.0.0.', user_id % 256) when 3 then concat('::ffff:8.8.8.', user_id % 256)
    when 4 then concat('2001:db8::', user_id % 1000, ':1') else {MADE_IP} end"""


def ip_normalize(spark, sf_dir):
    rows = I.logs(spark, sf_dir).select("seq", F.expr(DECORATED).alias("given"))
    return ipf.with_clean_ip(rows.withColumn("ip", F.col("given"))).select("seq", "given", "ip")


def ip_valid(spark, sf_dir):
    rows = I.logs(spark, sf_dir).select("seq", F.expr(DECORATED).alias("given"))
    return rows.select("seq", "given", ipf.is_valid_ip("given").alias("valid"))


def ip_private(spark, sf_dir):
    rows = I.table(spark, sf_dir, "events").select("event_id", F.expr(MADE_IP6).alias("ip"))
    return ipf.with_private(rows)


def ip_extract_text(spark, sf_dir):
    texts = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ipf.with_extracted_ip(texts, "text")
    return found.where(F.col("ip").contains(".")).select("doc_id", "ip")


MADE_ENTRY = """case c_custkey % 6
    when 0 then concat('10.', floor(c_custkey / 256) % 256, '.', c_custkey % 256, '.9')
    when 1 then concat('11.', c_custkey % 256, '.77.200/', 8 + c_custkey % 25, '   # host bits')
    when 2 then concat('12.0.', c_custkey % 200, '.1-12.0.', c_custkey % 200 + 5, '.9')
    when 3 then concat('12.0.', c_custkey % 200 + 5, '.9-12.0.', c_custkey % 200, '.1')
    when 4 then concat('# note ', c_custkey) else concat('host-', c_custkey) end"""


def _made_allow(spark, sf_dir):
    text = I.table(spark, sf_dir, "customer").select(F.expr(MADE_ENTRY).alias("value"))
    return intervals(entry_lines(text))


def allow_bounds(spark, sf_dir):
    return _made_allow(spark, sf_dir).select("kind", "lo", "hi")


def allow_counts_by_kind(spark, sf_dir):
    return allow_counts(_made_allow(spark, sf_dir))


def allow_anti_join(spark, sf_dir):
    return _ntz(I.admitted(spark, sf_dir).select("seq", "timestamp", "ip", "source", "status"))


def allow_semi_audit(spark, sf_dir):
    audit = allow_audit(I.logs(spark, sf_dir), I.allow_list(spark))
    return audit.groupBy("ip", "entry", "kind").agg(F.count("*").alias("requests"))


RULED_IP = """case event_id % 4 when 0 then concat('10.', event_id % 3, '.', user_id % 256, '.9')
    when 1 then concat('11.', user_id % 256, '.77.', 190 + event_id % 60) when 2 then concat('12.0.', user_id % 256, '.', event_id % 12)
    else concat('11.', event_id % 256, '.', 64 + user_id % 64, '.200') end"""


def allow_longest_rule(spark, sf_dir):
    """The innermost entry of a large nested list over each address."""
    rows = I.table(spark, sf_dir, "events").select("event_id", F.expr(RULED_IP).alias("ip"))
    return longest_rule(rows, _made_allow(spark, sf_dir))


# --- detectors ------------------------------------------------------------------


def _hits(df: DataFrame) -> DataFrame:
    return _ntz(df.select("ip", "seq", "timestamp", "last_seen", "analyzer", "reason", "score", "hits"))


def _pattern(code: str) -> Query:
    def run(spark, sf_dir):
        return _hits(D.pattern_hits(I.admitted(spark, sf_dir), I.RULES, I.OPTIONS, (code,)))

    return run


def detect_sensitive_path(spark, sf_dir):
    return _hits(D.sensitive_path_hits(I.admitted(spark, sf_dir), I.RULES, I.OPTIONS))


def _pages(code: str) -> Query:
    """A request category over real URLs and HTML, searched as path and raw line."""

    def run(spark, sf_dir):
        pages = I.table(spark, sf_dir, "pages").select(
            "page_id", F.col("url").alias("path"), F.col("html").alias("raw"), F.lit("").alias("user_agent")
        )
        return searchable(pages, [code]).where(I.RULES.matches(code)).select("page_id")

    return run


def prose_matches(spark, sf_dir):
    """How often a category hits harmless prose, text searched line by line."""
    turns = I.table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("raw")).withColumns(
        {"path": F.lit("/"), "user_agent": F.lit("")}
    )
    codes = ("command_injection", "sql_injection", "ssti", "file_inclusion")
    counts = [F.count_if(I.RULES.matches(c)).alias(c) for c in codes]
    return searchable(rows, codes).groupBy("conv_id").agg(F.count("*").alias("lines"), *counts)


def rule_first_match(spark, sf_dir):
    """First matching rule of each category on every record it matches."""
    rows = searchable(I.admitted(spark, sf_dir))
    found = F.array(
        *[
            F.struct(
                F.lit(code).alias("category"),
                F.when(I.RULES.matches(code), I.RULES.first_rule(code)).alias("rule_no"),
            )
            for code in BY_CODE
        ]
    )
    return rows.select("seq", F.inline(found)).where(F.col("rule_no").isNotNull())


def rate_sliding(spark, sf_dir):
    rows = I.admitted(spark, sf_dir).select("ip", "seq", "timestamp")
    return _ntz(W.sliding_counts(rows, I.OPTIONS.frequency_window))


def detect_frequency(spark, sf_dir):
    return _hits(D.frequency_hits(I.admitted(spark, sf_dir), I.OPTIONS))


def error_sliding(spark, sf_dir):
    rows = I.admitted(spark, sf_dir).where(D.suspicious_status(F.col("status")))
    return _ntz(W.sliding_counts(rows.select("ip", "seq", "timestamp", "status"), I.OPTIONS.error_window))


def detect_error_flood(spark, sf_dir):
    return _hits(D.error_flood_hits(I.admitted(spark, sf_dir), I.OPTIONS))


COUNT_IP, COUNT_SECONDS = "203.0.0.8", 20 * 86_400


def ip_request_count(spark, sf_dir):
    return reports.request_count(I.logs(spark, sf_dir), COUNT_IP, _as_of(), COUNT_SECONDS)


def ip_error_count(spark, sf_dir):
    return reports.error_count(I.logs(spark, sf_dir), COUNT_IP, _as_of(), COUNT_SECONDS)


# --- scoring and the scan -------------------------------------------------------


def hits_by_reason(spark, sf_dir):
    found = findings(D.pattern_hits(I.admitted(spark, sf_dir), I.RULES, I.OPTIONS))
    return _ntz(found.select("ip", "analyzer", "reason", "score", "hits", "first_seen", "last_seen"))


def threats_by_ip(spark, sf_dir):
    return _ntz(threats(findings(D.pattern_hits(I.admitted(spark, sf_dir), I.RULES, I.OPTIONS)), I.OPTIONS))


def threat_levels(spark, sf_dir):
    graded = I.threat_table(spark, sf_dir)
    return graded.select("ip", "score", threat_level(F.col("score"), I.OPTIONS).alias("threat_level"))


def threat_scan(spark, sf_dir):
    return _ntz(scan(I.logs(spark, sf_dir), I.allow_list(spark), I.OPTIONS, I.RULES))


def stream_scan(spark, sf_dir):
    """The scan as incremental runs of one stream, the records arriving in two parts."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-scan-{uuid.uuid4().hex}"
    records = I.logs(spark, sf_dir)
    live = LiveScan(spark, f"{folder}/state", I.allow_list(spark), I.OPTIONS, I.RULES)
    split = _as_of(I.SPLIT_AT)
    for part in (F.col("timestamp") < split, F.col("timestamp") >= split):
        records.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(records.schema).parquet(f"{folder}/in")
        live.start(stream, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    found = live.threats.read()
    return _ntz(found.select("ip", "score", "threat_level", "reasons", "hit_count", "first_seen", "last_seen"))


SCANNED = ("ip", "score", "threat_level", "reasons", "hit_count", "first_seen", "last_seen")


def _stream_folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _feed(spark, live: LiveScan, records: DataFrame, folder: str, checkpoint: str) -> None:
    """One incremental run of a query over what ``folder`` has got, after adding some records to it."""
    records.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(records.schema).parquet(f"{folder}/in")
    live.start(stream, f"{folder}/{checkpoint}", availableNow=True).awaitTermination()


def stream_rate(spark, sf_dir):
    """Rate findings kept as state over two incremental runs."""
    folder, records = _stream_folder(spark, "stream-rate"), I.logs(spark, sf_dir)
    live = LiveScan(spark, f"{folder}/state", I.allow_list(spark), I.OPTIONS, I.RULES, late_seconds=3600)
    for part in (F.col("timestamp") < _as_of(I.SPLIT_AT), F.col("timestamp") >= _as_of(I.SPLIT_AT)):
        _feed(spark, live, records.where(part), folder, "checkpoint")
    found = live.state.read(live.state.newest()[1], "findings").where(F.col("analyzer") == D.FREQUENCY)
    return _ntz(found.select(
        "ip", F.col("first_seq").alias("seq"), F.col("first_seen").alias("timestamp"), "last_seen", "analyzer", "reason", "score", "hits"
    ))


def stream_late(spark, sf_dir):
    """The scan of records that arrive in any order, within the delay that is allowed."""
    folder, records = _stream_folder(spark, "stream-late"), I.logs(spark, sf_dir)
    live = LiveScan(spark, f"{folder}/state", I.allow_list(spark), I.OPTIONS, I.RULES, late_seconds=366 * 86_400)
    part = F.pmod(F.xxhash64("seq"), F.lit(2))
    for k in (1, 0):
        _feed(spark, live, records.where(part == k), folder, "checkpoint")
    return _ntz(live.threats.read().select(*SCANNED))


def stream_two_queries(spark, sf_dir):
    """The scan by two queries that share one state; the second goes on under a new checkpoint."""
    folder, records = _stream_folder(spark, "stream-two"), I.logs(spark, sf_dir)
    scans = [LiveScan(spark, f"{folder}/state", I.allow_list(spark), I.OPTIONS, I.RULES) for _ in range(2)]
    part = F.pmod(F.col("seq"), F.lit(3))
    for which, (who, name, checkpoint) in enumerate(((0, "a", "one"), (1, "b", "one"), (1, "c", "two"))):
        _feed(spark, scans[who], records.where(part == which), f"{folder}/{name}", checkpoint)
    return _ntz(scans[0].threats.read().select(*SCANNED))


def stream_lines(spark, sf_dir):
    """Log files of all sources as a stream of records; the folders get more files between two runs."""
    folder, made = _stream_folder(spark, "stream-lines"), I.logs(spark, sf_dir).select("timestamp", "source", "raw")
    sources = {name: SourceOptions((f"{folder}/{name}/*.txt",)) for name in ("nginx", "waf", "free_waf", "ssh")}
    ctx = ParseContext.at("2024-02-01 00:00:00")
    for part in (F.col("timestamp") < _as_of(I.SPLIT_AT), F.col("timestamp") >= _as_of(I.SPLIT_AT)):
        for name in sources:
            made.where(part & (F.col("source") == name)).select("raw").write.mode("append").text(f"{folder}/{name}")
        stream = stream_logs(spark, I.OPTIONS.with_(sources=sources), ctx)
        writer = stream.drop("extra", "seq").writeStream.format("parquet").option("path", f"{folder}/out")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _ntz(spark.read.parquet(f"{folder}/out"))


def stats_sources(spark, sf_dir):
    return source_metrics(I.logs(spark, sf_dir), I.allow_list(spark), I.OPTIONS, I.RULES)


def stats_detectors(spark, sf_dir):
    """Events of all detectors of one scan, the rate, error and sensitive-path ones included."""
    return _ntz(detector_metrics(scan_findings(I.admitted(spark, sf_dir), I.OPTIONS, I.RULES)))


# --- the threat table -----------------------------------------------------------


def threat_upsert(spark, sf_dir):
    first = I.threat_table(spark, sf_dir, until=I.SPLIT_AT)
    second = I.threat_table(spark, sf_dir, since=I.SPLIT_AT)
    merged = store.merge_threats(
        store.new_records(first, _as_of(I.SPLIT_AT)), second, I.OPTIONS, _as_of()
    )
    return _ntz(merged)


RETENTION = 3


def threat_purge(spark, sf_dir):
    return _ntz(store.purge_threats(I.threat_table(spark, sf_dir), _as_of(), RETENTION))


def threat_delete(spark, sf_dir):
    table = I.threat_table(spark, sf_dir)
    keys = table.where(F.col("hit_count") % 2 == 0).select("ip")
    return _ntz(store.delete_threats(table, keys))


def threat_lookup(spark, sf_dir):
    return _ntz(store.lookup(I.threat_table(spark, sf_dir), COUNT_IP))


def log_purge(spark, sf_dir):
    kept = store.purge_logs(I.logs(spark, sf_dir), _as_of(), 10, created="timestamp")
    return _ntz(kept.select("seq", "timestamp", "ip", "source"))


def stats_storage(spark, sf_dir):
    """The log table after retention dropped its old days."""
    folder = _stream_folder(spark, "log-table")
    write_logs(I.logs(spark, sf_dir), folder)
    purge_log_table(spark, folder, date(2024, 1, 31), 10)
    return log_table_stats(read_log_table(spark, folder))


def export_detailed(spark, sf_dir):
    return export.block_lines(I.threat_table(spark, sf_dir)).select("value")


def export_simple(spark, sf_dir):
    return export.block_lines(I.threat_table(spark, sf_dir), "simple").select("value")


def export_json(spark, sf_dir):
    columns = ("ip", "score", "threat_level", "hit_count", "first_seen", "last_seen")
    return export.export_level(I.threat_table(spark, sf_dir).select(*columns), "HIGH", "json")


def export_new_only(spark, sf_dir):
    """Lines for threats that an earlier block list does not name."""
    earlier = export.block_lines(I.threat_table(spark, sf_dir, until="2024-01-02 00:00:00"))
    new = export.not_listed(I.threat_table(spark, sf_dir), export.listed_ips(earlier))
    return export.block_lines(new).select("value")


def exported_count(spark, sf_dir):
    lines = export.block_lines(I.threat_table(spark, sf_dir)).select("value")
    return export.listed_ips(lines).agg(F.count("*").alias("exported"))


def unexported(spark, sf_dir):
    return _ntz(reports.select_threats(I.stored_threats(spark, sf_dir), "MEDIUM", unexported_only=True))


def mark_exported(spark, sf_dir):
    table = I.stored_threats(spark, sf_dir)
    marked = store.mark_exported(table, reports.at_or_above(table, "HIGH"))
    return marked.select("ip", "threat_level", "exported")


def backup_ips(spark, sf_dir):
    return export.backup_lines(I.threat_table(spark, sf_dir))


# --- reports --------------------------------------------------------------------


def stats_levels(spark, sf_dir):
    return reports.level_stats(I.stored_threats(spark, sf_dir))


def stats_today(spark, sf_dir):
    return reports.new_on(I.threat_table(spark, sf_dir), "2024-01-02")


def stats_trend7(spark, sf_dir):
    return reports.trend(I.threat_table(spark, sf_dir), "2024-01-07")


def list_threats(spark, sf_dir):
    page = reports.list_threats(
        I.threat_table(spark, sf_dir), level="CRITICAL", text="WAF", sort="hit_count", order="desc", page=2, per_page=5
    )
    return _ntz(page)


def page_info(spark, sf_dir):
    return reports.page_info(I.threat_table(spark, sf_dir), text="203.0.%1", per_page=7)


def _reasons(spark, sf_dir):
    return findings(D.pattern_hits(I.admitted(spark, sf_dir), I.RULES, I.OPTIONS)).select("ip", "reason")


def reason_severity(spark, sf_dir):
    return _reasons(spark, sf_dir).select("ip", "reason", reports.reason_severity(F.col("reason")).alias("severity"))


def reason_description(spark, sf_dir):
    described = reports.reason_description(F.col("reason")).alias("description")
    return _reasons(spark, sf_dir).select("reason", described).distinct()


def score_percent(spark, sf_dir):
    table = I.threat_table(spark, sf_dir)
    return table.select("ip", F.round(reports.score_percent(F.col("score")), 6).alias("percent"))


def reason_preview(spark, sf_dir):
    table = I.threat_table(spark, sf_dir)
    return table.select("ip", reports.reason_preview(F.col("reasons")).alias("preview"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        parse_nginx, parse_waf_json, parse_free_waf, parse_free_waf_object, parse_free_waf_fallback, parse_ssh,
        parse_auto, parse_times, record_json, ip_normalize, ip_valid, ip_private, ip_extract_text, allow_bounds,
        allow_anti_join, allow_semi_audit, allow_longest_rule, detect_sensitive_path, prose_matches, rule_first_match, rate_sliding, detect_frequency,
        error_sliding, detect_error_flood, ip_request_count, ip_error_count, hits_by_reason, threats_by_ip,
        threat_levels, threat_scan, stream_scan, stream_rate, stream_late, stream_two_queries, stream_lines, threat_upsert, threat_purge, threat_delete, threat_lookup, log_purge, stats_storage,
        export_detailed, export_simple, export_json, export_new_only, unexported, mark_exported, backup_ips,
        stats_levels, stats_today, stats_trend7, stats_sources, stats_detectors, exported_count, list_threats, page_info,
        reason_severity, reason_description, score_percent, reason_preview,
    )
}
QUERIES["allow_counts"] = allow_counts_by_kind
QUERIES |= {
    "detect_waf": _pattern("waf_block"),
    "detect_free_waf": _pattern("free_waf_block"),
    "detect_ssh_failed": _pattern("ssh_failed"),
    "detect_java_deser": _pattern("java_deserialization"),
} | {
    f"detect_{code}": _pattern(code)
    for code in (
        "sql_injection", "xss", "path_traversal", "command_injection", "file_inclusion", "ssrf", "xxe", "ssti",
        "malicious_ua",
    )
} | {f"pages_{code}": _pages(code) for code in ("xss", "xxe")}
