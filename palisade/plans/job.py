"""One scheduled run: read, scan, merge, export, purge."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.allow import admit
from palisade.operators.rulebook import Rulebook
from palisade.operators.scoring import threats
from palisade.options import Options
from palisade.plans import export, reports, store
from palisade.plans.scan import admitted_metrics, scan_findings
from palisade.plans.store import Snapshots
from palisade.session import path_exists, use_utc
from palisade.sources.allowlist import allow_from_options
from palisade.sources.lines import purge_log_table, read_log_table, read_logs, stream_logs, write_logs
from palisade.streaming.live import LiveScan


def stage_logs(spark: SparkSession, options: Options, folder: str) -> DataFrame:
    """Parse all enabled sources and apply the allow list once, into a log table.

    The detectors pass over the records several times, each with few columns.  Over
    Parquet a pass costs only these columns; parsing, address keys and the interval
    join are paid once.
    """
    admitted = admit(read_logs(spark, options), allow_from_options(spark, options))
    started = spark.sql("select current_timestamp()").first()[0]
    write_logs(admitted, folder, mode="overwrite")
    # Days of earlier runs that are in no file any more stay stored, but are not scanned again.
    return read_log_table(spark, folder).where(F.col("created_at") >= F.lit(started))


def run_scan(
    spark: SparkSession,
    folder: str,
    block_list: str,
    options: Options = Options(),
    rules: Rulebook | None = None,
    logs: DataFrame | None = None,
) -> dict:
    """Scan, merge into the threat table, append new block-list lines, purge; returns counts.

    ``logs`` are admitted records; by default the enabled sources are read and staged.
    """
    use_utc(spark)
    table = Snapshots(spark, f"{folder}/threats")
    logs = stage_logs(spark, options, f"{folder}/logs") if logs is None else logs
    found = threats(scan_findings(logs, options, rules), options)
    table.update(lambda stored: store.merge_threats(stored, found, options), "scan")
    written = publish(table, block_list, options, append=True)
    purge(table, block_list, options)
    sources = {r["source"]: r.asDict() for r in admitted_metrics(logs, options, rules).collect()}
    if path_exists(spark, f"{folder}/logs"):
        purge_log_table(spark, f"{folder}/logs", datetime.now(timezone.utc).date(), options.retention_days)
    return {
        "entries_processed": sum(r["entries"] for r in sources.values()),
        "threats": reports.level_stats(table.read()).first().asDict(),
        "threats_exported": written,
        "sources": sources,
    }


def run_incremental(
    spark: SparkSession,
    folder: str,
    block_list: str,
    options: Options = Options(),
    rules: Rulebook | None = None,
    late_seconds: int | None = None,
    from_end: bool = False,
    **trigger,
) -> dict:
    """Scan what the log files have grown by since the last run; returns counts.

    Lines, state and threats move together: a run over unchanged files changes nothing, and a
    run that was cut off is finished by the next one.  With ``processingTime`` as trigger the
    query goes on and is returned as ``query`` instead.
    """
    use_utc(spark)
    live = LiveScan(spark, f"{folder}/live", allow_from_options(spark, options), options, rules, block_list, late_seconds)
    before = live.counts()
    query = live.start(stream_logs(spark, options, from_end=from_end), f"{folder}/checkpoint", **trigger)
    if trigger and not trigger.get("availableNow"):
        return {"query": query, "live": live}
    query.awaitTermination()
    counts = {name: n - before.get(name, 0) for name, n in live.counts().items()}
    return counts | {"threats": reports.level_stats(live.threats.read()).first().asDict()}


def publish(table: Snapshots, block_list: str, options: Options, append: bool, min_level: str | None = None) -> int:
    """Write threats to the block list and mark the ones written as exported.

    Appending takes what is not exported yet; overwriting takes everything from a
    level on.
    """
    current = table.read()
    chosen = current.where(~F.col("exported")) if append else reports.at_or_above(current, min_level or "LOW")
    written = export.export_block_list(
        chosen, block_list, options.output_format, append=append, deduplicate=options.deduplicate
    )
    table.update(lambda stored: mark_if_unchanged(stored, current, chosen), "exported")
    return written


def mark_if_unchanged(stored: DataFrame, seen: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mark what was written, but for rows that another writer has changed since they were read."""
    same = seen.select("ip", "updated_at").join(chosen.select("ip"), "ip", "left_semi")
    return store.mark_exported(stored, stored.join(same, ["ip", "updated_at"], "left_semi"))


def purge(table: Snapshots, block_list: str, options: Options) -> None:
    """Drop threats past their retention, after a backup of all addresses."""
    if options.threat_retention_days <= 0:
        return
    now = F.current_timestamp()
    current = table.read()
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    folder = block_list.rstrip("/").rpartition("/")[0] or "."
    gone = store.expired(current, now, options.threat_retention_days)
    if export.backup_before_purge(current, gone, folder, stamp):
        table.update(lambda stored: store.purge_threats(stored, now, options.threat_retention_days), "purged")
