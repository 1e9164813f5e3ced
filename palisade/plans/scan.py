"""The scan: records to one threat row per address."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.allow import admit
from palisade.operators.detectors import (
    Detector,
    checks_array,
    error_flood_hits,
    error_hits,
    found_hits,
    frequency_hits,
    pattern_hits,
    rate_hits,
    sensitive_path_summary,
    sensitive_summary,
    suspicious_status,
)
from palisade.operators.rulebook import Rulebook, searchable
from palisade.operators.scoring import findings, threats
from palisade.options import Options
from palisade.session import once, shared_dir


def default_detectors(options: Options = Options(), rules: Rulebook | None = None) -> list[Detector]:
    rules = rules or Rulebook()
    return [
        lambda logs: frequency_hits(logs, options),
        lambda logs: pattern_hits(logs, rules, options),
        lambda logs: sensitive_path_summary(logs, rules, options),
        lambda logs: error_flood_hits(logs, options),
    ]


def facts(admitted: DataFrame, options: Options = Options(), rules: Rulebook | None = None) -> DataFrame:
    """What the detectors need of each record, from one pass over the records.

    ``ip, seq, timestamp``, the status where it counts as an error, the row checks that
    apply (``found``) and whether the path is sensitive.
    """
    rules = rules or Rulebook()
    judged = once(searchable(admitted), {
        "found": checks_array(rules, options), "sensitive": F.coalesce(rules.matches("sensitive_path"), F.lit(False)),
    })
    error = F.when(suspicious_status(F.col("status")), F.col("status")).alias("error")
    return judged.select("ip", "seq", "timestamp", error, "found", "sensitive")


def stage_facts(admitted: DataFrame, options: Options = Options(), rules: Rulebook | None = None) -> DataFrame:
    """The facts as a table in the shared folder.

    Records are read, judged and held against the allow list once; every detector then reads a
    few narrow columns.  A lost executor costs a task, as nothing is kept in memory.
    """
    spark = admitted.sparkSession
    table = facts(admitted, options, rules)
    folder = f"{shared_dir(spark).rstrip('/')}/palisade-facts/{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return spark.read.schema(table.schema).parquet(folder)


def facts_findings(staged: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of the default detectors over facts."""
    slim = staged.select("ip", "seq", "timestamp")
    errors = staged.where("error is not null").select("ip", "seq", "timestamp", F.col("error").alias("status"))
    hits = [
        rate_hits(slim, options), found_hits(staged.where(F.size("found") > 0)),
        sensitive_summary(staged.where("sensitive").select("ip", "seq", "timestamp"), options), error_hits(errors, options),
    ]
    return findings(reduce(DataFrame.unionByName, hits))


def scan_findings(
    admitted: DataFrame,
    options: Options = Options(),
    rules: Rulebook | None = None,
    detectors: Iterable[Detector] | None = None,
) -> DataFrame:
    """Findings over admitted records: of the default detectors from staged facts, or of the given ones."""
    if detectors is None:
        return facts_findings(stage_facts(admitted, options, rules), options)
    return findings(reduce(DataFrame.unionByName, [admitted.transform(d) for d in detectors]))


def scan(
    logs: DataFrame,
    allow: DataFrame,
    options: Options = Options(),
    rules: Rulebook | None = None,
    detectors: Iterable[Detector] | None = None,
) -> DataFrame:
    """Threats found in ``logs``: allow list, detectors, scores and levels.

    With the default detectors the records are read once (``stage_facts``).
    """
    return threats(scan_findings(admit(logs, allow), options, rules, detectors), options)


def detector_metrics(found: DataFrame) -> DataFrame:
    """Events, addresses and time span of every detector, from the findings of a scan."""
    return found.groupBy("analyzer").agg(
        F.sum("hits").alias("events"), F.countDistinct("ip").alias("addresses"), F.countDistinct("reason").alias("reasons"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def admitted_metrics(
    admitted: DataFrame, options: Options = Options(), rules: Rulebook | None = None
) -> DataFrame:
    """Admitted entries per source and how many of them a row-level check hit."""
    found = checks_array(rules or Rulebook(), options)
    return searchable(admitted).groupBy("source").agg(
        F.count("*").alias("entries"), F.count_if(F.size(found) > 0).alias("hit_entries")
    )


def source_metrics(
    logs: DataFrame, allow: DataFrame, options: Options = Options(), rules: Rulebook | None = None
) -> DataFrame:
    return admitted_metrics(admit(logs, allow), options, rules)
