"""The threat table: merge, purge, delete, export marks, and its snapshots on disk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.scoring import threat_level
from palisade.options import Options
from palisade.plans.versions import VersionLog
from palisade.session import hadoop_path

COLUMNS = (
    "ip", "score", "threat_level", "reasons", "hit_count", "first_seen", "last_seen",
    "exported", "created_at", "updated_at",
)
SCHEMA = (
    "ip string, score int, threat_level string, reasons array<string>, hit_count bigint, "
    "first_seen timestamp, last_seen timestamp, exported boolean, created_at timestamp, updated_at timestamp"
)


def new_records(threats: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Scan results as rows of the stored table."""
    now = F.current_timestamp() if as_of is None else as_of
    return threats.withColumns({"exported": F.lit(False), "created_at": now, "updated_at": now}).select(*COLUMNS)


def merge_threats(
    stored: DataFrame, new: DataFrame, options: Options = Options(), as_of: Column | None = None
) -> DataFrame:
    """Upsert scan results: scores and hits add up, reasons unite in stored order.

    Both sides have one row per address, so the full outer join cannot be skewed.
    A touched row is graded again and counts as not exported.
    """
    now = F.current_timestamp() if as_of is None else as_of
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.ip") == F.col("n.ip"), "full_outer")
    touched = F.col("n.ip").isNotNull()
    none = F.array().cast("array<string>")
    score = (F.coalesce("s.score", F.lit(0)) + F.coalesce("n.score", F.lit(0))).cast("int")
    return both.select(
        F.coalesce("s.ip", "n.ip").alias("ip"),
        score.alias("score"),
        F.when(touched, threat_level(score, options)).otherwise(F.col("s.threat_level")).alias("threat_level"),
        F.array_union(F.coalesce("s.reasons", none), F.coalesce("n.reasons", none)).alias("reasons"),
        (F.coalesce("s.hit_count", F.lit(0)) + F.coalesce("n.hit_count", F.lit(0))).cast("bigint").alias("hit_count"),
        F.least("s.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("s.last_seen", "n.last_seen").alias("last_seen"),
        (~touched & F.coalesce("s.exported", F.lit(False))).alias("exported"),
        F.coalesce("s.created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def expired(threats: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Threats not seen for ``days`` days; none when ``days`` is 0."""
    if days <= 0:
        return threats.where(F.lit(False))
    return threats.where(F.col("last_seen") < as_of - F.expr(f"interval {days} days"))


def purge_threats(threats: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Threats without the expired ones; 0 days keeps all."""
    if days <= 0:
        return threats
    return threats.where(~(F.col("last_seen") < as_of - F.expr(f"interval {days} days")) | F.col("last_seen").isNull())


def purge_logs(logs: DataFrame, as_of: Column, days: int, created: str = "created_at") -> DataFrame:
    """Stored records without those written more than ``days`` days ago."""
    return logs.where(~(F.col(created) < as_of - F.expr(f"interval {days} days")))


def lookup(threats: DataFrame, ip: str) -> DataFrame:
    return threats.where(F.col("ip") == ip)


def delete_threats(threats: DataFrame, keys: DataFrame) -> DataFrame:
    return threats.join(keys.select("ip").distinct(), "ip", "left_anti")


def mark_exported(threats: DataFrame, written: DataFrame) -> DataFrame:
    """Set the mark on the addresses that were written; others keep theirs."""
    keys = written.select("ip").distinct().withColumn("_written", F.lit(True))
    return (
        threats.join(keys, "ip", "left")
        .withColumn("exported", F.col("exported") | F.coalesce("_written", F.lit(False)))
        .drop("_written")
    )


class Snapshots:
    """A small table kept as whole snapshots; the newest version names the current one.

    A snapshot counts only once its version is claimed (``VersionLog``), so a lost executor
    or driver leaves the previous one in force, and of two writers that started from the
    same version the second merges again.  ``tag`` names a write (a micro-batch, a step).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = SCHEMA, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self.log = VersionLog(spark, self.path, keep)

    def tags(self) -> set[str]:
        return {content["tag"] for _, content in self.log.all()}

    def _frame(self, content: dict) -> DataFrame:
        if not content:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(content["path"])

    def read(self, before_tag: str | None = None) -> DataFrame:
        """The current snapshot, or the newest one not written under a tag (or ``tag.step``)."""
        kept = [c for _, c in self.log.all() if before_tag is None or c["tag"].split(".")[0] != before_tag]
        return self._frame(kept[-1] if kept else {})

    def update(self, change: Callable[[DataFrame], DataFrame], tag: str = "scan") -> str:
        """Replace the table by ``change`` of it; again on the newer one, if another writer was first."""
        while True:
            number, content = self.log.newest()
            target = f"{self.path}/data-{uuid.uuid4().hex}"
            change(self._frame(content)).write.parquet(target)
            if self.log.claim(number + 1, {"tag": tag, "path": target}):
                self.log.trim(lambda c: [c["path"]])
                return target
            fs, path = hadoop_path(self.spark, target)
            fs.delete(path, True)

    def write(self, table: DataFrame, tag: str = "scan") -> str:
        """Replace the table whatever it is by now."""
        return self.update(lambda _: table, tag)
