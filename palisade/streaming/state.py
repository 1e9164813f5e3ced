"""State of a live scan: tables in buckets of addresses, versions of all of them at once.

A version names one folder per table and bucket, the ledger of batches that are in it, and
the newest time seen.  A commit writes only the buckets that a batch touches; all others
keep their files.  The ledger is part of the version, so a batch is in the state exactly
once, whichever query brings it and however often.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.store import SCHEMA as THREATS
from palisade.plans.versions import VersionLog
from palisade.session import hadoop_path

# ``rows`` are the first rows of an instant by seq, as many as a limit can ask for.
TABLES = {
    "instants": "kind string, ip string, t bigint, n bigint, rows array<struct<seq:bigint,status:int>>",
    "rates": "kind string, ip string, hits bigint, t_cross bigint, seq bigint, timestamp timestamp, reason string, t_last bigint, until bigint",
    "sensitive": "ip string, n bigint, last timestamp, rows array<struct<timestamp:timestamp,seq:bigint>>",
    "findings": "ip string, analyzer string, reason string, rank int, score int, hits bigint, "
    "first_seen timestamp, first_seq bigint, last_seen timestamp, era int",
    "threats": THREATS,
}
# What a reset forgets: findings and threats stay.
TRANSIENT = ("instants", "rates", "sensitive")
LEDGER_QUERIES = 1000


class BucketTable:
    """Reads one table of the newest version."""

    def __init__(self, state: "LiveState", name: str):
        self.state, self.name = state, name

    def read(self) -> DataFrame:
        return self.state.read(self.state.newest()[1], self.name)


class LiveState:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keep: int = 3):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.log = VersionLog(spark, self.folder, keep)

    def bucket(self, ip: str = "ip") -> Column:
        return F.pmod(F.xxhash64(ip), F.lit(self.buckets)).cast("int")

    def newest(self) -> tuple[int, dict]:
        number, content = self.log.newest()
        return number, content or {"tables": {}, "ledger": {}, "stamps": {}, "newest": None, "era": 0, "counts": {}}

    def read(self, content: dict, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some buckets of it."""
        paths = content["tables"].get(name, {})
        wanted = list(paths.values()) if buckets is None else [paths[str(b)] for b in buckets if str(b) in paths]
        if not wanted:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*wanted)

    def folder_for_write(self) -> str:
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def write(self, root: str, name: str, rows: DataFrame, touched: set[int]) -> dict[str, str]:
        """Write the touched buckets of a table; the folder of each (missing: empty)."""
        # One file per bucket, unless a bucket is larger than a file should be.
        placed = rows.withColumn("bucket", self.bucket()).repartition(max(1, min(len(touched), self.buckets)), "bucket")
        placed.write.partitionBy("bucket").option("maxRecordsPerFile", 5_000_000).parquet(f"{root}/{name}")
        fs, _ = hadoop_path(self.spark, root)
        parts = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/bucket=*")) or ()
        return {p.getPath().getName().split("=")[1]: p.getPath().toString() for p in parts}

    def commit(self, number: int, content: dict, written: dict[str, dict[str, str]], touched: set[int]) -> bool:
        """Claim version ``number + 1``: ``content`` with the touched buckets replaced."""
        tables = {name: dict(paths) for name, paths in content["tables"].items()}
        for name, paths in written.items():
            kept = {b: p for b, p in tables.get(name, {}).items() if int(b) not in touched}
            tables[name] = kept | paths
        ledger = dict(sorted(content["ledger"].items(), key=lambda kv: kv[1][1])[-LEDGER_QUERIES:])
        return self.log.claim(number + 1, content | {"tables": tables, "ledger": ledger})

    def trim(self) -> None:
        self.log.trim(lambda c: [p for paths in c["tables"].values() for p in paths.values()])

    def drop(self, folder: str) -> None:
        fs, path = hadoop_path(self.spark, folder)
        fs.delete(path, True)

    def done(self, content: dict, query: str, batch: int) -> bool:
        """Whether a batch of a query is in this version; a query's batches come in order."""
        return content["ledger"].get(query, [-1])[0] >= batch

    def reset(self) -> None:
        """Forget rates and counters, as between two scans; findings stay, and new ones score anew."""
        while True:
            number, now = self.newest()
            tables = {n: p for n, p in now["tables"].items() if n not in TRANSIENT}
            if self.log.claim(number + 1, now | {"tables": tables, "stamps": {}, "era": now["era"] + 1}):
                return self.trim()
