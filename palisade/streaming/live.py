"""Continuous detection whose answer does not depend on how records arrive.

The state holds what detectors need in a form that adds up: rows counted per (address,
instant), sensitive records per address, findings of the row checks.  A micro-batch adds its
own to the buckets of the addresses it holds, and everything derived from them (rate
findings, threats) is derived again for these buckets, so a late record corrects earlier
findings and adds nothing twice.  After any number of batches, in any order, from any number
of queries, the threats are those of one batch over all records.

Bounds: with ``late_seconds`` set, a record older than that (against the newest seen before
its batch) is counted and not taken.  What no later record can change is settled: rate
findings keep their sums, instants go once no window reaches them, and buckets that nobody
touches are settled when their time comes.  Without it all instants are kept, and records
may be late without limit.

Exactly once: every commit claims the next version of the whole state, with the batch noted
in its ledger under the query that brought it.  A query that loses a claim adds its batch to
what the winner left.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.operators import detectors as D
from palisade.operators import windows as W
from palisade.operators.allow import admit
from palisade.operators.rulebook import Rulebook, searchable
from palisade.operators.scoring import findings, merge_findings, threats
from palisade.options import Options
from palisade.plans import export
from palisade.plans.store import COLUMNS, mark_exported
from palisade.session import hadoop_path, once
from palisade.streaming.state import TABLES, BucketTable, LiveState

REQUEST, ERROR = "request", "error"


class LiveScan:
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        allow: DataFrame | Callable[[], DataFrame],
        options: Options = Options(),
        rules: Rulebook | None = None,
        block_list: str | None = None,
        late_seconds: int | None = None,
        buckets: int = 64,
    ):
        self.spark, self.options, self.rules = spark, options, rules or Rulebook()
        self.allow, self.block_list, self.late_seconds = allow, block_list, late_seconds
        self.state = LiveState(spark, folder, buckets)
        self.threats = BucketTable(self.state, "threats")
        self.kinds = {
            REQUEST: (options.frequency_window, options.max_requests, D.FREQUENCY, D.FREQUENCY, options.scores.frequency_violation),
            ERROR: (options.error_window, options.max_errors, D.STATUS, "error_flood", options.scores.error_flood),
        }

    # --- one micro-batch ---------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int, query: str = "direct") -> None:
        """Add one micro-batch of records; a batch that is in the state already changes nothing."""
        allow = self.allow() if callable(self.allow) else self.allow
        slim = self._slim(admit(batch, allow)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            while True:
                number, now = self.state.newest()
                if self.state.done(now, query, batch_id):
                    break
                content, touched, taken, final = self._advance(slim, now)
                content["ledger"] = now["ledger"] | {query: [batch_id, time.time()]}
                root = self.state.folder_for_write()
                written = self._tables(root, taken, now, touched, final) if touched else {}
                if self.state.commit(number, content, written, touched):
                    self.state.trim()
                    break
                self.state.drop(root)  # another query was first: add to what it left
        finally:
            slim.unpersist()
        self.publish()

    def reset(self) -> None:
        """Start the counters anew, as between two scans."""
        self.state.reset()

    def counts(self) -> dict[str, int]:
        """What was taken in so far: entries and late rows, and per detector the records found."""
        return self.state.newest()[1]["counts"]

    def _slim(self, rows: DataFrame) -> DataFrame:
        """One pass over the records: findings, and whether a record is sensitive or an error."""
        checks = [c for c in D.ROW_CHECKS]
        judged = once(searchable(rows), {
            "found": D.checks_array(self.rules, self.options, checks), "sensitive": F.coalesce(self.rules.matches("sensitive_path"), F.lit(False)),
        })
        wrong = F.coalesce(D.suspicious_status(F.col("status")), F.lit(False)).alias("wrong")
        return judged.select("ip", "seq", "timestamp", "status", "found", "sensitive", wrong, self.state.bucket().alias("bucket"))

    def _advance(self, slim: DataFrame, now: dict) -> tuple[dict, set[int], DataFrame, int | None]:
        """The next version's content, the buckets it touches, the rows taken, and up to when all is final."""
        seen, late = now["newest"], 0
        micros = F.unix_micros("timestamp")
        if self.late_seconds is not None and seen is not None:
            in_time = micros > F.lit(seen - self.late_seconds * W.MICROS)
            late = slim.where(~in_time).count()
            slim = slim.where(in_time)
        per = slim.groupBy("bucket").agg(
            F.count("*").alias("n"), F.max(micros).alias("t"), F.sum(F.size("found")).alias("found"),
            F.count_if("sensitive").alias("sensitive"), F.count_if("wrong").alias("wrong"),
        ).collect()
        newest = max([r["t"] for r in per if r["t"] is not None] + ([seen] if seen is not None else []), default=None)
        final = None if self.late_seconds is None or newest is None else newest - self.late_seconds * W.MICROS
        stamps = dict(now["stamps"])
        for r in per:
            stamps[str(r["bucket"])] = max(r["t"] or 0, stamps.get(str(r["bucket"]), 0))
        widest = max(window for window, *_ in self.kinds.values()) * W.MICROS
        gone = {b for b, t in stamps.items() if final is not None and t <= final - widest}
        touched = {r["bucket"] for r in per} | {int(b) for b in gone}
        counts = dict(now["counts"])
        for name, n in {
            "entries": sum(r["n"] for r in per), "late_rows": late, "row_findings": sum(r["found"] or 0 for r in per),
            "sensitive": sum(r["sensitive"] for r in per), "errors": sum(r["wrong"] for r in per),
        }.items():
            counts[name] = counts.get(name, 0) + n
        content = now | {"newest": newest, "stamps": {b: t for b, t in stamps.items() if b not in gone}, "counts": counts}
        return content, touched, slim, final

    def _tables(self, root: str, slim: DataFrame, now: dict, touched: set[int], final: int | None) -> dict[str, dict[str, str]]:
        """Write the touched buckets of all tables; each step reads what the one before has written."""
        old = {name: self.state.read(now, name, sorted(touched)) for name in TABLES}
        written: dict[str, dict[str, str]] = {}

        def write(name: str, rows: DataFrame, folder: str | None = None) -> DataFrame:
            written[name] = self.state.write(root, folder or name, rows, touched)
            return self.state.read({"tables": written}, name)

        most = max(limit for _, limit, *_ in self.kinds.values()) + 1
        rows = slim.select("ip", "seq", "timestamp", "status", F.explode(F.when(F.col("wrong"), F.array(F.lit(REQUEST), F.lit(ERROR))).otherwise(F.array(F.lit(REQUEST)))).alias("kind"))
        by = ["kind", "ip", "t"]
        merged = write("instants", W.merge_instants(old["instants"], W.counted_instants(rows, most, by), most, by), "merged")
        rates, derived, kept = [], [], []
        for kind, (window, _, analyzer, code, score) in self.kinds.items():
            own = merged.where(F.col("kind") == kind)
            total, settled = self._rate(kind, own, old["rates"].where(F.col("kind") == kind), final)
            derived.append(D.window_hits(total, analyzer, code, score))
            rates.append(settled)
            if final is not None:
                kept.append(own.where(F.col("t") > final - window * W.MICROS))
        sensitive = write("sensitive", self._sensitive(slim, old["sensitive"]))
        derived.append(self._sensitive_hits(sensitive))

        era = now["era"]
        current, earlier = old["findings"].where(F.col("era") == era), old["findings"].where(F.col("era") < era)
        is_derived = (F.col("analyzer") != D.PATTERN) | (F.col("rank") == D.RANK["sensitive_path"])
        by_row = merge_findings(current.where(~is_derived).drop("era"), findings(D.found_hits(slim)))
        again = findings(reduce(DataFrame.unionByName, derived))
        found = write("findings", by_row.unionByName(again).withColumn("era", F.lit(era)).unionByName(earlier))
        write("threats", self._threats(threats(found.drop("era"), self.options), old["threats"]))
        if final is not None:
            write("rates", reduce(DataFrame.unionByName, rates))
            write("instants", reduce(DataFrame.unionByName, kept))
            self.state.drop(f"{root}/merged")
        return written

    def _rate(self, kind: str, instants: DataFrame, settled: DataFrame, final: int | None) -> tuple[DataFrame, DataFrame]:
        """Rate findings of all addresses (one row each), and what of them is settled at ``final``."""
        window, limit, analyzer, _, _ = self.kinds[kind]
        over = W.over_limit(W.trailing_counts(instants.select("ip", "t", "n"), window), limit)
        open_ = over.join(settled.select("ip", "until"), "ip", "left").where(F.col("until").isNull() | (F.col("t") > F.col("until")))
        crossed = W.crossings(open_)
        fresh = crossed.join(settled, "ip", "left_anti")
        rows = instants.select("ip", "t", F.explode("rows").alias("r"))
        rows = rows.select("ip", F.col("r.seq").alias("seq"), F.timestamp_micros("t").alias("timestamp"), F.col("r.status").alias("status"))
        inside = W.crossing_window(rows, fresh, window, limit)
        if analyzer == D.FREQUENCY:
            named = inside.where(F.col("_rn") == limit + 1).withColumn("reason", D.frequency_reason(window, limit))
        else:
            named = W.top_statuses(inside, D.TOP_STATUSES).withColumn("reason", D.error_reason(limit))
        named = named.select("ip", "seq", "timestamp", "reason")

        def added(part: DataFrame) -> DataFrame:
            s, p = settled.drop("kind").alias("s"), part.alias("p")
            both = s.join(p, F.col("s.ip") == F.col("p.ip"), "full_outer").join(named.alias("n"), F.col("n.ip") == F.col("p.ip"), "left")
            pick = lambda c: F.coalesce(f"s.{c}", f"n.{c}").alias(c)
            zero = F.lit(0).cast("bigint")
            return both.select(
                F.coalesce("s.ip", "p.ip").alias("ip"), (F.coalesce("s.hits", zero) + F.coalesce("p.hits", zero)).alias("hits"),
                F.coalesce("s.t_cross", "p.t_cross").alias("t_cross"), pick("seq"), pick("timestamp"), pick("reason"),
                F.greatest("s.t_last", "p.t_last").alias("t_last"),
            )

        if final is None:
            return added(crossed), settled
        kept = added(W.crossings(open_.where(F.col("t") <= final))).withColumns({"kind": F.lit(kind), "until": F.lit(final)})
        return added(crossed), kept.select(*settled.columns)

    def _sensitive(self, slim: DataFrame, old: DataFrame) -> DataFrame:
        """Sensitive records per address: number, newest, and the first ones."""
        need = self.options.max_sensitive_hits
        rows = slim.where("sensitive").select("ip", "seq", "timestamp")
        first = W.first_rows(rows, ["ip"], [F.col("timestamp"), F.col("seq")], need)
        first = first.groupBy("ip").agg(F.collect_list(F.struct("timestamp", "seq")).alias("rows"))
        new = rows.groupBy("ip").agg(F.count("*").alias("n"), F.max("timestamp").alias("last")).join(first, "ip")
        return old.unionByName(new).groupBy("ip").agg(
            F.sum("n").alias("n"), F.max("last").alias("last"), F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, need).alias("rows"),
        )

    def _sensitive_hits(self, rows: DataFrame) -> DataFrame:
        """From the n-th sensitive record of an address on, however late the earlier ones came."""
        need = self.options.max_sensitive_hits
        at = rows.where(F.col("n") >= need).withColumn("nth", F.element_at("rows", need)).select("ip", "nth.timestamp", "nth.seq", "n", "last")
        return D.sensitive_summary_rows(at, self.options, F.col("n") - (need - 1), F.col("last"))

    def _threats(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """Threat rows as they are now; a row that changed is not exported."""
        facts = ("score", "threat_level", "reasons", "hit_count", "first_seen", "last_seen")
        known = old.select("ip", "exported", "created_at", "updated_at", F.struct(*facts).alias("was"))
        both = new.join(known, "ip", "left")
        same = F.coalesce(F.struct(*facts).eqNullSafe(F.col("was")), F.lit(False))
        stamp = F.current_timestamp()
        return both.select(
            "ip", *facts, (same & F.coalesce("exported", F.lit(False))).alias("exported"),
            F.coalesce("created_at", stamp).alias("created_at"), F.when(same, F.col("updated_at")).otherwise(stamp).alias("updated_at"),
        ).select(*COLUMNS)

    def publish(self) -> int:
        """Append what is not exported yet to the block list, then mark it; returns the number of addresses."""
        if self.block_list is None:
            return 0
        waiting = self.threats.read().where(~F.col("exported")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if waiting.isEmpty():
                return 0
            written = export.export_block_list(
                waiting, self.block_list, self.options.output_format, append=True, deduplicate=self.options.deduplicate
            )
            touched = {r["b"] for r in waiting.select(self.state.bucket().alias("b")).distinct().collect()}
            while True:
                number, now = self.state.newest()
                stored = self.state.read(now, "threats", sorted(touched))
                # A row that changed meanwhile keeps waiting.
                same = stored.join(waiting.select("ip", "updated_at"), ["ip", "updated_at"], "left_semi")
                root = self.state.folder_for_write()
                found = self.state.write(root, "threats", mark_exported(stored, same).select(*COLUMNS), touched)
                if self.state.commit(number, now, {"threats": found}, touched):
                    self.state.trim()
                    return written
                self.state.drop(root)
        finally:
            waiting.unpersist()

    # --- the query ---------------------------------------------------------------

    def start(self, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of records: ``availableNow=True`` for one incremental scan,
        ``processingTime='10 seconds'`` for continuous work.  Any number of queries may share
        the state; each is known by the id that Spark keeps in its checkpoint."""
        known: list[str] = []

        def step(batch: DataFrame, batch_id: int) -> None:
            if not known:
                known.append(query_id(self.spark, checkpoint))
            self.process(batch, batch_id, known[0])

        writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint; another checkpoint is another query."""
    fs, path = hadoop_path(spark, f"{checkpoint.rstrip('/')}/metadata")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()
