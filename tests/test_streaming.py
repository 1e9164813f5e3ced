"""Micro-batches must give the batch answer."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalogue import inputs as I
from palisade.plans.scan import scan
from palisade.options import Options, SourceOptions
from palisade.plans.job import run_incremental
from palisade.sources.growing import GrowingText, pieces, piece_lines
from palisade.sources.lines import stream_logs
from palisade.sources.parsers import ParseContext
from palisade.streaming.live import LiveScan

SF = "/root/testdata/sf0.001"
FIELDS = ("ip", "score", "threat_level", "reasons", "hit_count", "first_seen", "last_seen")


def rows(df):
    return sorted(tuple(str(r[f]) for f in FIELDS) for r in df.select(*FIELDS).collect())


@pytest.mark.parametrize("cuts", [3])
def test_micro_batches_equal_one_batch(spark, tmp_path, cuts):
    logs = I.logs(spark, SF).cache()
    allow = I.allow_list(spark)
    live = LiveScan(spark, str(tmp_path / "state"), allow, I.OPTIONS, I.RULES, block_list=str(tmp_path / "block"))
    start = datetime(2024, 1, 1)
    edges = [start + timedelta(days=30 * i / cuts) for i in range(cuts)] + [datetime(2025, 1, 1)]
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = logs.where((F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi)))
        live.process(part, n)
        if n == 1:
            live.process(part, n)  # a repeated batch changes nothing
    expected = scan(logs, allow, I.OPTIONS, I.RULES)
    assert rows(live.threats.read()) == rows(expected)
    listed = [r.value.split(" | ")[0] for r in spark.read.text(str(tmp_path / "block")).collect() if not r.value.startswith("#")]
    assert sorted(listed) == sorted(r.ip for r in expected.select("ip").collect())


def test_growing_file_is_read_once(spark, tmp_path):
    spark.dataSource.register(GrowingText)
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\nhalf")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.format("growing_text").option("paths", str(tmp_path / "*.log")).load()
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(r.value for r in spark.read.parquet(out).collect())

    assert run() == ["one", "two"]
    with log.open("a") as handle:
        handle.write(" line\nthree\n")
    assert run() == ["half line", "one", "three", "two"]
    log.write_text("new\n")  # truncated
    assert run() == ["half line", "new", "one", "three", "two"]


def test_pieces_cover_every_line_once(tmp_path):
    log = tmp_path / "b.log"
    lines = [f"line {i} " + "x" * (i % 13) for i in range(200)]
    log.write_text("\n".join(lines) + "\nno end")
    end = {str(log): [os.stat(log).st_ino, os.path.getsize(log)]}
    for size in (7, 64, 100000):
        got = [line for p in pieces({}, end, size) for batch in piece_lines(p) for line in batch.column("value").to_pylist()]
        assert got == lines
    assert pieces(end, end) == []
    assert [p.start for p in pieces(end, {str(log): [2, 10]})] == [0]
    seqs = [x for p in pieces({}, end, 64) for batch in piece_lines(p) for x in batch.column("seq").to_pylist()]
    assert seqs == sorted(set(seqs))
    log.unlink()  # gone between listing and reading
    assert [list(piece_lines(p)) for p in pieces({}, end, 100000)] == [[]]


def nginx(ip, second, path="/ok"):
    return f'{ip} - - [09/Dec/2025:10:00:{second:02d} +0000] "GET {path} HTTP/1.1" 200 1 "-" "curl"\n'


def test_files_of_two_sources_become_a_stream_of_records(spark, tmp_path):
    """Appended, rotated, truncated and vanished files; bytes that are no text; a start at the end."""
    web, ssh = tmp_path / "web.log", tmp_path / "ssh.log"
    options = Options(sources={"nginx": SourceOptions((f"{tmp_path}/web*.log",), ("*.old.log",)), "ssh": SourceOptions((str(ssh),))})
    ctx, seqs = ParseContext.at("2025-12-10 00:00:00"), []

    def run(name, from_end=False):
        out = str(tmp_path / f"out-{name}")
        stream = stream_logs(spark, options, ctx, from_end)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        found = spark.read.schema(stream.schema).parquet(out).orderBy("seq").collect() if os.path.exists(out) else []
        if name == "a":
            seqs.append([r.seq for r in found])
        return sorted((r.source, r.ip) for r in found)

    web.write_text(nginx("1.1.1.1", 0) + "noise\n" + nginx("1.1.1.2", 1).strip())
    (tmp_path / "web.old.log").write_text(nginx("9.9.9.9", 0))
    ssh.write_text("Dec  9 10:00:00 h sshd[1]: Failed password for root from 2.2.2.2 port 1 ssh2\n")
    assert run("a") == [("nginx", "1.1.1.1"), ("ssh", "2.2.2.2")]
    assert run("end", from_end=True) == []
    with web.open("ab") as handle:
        handle.write(b"\n" + nginx("1.1.1.3", 2, "/\xff").encode("latin-1"))
    first = [("nginx", "1.1.1.1"), ("nginx", "1.1.1.2"), ("nginx", "1.1.1.3"), ("ssh", "2.2.2.2")]
    assert run("a") == first
    assert run("end", from_end=True) == [("nginx", "1.1.1.2"), ("nginx", "1.1.1.3")]
    web.rename(tmp_path / "web.old.log")  # rotated: a new file under the old name
    web.write_text(nginx("1.1.1.4", 3) * 40)
    ssh.unlink()
    after = sorted(first + [("nginx", "1.1.1.4")] * 40)
    assert run("a") == after and len(set(seqs[-1])) == len(after)
    web.write_text(nginx("1.1.1.5", 4))  # truncated in place
    assert run("a") == sorted(after + [("nginx", "1.1.1.5")])
    ssh.write_text("Dec  9 10:00:09 h sshd[1]: Failed password for root from 2.2.2.3 port 1 ssh2\n")
    assert run("a") == sorted(after + [("nginx", "1.1.1.5"), ("ssh", "2.2.2.3")])
    assert run("a") == sorted(after + [("nginx", "1.1.1.5"), ("ssh", "2.2.2.3")])


def test_a_second_run_over_unchanged_files_changes_nothing(spark, tmp_path):
    log = tmp_path / "a.log"
    options = Options(sources={"nginx": SourceOptions((f"{tmp_path}/*.log",))}, allow_entries=("66.249.64.0/24",), max_requests=3, frequency_window=60)
    folder, block = str(tmp_path / "work"), str(tmp_path / "block")
    log.write_text(nginx("5.5.5.5", 1, "/?q=union+select") + nginx("66.249.64.1", 1, "/?q=union+select") + nginx("6.6.6.6", 2) * 2 + "broken\n")
    one = run_incremental(spark, folder, block, options)
    assert (one["entries"], one["row_findings"], one["threats"]["total"]) == (3, 1, 1)
    again = run_incremental(spark, folder, block, options)
    assert again["entries"] == 0 and again["threats"] == one["threats"]
    with log.open("a") as handle:
        handle.write(nginx("6.6.6.6", 3) * 2)
    started = run_incremental(spark, folder, block, options, processingTime="1 second")  # goes on from there, by the clock
    try:
        for _ in range(240):
            if started["live"].counts().get("entries") == 5 and spark.read.text(block).where("value like '6.6.6.6%'").count():
                break
            time.sleep(0.5)
    finally:
        started["query"].stop()
    found = {r.ip: (r.score, r.hit_count, r.reasons) for r in started["live"].threats.read().collect()}
    assert found == {"5.5.5.5": (5, 1, ["SQL注入特征"]), "6.6.6.6": (3, 1, ["高频访问(4次/60秒)"])}


def in_parts(spark, logs, parts, key):
    return [logs.where(F.pmod(F.xxhash64(F.lit(key), "seq"), F.lit(parts)) == k) for k in range(parts)]


def test_late_rows_correct_what_was_found(spark, tmp_path):
    """Parts in any order give the answer of one batch, and earlier findings change instead of adding up."""
    logs, allow = I.logs(spark, SF).cache(), I.allow_list(spark)
    expected = rows(scan(logs, allow, I.OPTIONS, I.RULES))
    bounded = LiveScan(spark, str(tmp_path / "b"), allow, I.OPTIONS, I.RULES, late_seconds=40 * 86_400)
    for n, part in enumerate(in_parts(spark, logs, 2, 6)):
        bounded.process(part, n)
    assert rows(bounded.threats.read()) == expected and bounded.counts()["late_rows"] == 0
    bounded.process(logs.limit(0), 2)
    assert rows(bounded.threats.read()) == expected


def test_rows_later_than_allowed_are_counted_and_not_taken(spark, tmp_path):
    base = datetime(2024, 1, 1)
    fields = "seq bigint, timestamp timestamp, ip string, source string, method string, path string, status int, user_agent string, raw string, extra map<string,string>"
    options = Options(frequency_window=10, max_requests=3)

    def records(*seconds, ip="203.0.0.200"):
        return spark.createDataFrame([(i * 1000 + s, base + timedelta(seconds=s), ip, "nginx", "GET", "/", 200, "Mozilla", "", {}) for i, s in enumerate(seconds)], fields)

    live = LiveScan(spark, str(tmp_path / "s"), I.allow_list(spark), options, I.RULES, late_seconds=20, buckets=8)
    live.process(records(0, 1, 2), 0)
    live.process(records(100, 101), 1)  # settles the first three
    live.process(records(95, 99, 80, 3), 2)  # 95 and 99 are in time, 80 and 3 are not
    assert live.counts()["late_rows"] == 2
    (found,) = live.threats.read().collect()
    assert found.hit_count == 1 and found.first_seen == base + timedelta(seconds=101)
    live.process(records(200), 3)
    live.process(records(201, 202, 203, 204), 4)
    (found,) = live.threats.read().collect()
    assert (found.score, found.hit_count, found.last_seen) == (3, 3, base + timedelta(seconds=204))
    kept = {r.t for r in live.state.read(live.state.newest()[1], "instants").where("kind = 'request'").collect()}
    assert min(kept) > int((base - datetime(1970, 1, 1)).total_seconds() + 204 - 20 - 10) * 1_000_000 - 1


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    live = LiveScan(spark, str(tmp_path / "s"), I.allow_list(spark), I.OPTIONS, I.RULES, late_seconds=40 * 86_400, buckets=16)
    logs = I.logs(spark, SF)
    live.process(logs, 0)
    old = live.state.newest()[1]["tables"]
    one = logs.where("ip = '203.0.0.2'").withColumn("timestamp", F.lit(datetime(2024, 2, 1))).limit(1)
    live.process(one, 1)
    new = live.state.newest()[1]["tables"]
    changed = {b for name in new for b in old[name].keys() | new[name].keys() if old[name].get(b) != new[name].get(b)}
    assert 1 <= len(changed) < 16 and len(new["instants"]) >= len(old["instants"]) > 1
    # A year on every bucket's time has come: instants go, findings stay.
    live.process(one.withColumn("timestamp", F.lit(datetime(2025, 2, 1))), 2)
    last = live.state.newest()[1]["tables"]
    assert len(last["instants"]) == 1 and len(last["threats"]) == len(new["threats"])
    expected = {r.ip: r.score for r in scan(logs, I.allow_list(spark), I.OPTIONS, I.RULES).collect()}
    found = {r.ip: r.score for r in live.threats.read().collect()}
    assert {k: v for k, v in found.items() if k != "203.0.0.2"} == {k: v for k, v in expected.items() if k != "203.0.0.2"}


def test_two_writers_and_a_lost_claim(spark, tmp_path):
    """Two queries with batches of the same number, one of which loses its claim, equal one batch."""
    logs, allow = I.logs(spark, SF).cache(), I.allow_list(spark)
    left, right = in_parts(spark, logs, 2, 3)
    a = LiveScan(spark, str(tmp_path / "s"), allow, I.OPTIONS, I.RULES)
    b = LiveScan(spark, str(tmp_path / "s"), allow, I.OPTIONS, I.RULES)
    commit, lost = a.state.commit, []

    def late_commit(number, *rest):
        if not lost:
            lost.append(number)
            b.process(right, 0, "b")  # takes the number first
        return commit(number, *rest)

    a.state.commit = late_commit
    a.process(left, 0, "a")
    a.process(left, 0, "a")
    b.process(right, 0, "b")
    assert lost == [-1] and rows(a.threats.read()) == rows(scan(logs, allow, I.OPTIONS, I.RULES))
    assert set(a.state.newest()[1]["ledger"]) == {"a", "b"}


def test_a_reset_scores_anew(spark, tmp_path):
    logs, allow = I.logs(spark, SF).where("ip = '203.0.0.2'"), I.allow_list(spark)
    live = LiveScan(spark, str(tmp_path / "s"), allow, I.OPTIONS, I.RULES)
    live.process(logs, 0)
    (one,) = live.threats.read().collect()
    live.reset()
    live.process(logs, 1)
    (two,) = live.threats.read().collect()
    assert two.score == 2 * one.score and two.hit_count == 2 * one.hit_count and two.reasons == one.reasons
