"""Rules, windows and scoring against sequential models written from the rules."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalogue import inputs as I
from palisade.operators import detectors as D
from palisade.operators import windows as W
from palisade.operators.allow import admit
from palisade.operators.rulebook import CATEGORIES, Rulebook, any_of, minimal_literals, searchable
from palisade.operators.scoring import findings, threats
from palisade.options import Options
from palisade.plans.scan import facts, scan


def traffic(seed, n=400, step=3, whole=True):
    rng, now, rows = random.Random(seed), datetime(2025, 1, 1), []
    for seq in range(n):
        now += timedelta(seconds=rng.randint(0, step)) if whole else timedelta(microseconds=rng.randint(0, step * 10**6))
        ip = "9.9.9.9" if rng.random() < 0.4 else f"1.1.1.{rng.randint(0, 5)}"
        rows.append((seq, now, ip, rng.choice([200, 403, 500, 502, 404])))
    return rows


def model(rows, window, limit):
    """Row-by-row counts, and per address the first crossing, its statuses, hits and last time."""
    times, found, counts = defaultdict(list), {}, {}
    for seq, at, ip, status in rows:
        kept = [(t, s) for t, s in times[ip] if t > at - timedelta(seconds=window)] + [(at, status)]
        times[ip] = kept
        counts[seq] = len(kept)
        if len(kept) > limit:
            if ip not in found:
                tally = defaultdict(int)
                for _, s in kept:
                    tally[s] += 1
                top = sorted(tally.items(), key=lambda x: x[1], reverse=True)[:3]
                found[ip] = [seq, at, ",".join(f"{s}:{c}" for s, c in top), 0, at]
            found[ip][3] += 1
            found[ip][4] = at
    return counts, found


@pytest.mark.parametrize("whole", [True, False])
def test_windows_match_the_sequential_rule(spark, whole):
    rows = traffic(1, whole=whole)
    df = spark.createDataFrame(rows, "seq bigint, timestamp timestamp, ip string, status int").repartition(5)
    counts, found = model(rows, 60, 7)
    assert {r.seq: r.window_count for r in W.sliding_counts(df, 60).collect()} == counts
    options = Options(frequency_window=60, max_requests=7, error_window=60, max_errors=4)
    got = {r.ip: (r.seq, r.timestamp, r.hits, r.last_seen) for r in D.frequency_hits(df, options).collect()}
    assert got == {ip: (f[0], f[1], f[3], f[4]) for ip, f in found.items()}
    _, errors = model([r for r in rows if r[3] in D.SUSPICIOUS_STATUS], 60, 4)
    got = {r.ip: (r.seq, r.reason, r.hits) for r in D.error_flood_hits(df, options).collect()}
    assert got == {ip: (f[0], f"大量错误响应(5次,{f[2]})", f[3]) for ip, f in errors.items()}


def test_one_busy_address_is_spread(spark):
    """All rows of one address in few seconds: the window partitions stay small."""
    df = spark.range(20_000).select(
        F.lit("9.9.9.9").alias("ip"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") % 50 + 1_700_000_000).alias("timestamp"),
    )
    assert W.instants(df).count() == 50
    hit = D.frequency_hits(df, Options(frequency_window=10, max_requests=100)).first()
    assert (hit.hits, hit.seq) == (20_000 - 100, 100 * 50)


def test_rank_filters_run_before_the_shuffle(spark):
    df = spark.createDataFrame(traffic(2), "seq bigint, timestamp timestamp, ip string, status int")
    plan = W.nth_rows(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_factored_alternations_find_the_same(spark):
    rules = Rulebook()
    rng = random.Random(3)
    for c in CATEGORIES:
        if c.literal:
            continue
        patterns = [p for _, p in rules.numbered(c.code)]
        plain, short = re.compile("|".join(f"(?:{p})" for p in patterns), re.I), re.compile(any_of(patterns), re.I)
        parts = [re.sub(r"\\(.)", r"\1", p.replace(".*", "x").replace("\\s*", " ")) for p in patterns] + ["a", " ", "="]
        for _ in range(500):
            text = "".join(rng.choice(parts)[rng.randint(0, 1):] for _ in range(3))
            assert bool(plain.search(text)) == bool(short.search(text)), (c.code, text)
    assert minimal_literals([".git/x", ".GIT", "/a"]) == [".git", "/a"]


def test_spark_and_python_agree_on_rules(spark):
    rules, rng = Rulebook(), random.Random(4)
    texts = set()
    for c in CATEGORIES:
        for _, p in rules.numbered(c.code):
            base = re.sub(r"\\(.)", r"\1", p.replace("\\s*", " ").replace("\\s+", " ").replace(".*", "-"))
            texts |= {base, base.upper(), "x" + base + "\n", "é" + base}
    texts = sorted(texts)
    df = spark.createDataFrame([(i, "/p", t, t) for i, t in enumerate(texts)], "n int, path string, raw string, user_agent string")
    for c in CATEGORIES:
        if c.literal or not (c.on_raw or c.on_agent):
            continue
        python = re.compile("|".join(f"(?:{p})" for _, p in rules.numbered(c.code)), re.I)
        got = {r.n for r in searchable(df, [c.code]).where(rules.matches(c.code)).select("n").collect()}
        want = {i for i, t in enumerate(texts) if (t or not c.on_agent) and (python.search(t) or (c.on_path and python.search("/p")))}
        assert got == want, (c.code, [texts[i] for i in got ^ want][:5])


def test_custom_rules_and_scoring(spark):
    rules = Rulebook.from_dict({"sql_injection_patterns": ["union", "bad("], "sensitive_paths": ["/x", "/X/y"], "malicious_ua_patterns": ["zz", "z"]})
    at = datetime(2025, 1, 1)
    rows = [(i, at + timedelta(seconds=i), "1.1.1.1", "nginx", p, "raw", "z", {"a": "b"}) for i, p in enumerate(["/x", "/q", "/xUNION", "/x"])]
    logs = spark.createDataFrame(
        rows, "seq bigint, timestamp timestamp, ip string, source string, path string, raw string, user_agent string, extra map<string,string>"
    ).withColumn("status", F.lit(200))
    options = Options(max_sensitive_hits=2)
    hits = D.pattern_hits(logs, rules, options).unionByName(D.sensitive_path_summary(logs, rules, options))
    row = threats(findings(hits), options).first()
    assert row.reasons == ["恶意UA(z)", "敏感路径扫描", "SQL注入特征"]
    assert (row.score, row.threat_level, row.hit_count) == (13, "CRITICAL", 4 + 1 + 2)
    by_row = D.sensitive_path_hits(logs, rules, options)
    assert [r.seq for r in by_row.orderBy("seq").collect()] == [2, 3]


def test_a_scan_reads_the_records_once(spark, tmp_path):
    """The detectors' plan reads the staged facts; the records' own file is in no plan after staging."""
    logs = I.logs(spark, "/root/testdata/sf0.001").limit(300)
    logs.write.parquet(str(tmp_path / "logs"))
    stored = spark.read.schema(logs.schema).parquet(str(tmp_path / "logs"))
    plan = scan(stored, I.allow_list(spark), I.OPTIONS, I.RULES)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "palisade-facts" in plan
    facts_plan = facts(admit(stored, I.allow_list(spark)), I.OPTIONS, I.RULES)._jdf.queryExecution().executedPlan().toString()
    assert facts_plan.count("FileScan parquet") == 1


def test_first_rows_beyond_the_limit_of_trimming(spark):
    """At a limit of 5,000 each task passes on at most 5,000 rows of a part of an address."""
    rows = spark.range(20_000).select(F.lit("a").alias("ip"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") % 7000).alias("timestamp"))
    found = W.first_rows(rows, ["ip"], [F.col("timestamp"), F.col("seq")], 5000, "rn")
    got = [(r.timestamp, r.seq) for r in found.orderBy("rn").collect()]
    want = sorted((r.timestamp, r.seq) for r in rows.collect())[:5000]
    assert got == want
    assert found._jdf.queryExecution().executedPlan().toString().count("Window [") >= 2
    assert [(r.timestamp, r.seq) for r in W.nth_rows(rows, 4000).collect()] == [want[3999]]
