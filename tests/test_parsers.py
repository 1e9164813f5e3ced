"""Line formats on hand-written lines."""

from datetime import datetime

from pyspark.sql import functions as F

from palisade.functions.times import parse_timestamp
from palisade.options import Options, SourceOptions
from palisade.sources.lines import read_lines, read_logs, read_log_table, wildcard_regex, write_logs
from palisade.sources.parsers import ParseContext, parse_lines

def ctx():
    return ParseContext.at("2025-12-10 00:00:00")



def parse(spark, source, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    return {r.n: r for r in parse_lines(df, source, ctx()).collect()}


def test_nginx(spark):
    ok = '1.2.3.4 - bob [09/Dec/2025:10:00:00 +0800] "GET /a?x=1 HTTP/1.1" 404 12 "http://r/" "curl/8"'
    mark = '1.2.3.4 - - [09/Dec/2025:10:00:00 +0800] "GET /\x01a HTTP/1.1" 200 - "-" "u\x01a"'
    odd = '1.2.3.4 - - [bad time] "-" 200 0 "-" ""'
    got = parse(spark, "nginx", ok, "no match", mark, odd, "")
    assert sorted(got) == [0, 2, 3]
    r = got[0]
    assert (r.timestamp, r.method, r.path, r.status, r.user_agent) == (datetime(2025, 12, 9, 2), "GET", "/a?x=1", 404, "curl/8")
    assert r.extra == {"referer": "http://r/", "bytes": "12", "user": "bob", "protocol": "HTTP/1.1"}
    assert (got[2].path, got[2].user_agent, got[2].extra["bytes"]) == ("/\x01a", "u\x01a", "-")
    assert (got[3].timestamp, got[3].path) == (datetime(2025, 12, 10), "")


def test_waf_object(spark):
    got = parse(
        spark, "waf",
        '{"client_ip":"1.1.1.1","@timestamp":"2025-12-09T10:00:00Z","url":"/x","status":"403","ua":"z","attack_type":"sqli"}',
        '{"ip":"","remote_addr":"2.2.2.2","uri":"","path":"/p"}', "[1]", "{broken", "5", "{'ip':'1.1.1.1'}",
    )
    assert sorted(got) == [0, 1]
    assert (got[0].ip, got[0].path, got[0].status, got[0].extra["attack_type"]) == ("1.1.1.1", "/x", 403, "sqli")
    assert (got[1].ip, got[1].path, got[1].timestamp, got[1].extra["action"]) == ("2.2.2.2", "/p", datetime(2025, 12, 10), "block")


def test_free_waf(spark):
    long = "a" * 600
    got = parse(
        spark, "free_waf",
        '["2025-11-27 03:25:24","4.189.145.250","GET","/shell.php",null,"url","detail","GET / HTTP/1.1\\nHost: h.example\\n"]',
        f'["2025-11-27 03:25:24","1.1.1.1","GET","/x",null,null,"d","{long}"]',
        '{"ip":"3.3.3.3","type":"args","host":"h"}', "blocked 5.6.7.8 today", "# 1.2.3.4", "[1,2]", '["t","1.1.1.1"]',
    )
    assert sorted(got) == [0, 1, 2, 3, 6]
    assert (got[0].status, got[0].extra["rule_type"], got[0].extra["domain"]) == (403, "url", "h.example")
    assert (got[1].extra["rule_type"], len(got[1].extra["raw_request"])) == ("None", 500)
    assert (got[2].method, got[2].extra["rule_type"], got[2].extra["domain"]) == ("GET", "args", "h")
    assert (got[3].ip, got[6].ip) == ("5.6.7.8", "1.1.1.1")


def test_ssh_and_auto(spark):
    lines = (
        "Dec  9 10:00:00 server sshd[12345]: Failed password for root from 192.168.1.100 port 22 ssh2",
        "Dec  9 10:00:01 server sshd[12345]: Invalid user admin from 192.168.1.100 port 22",
        "Dec  9 10:00:02 server sshd[1]: Accepted publickey for bob from 10.0.0.1 port 22 ssh2",
        "Dec  9 10:00:02 server sshd[1]: Failed password for root from fe80::1 port 22 ssh2",
    )
    got = parse(spark, "ssh", *lines)
    assert [(got[i].status, got[i].extra["failed"]) for i in (0, 1, 2)] == [(401, "true"), (401, "true"), (200, "false")]
    assert got[0].timestamp == datetime(2025, 12, 9, 10) and 3 not in got
    mixed = parse(spark, "auto", lines[0], '{"ip":"1.1.1.1"}', '["2025-11-27 03:25:24","4.1.1.1","GET","/s",null]', "see 9.9.9.9", "# x")
    assert [mixed[i].source for i in range(4)] == ["ssh", "waf", "free_waf", "free_waf"] and 4 not in mixed


def test_times(spark):
    cases = {
        "09/Dec/2025:10:00:00 +0800": datetime(2025, 12, 9, 2), "9/dec/2025:10:00:00 +08:00": datetime(2025, 12, 9, 2),
        "09/Dec/2025:10:00:00": datetime(2025, 12, 9, 2), "2025-12-09 10:00:00": datetime(2025, 12, 9, 2),
        "2025-12-09T10:00:00": datetime(2025, 12, 9, 2), "2025-12-09T10:00:00.5": datetime(2025, 12, 9, 2, 0, 0, 500000),
        "2025-12-09T10:00:00Z": datetime(2025, 12, 9, 10), "Feb 29 01:02:03": datetime(2024, 2, 28, 17, 2, 3),
        "2025-12-09": None, "": None, "2025-13-09 10:00:00": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select("t", parse_timestamp(F.col("t"), "Asia/Shanghai", F.lit(2024)).alias("p")).collect()
    assert {r.t: r.p for r in got} == cases


def test_files_globs_and_log_table(spark, tmp_path):
    (tmp_path / "free" / "deep" / "er").mkdir(parents=True)
    line = '["2025-11-27 03:25:24","4.189.145.250","GET","/s%d",null,"url"]\n'
    (tmp_path / "free" / "a.log").write_bytes((line % 1).encode() + b"bad \xff 1.2.3.4\n")
    (tmp_path / "free" / "deep" / "er" / "b.log").write_text(line % 2)
    (tmp_path / "free" / "skip.log").write_text(line % 3)
    (tmp_path / "sec").write_text("Dec  9 10:00:00 s sshd[1]: Failed password for root from 1.1.1.1 port 22 ssh2\n")
    paths = (f"{tmp_path}/free/*.log", f"{tmp_path}/free/**/*.log", f"{tmp_path}/none/*.log")
    lines = read_lines(spark, paths, ("skip*",))
    assert sorted(r.value for r in lines.collect()) == sorted([line.strip() % 1, line.strip() % 2, "bad  1.2.3.4"])
    options = Options(sources={
        "free_waf": SourceOptions(paths, ("skip*",)), "ssh": SourceOptions((f"{tmp_path}/sec",)),
        "nginx": SourceOptions((f"{tmp_path}/sec",), enabled=False),
    })
    logs = read_logs(spark, options, ctx())
    assert sorted((r.source, r.path) for r in logs.collect()) == [
        ("free_waf", ""), ("free_waf", "/s1"), ("free_waf", "/s2"), ("ssh", "/ssh"),
    ]
    write_logs(logs, str(tmp_path / "table"))
    stored = read_log_table(spark, str(tmp_path / "table"))
    assert stored.where("source = 'ssh'").count() == 1 and stored.count() == 4
    assert stored.select("seq").distinct().count() == 4


def test_wildcards():
    import re

    assert re.fullmatch(wildcard_regex("/a/**/*.log"), "/a/x/y/z.log") and re.fullmatch(wildcard_regex("/a/**/*.log"), "/a/z.log")
    assert not re.fullmatch(wildcard_regex("/a/*.log"), "/a/b/z.log") and re.fullmatch(wildcard_regex("x[!ab]?"), "xcd")
