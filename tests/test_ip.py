"""Address expressions against Python's ``ipaddress``."""

import ipaddress
import random

from pyspark.sql import functions as F

from palisade.functions import ip as ipf
from palisade.operators import prefixes
from palisade.operators.allow import admit, allow_audit, allow_listed, longest_rule
from palisade.sources.allowlist import add_entries, allow_counts, allow_table, entry_lines, intervals

CASES = [
    "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::5", "fe80::1%eth0", "fe80::1%",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "::ffff:1.2.3.4",
    "::1.2.3.4.5", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "g::1", "12345::", "",
    "abc", "1.2.3.4 ", "FE80::ABCD", "0:0:0:0:0:0:0:0", "1:2:3:4:5:6:7::8", "a:b", "::%a%b", "1000::0010", "::ffff:10.0.0.1",
]


def key(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{address.version}{int(address):0{8 if address.version == 4 else 32}X}"


def private(text):
    return key(text) is not None and ipaddress.ip_address(text).is_private


def made(n):
    rng = random.Random(5)
    for _ in range(n):
        parts = ["%x" % rng.choice([0, 1, rng.getrandbits(16)]) for _ in range(rng.randint(0, 9))]
        if parts and rng.random() < 0.6:
            parts[rng.randrange(len(parts))] = ""
        yield ":".join(parts) + ("1.2.3.4" if rng.random() < 0.2 else "")
        yield str(ipaddress.IPv6Address(rng.getrandbits(128)))
        yield str(ipaddress.IPv4Address(rng.getrandbits(32)))


def test_keys_and_private(spark):
    cases = CASES + list(made(100))
    df = spark.createDataFrame([(c,) for c in cases], "ip string").withColumn("k", ipf.ip_key("ip"))
    for row in ipf.with_private(df).collect():
        assert (row.k, row.is_private) == (key(row.ip), private(row.ip)), row


def test_clean_ip(spark):
    cases = {
        " 1.2.3.4:80 ": "1.2.3.4", "[::1]": "::1", "[::1]:80": "::1", "1.2.3.4, 5.6.7.8": "1.2.3.4",
        "1.2.3.4:5, 6.7.8.9": "1.2.3.4", "::1": "::1", "x": None, "": None, "[]": None, "[::1": None, "a:b": None,
    }
    df = spark.createDataFrame([(c, c) for c in cases], "given string, ip string")
    assert {r.given: r.ip for r in ipf.with_clean_ip(df).collect()} == cases


def test_bounds(spark):
    rng = random.Random(7)
    entries = ["10.1.2.3/8", "10.0.0.0/33", "10.0.0.0/255.0.0.0", "10.0.0.0/0.255.255.255", "10.0.0.0/255.0.255.0",
               "::/129", "1.1.1.1/8/9", "x/8", "1.2.3.4"]
    entries += [f"{ipaddress.IPv6Address(rng.getrandbits(128))}/{p}" for p in range(0, 129, 3)]
    entries += [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{p}" for p in range(33)]

    def bounds(text):
        try:
            network = ipaddress.ip_network(text, strict=False)
            return key(str(network.network_address)), key(str(network.broadcast_address))
        except ValueError:
            return None, None

    df = spark.createDataFrame([(e,) for e in entries], "entry string")
    for row in ipf.with_bounds(df).collect():
        assert (row.lo, row.hi) == bounds(row.entry), row.entry
    ranges = {"1.2.3.4-1.2.3.9": True, "1.2.3.9-1.2.3.4": False, "::1-::5": True, "1.2.3.4-::5": False}
    df = spark.createDataFrame([(e,) for e in ranges], "entry string")
    assert {r.entry: r.lo is not None for r in ipf.with_bounds(df).collect()} == ranges


def test_allow_list_text_and_counts(spark):
    text = ["# c", "", "10.0.0.0/8 # in", "10.1.0.0/8", "1.1.1.1-1.1.1.9", "1.1.1.9-1.1.1.1", "9.9.9.9", "9.9.9.9", "no"]
    allow = intervals(entry_lines(spark.createDataFrame([(t,) for t in text], "value string")))
    assert {r.kind: r.entries for r in allow_counts(allow).collect()} == {"cidr": 1, "range": 1, "ip": 1}
    assert add_entries(allow, ["8.8.8.8", "bad"]).count() == 4


def test_interval_joins_and_beyond_broadcast(spark, monkeypatch):
    allow = allow_table(spark, ["66.249.64.0-66.249.64.31", "160.79.104.0/23", "2001:db8::/32", "17.0.0.0/8", "::1"])
    ips = ["66.249.64.10", "66.249.64.32", "160.79.104.50", "160.79.106.1", "17.22.100.10", "2001:db8:ffff::1", "2001:db9::1", "::1", "junk"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    outside = ["160.79.106.1", "2001:db9::1", "66.249.64.32"]
    inside = sorted(set(ips) - set(outside) - {"junk"})
    for rows in (50_000, 0):  # broadcast, then the shuffle join
        monkeypatch.setattr("palisade.operators.allow.broadcast_if_small", lambda x, n=rows: F.broadcast(x) if n else x.hint("merge"))
        assert sorted(r.ip for r in admit(df, allow).collect()) == outside
        assert sorted(r.ip for r in allow_listed(df, allow).collect()) == inside
        assert {(r.ip, r.entry) for r in allow_audit(df, allow).collect()} >= {("17.22.100.10", "17.0.0.0/8"), ("::1", "::1")}


def spans_made(n):
    """Networks of all lengths and ranges of both families, many nested, with their ends as numbers."""
    rng, made = random.Random(3), []
    for i in range(n):
        width, base, maker = (32, 0x0A000000, ipaddress.IPv4Address) if i % 2 else (128, 0x2001 << 112, ipaddress.IPv6Address)
        start = base + rng.getrandbits(rng.choice([4, 10, 24]))
        if i % 5 == 0:
            end = start + rng.getrandbits(rng.choice([1, 5, 13, 20]))
            made.append((f"{maker(start)}-{maker(end)}", maker(0).version, start, end))
        else:
            net = ipaddress.ip_network((start, rng.randint(0 if i < 12 else 4, width)), strict=False)
            made.append((str(net), net.version, int(net[0]), int(net[-1])))
    return made


def test_covers_hold_each_address_of_an_interval_once(spark):
    spans = {e: (lo, hi) for e, _, lo, hi in spans_made(300)}
    allow = intervals(spark.createDataFrame([(e,) for e in spans], "entry string"))
    blocks = {}
    for row in prefixes.cover(allow).collect():
        width = (9 if row.prefix[0] == "4" else 33) - len(row.prefix)
        first = int(row.prefix[1:] or "0", 16) << 4 * width
        blocks.setdefault(row.entry, []).append((first, first + (1 << 4 * width) - 1))
    assert len(blocks) == allow.count()
    for entry, found in blocks.items():
        found.sort()
        assert (found[0][0], found[-1][1]) == spans[entry], entry
        assert all(a[1] + 1 == b[0] for a, b in zip(found, found[1:])), entry
        assert "/" not in entry or len(found) <= 8


def test_longest_rule_and_large_lists(spark, monkeypatch):
    spans, rng = spans_made(400), random.Random(9)
    allow = intervals(spark.createDataFrame([(e,) for e, *_ in spans], "entry string")).cache()
    made = {4: ipaddress.IPv4Address, 6: ipaddress.IPv6Address}
    ends = [made[v](x + d) for _, v, lo, hi in rng.sample(spans, 120) for x in (lo, hi) for d in (-1, 0, 1) if 0 <= x + d < 1 << (32 if v == 4 else 128)]
    ips = sorted({str(x) for x in ends}) + ["192.0.2.1", "junk", None, "192.0.2.1"]
    logs = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "n int, ip string")
    kept = [(r.entry, r.lo, r.hi) for r in allow.collect()]

    def over(ip):
        k = key(ip)
        return [(e, lo, hi) for e, lo, hi in kept if lo[0] == k[0] and lo <= k <= hi]

    valid = [(i, x) for i, x in enumerate(ips) if x and x != "junk"]
    best = {i: min(over(x), key=lambda r: (-int(r[1][1:], 16), r[2], r[0]), default=(None,))[0] for i, x in valid}
    assert {r.n: r.entry for r in longest_rule(logs, allow).collect()} == best
    monkeypatch.setattr("palisade.operators.allow.broadcast_if_small", lambda df: df)  # as for a list beyond its bound
    assert sorted(r.n for r in admit(logs, allow).collect()) == [i for i, x in valid if not over(x)]
    assert sorted(r.n for r in allow_listed(logs, allow).collect()) == [i for i, x in valid if over(x)]
    assert sorted((r.n, r.entry) for r in allow_audit(logs, allow).collect()) == sorted((i, e) for i, x in valid for e, *_ in over(x))


def test_extract(spark):
    cases = {"from 1.2.3.4 to": "1.2.3.4", "x 999.1.1.1 fe80::1 y": "fe80::1", "none": None, "v 300.1.1.1": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.ip for r in ipf.with_extracted_ip(df, "t").collect()} == cases
