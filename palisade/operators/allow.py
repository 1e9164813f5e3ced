"""Interval joins between client addresses and the allow list.

Addresses and intervals meet on the first 16 bits of the key, so the join is an
equi join with a range residual: each row is compared with the few intervals of
its own bucket instead of with all of them.  The interval side is broadcast only
when a count shows it is small.  Larger or wider lists are looked up by longest prefix
(``palisade.operators.prefixes``), once per distinct address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.ip import with_clean_ip
from palisade.operators import prefixes
from palisade.session import broadcast_if_small

BUCKET_DIGITS = 4


def valid_clients(logs: DataFrame) -> DataFrame:
    """Normalise ``ip``, add its key, and drop rows without a valid address."""
    return with_clean_ip(logs).where(F.col("_key").isNotNull())


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, 1 + BUCKET_DIGITS)


def bucketed(allow: DataFrame) -> DataFrame:
    """One row per interval and bucket it reaches (at most 65,536 for an interval)."""

    first = f"conv(substring({{}}, 2, {BUCKET_DIGITS}), 16, 10)"
    reach = f"sequence(cast({first.format('lo')} as int), cast({first.format('hi')} as int))"
    return allow.withColumn("_n", F.explode(F.expr(reach))).selectExpr(
        *allow.columns, f"concat(left(lo, 1), lpad(hex(_n), {BUCKET_DIGITS}, '0')) as _bucket"
    )


def _join(keyed: DataFrame, allow: DataFrame, how: str) -> DataFrame:
    buckets = bucketed(allow)
    small = broadcast_if_small(buckets)
    if small is buckets:
        return _join_large(keyed, allow, how)
    ranges = small.alias("r")
    rows = keyed.withColumn("_b", _bucket(F.col("_key"))).alias("l")
    hit = (F.col("l._b") == F.col("r._bucket")) & F.col("l._key").between(F.col("r.lo"), F.col("r.hi"))
    return rows.join(ranges, hit, how)


def _join_large(keyed: DataFrame, allow: DataFrame, how: str) -> DataFrame:
    """The same join where the list is too large to broadcast: addresses first, then their records."""
    found = (prefixes.covering if how == "inner" else prefixes.inside)(keyed, allow)
    return keyed.alias("l").join(found.alias("r"), F.col("l._key") == F.col("r._key"), how)


def longest_rule(logs: DataFrame, allow: DataFrame) -> DataFrame:
    """Records of valid addresses with the most specific allow-list entry over each, or NULLs.

    That is the interval that begins last, then ends first, then the least entry: of nested
    networks the innermost.  Adds ``entry``, ``kind``, ``lo`` and ``hi``.
    """
    clients = valid_clients(logs)
    rule = prefixes.longest_rule(clients, allow)
    return clients.join(rule, "_key", "left").select(*logs.columns, "entry", "kind", "lo", "hi")


def admit(logs: DataFrame, allow: DataFrame) -> DataFrame:
    """Records of valid addresses outside the allow list, with ``ip`` normalised."""
    return _join(valid_clients(logs), allow, "left_anti").drop("_key", "_b")


def allow_listed(logs: DataFrame, allow: DataFrame) -> DataFrame:
    """Records of addresses inside the allow list."""
    return _join(valid_clients(logs), allow, "left_semi").drop("_key", "_b")


def allow_audit(logs: DataFrame, allow: DataFrame) -> DataFrame:
    """Records with every allow-list entry that covers them."""
    joined = _join(valid_clients(logs), allow, "inner")
    return joined.select(*[f"l.{c}" for c in logs.columns], "r.entry", "r.kind")
