"""Longest-prefix index over address intervals, for allow lists of any size and nesting.

Keys (``palisade.functions.ip``) are hex digits behind a family mark, so a block of
addresses is the beginning of a key.  Every interval is cut into the few blocks that
cover it exactly, and an address is looked up once per block length in use (at most 42):
an equi join on the whole block, which has no residual and no hot short prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import once

DIGITS = "0123456789ABCDEF"
_EACH = "array(" + ", ".join(f"'{d}'" for d in DIGITS) + ")"


def cover(intervals: DataFrame) -> DataFrame:
    """One row per interval and block ``prefix`` of it; the blocks of an interval are apart.

    Where ``lo`` and ``hi`` agree in ``_c`` digits, the cover is: the blocks between their
    next digits; ``lo`` without its last zeros and ``hi`` without its last Fs, each a block;
    and behind each digit in between the greater ones of ``lo``, the lesser ones of ``hi``.
    A network of n bits is one block, or 2, 4 or 8 where n is not a multiple of 4.
    """
    same = "size(filter(sequence(1, length(lo)), i -> left(lo, i) = left(hi, i)))"
    known = once(intervals, {"_c": F.expr(same)})
    ends = once(known, {
        "_l": F.expr("greatest(length(rtrim('0', lo)), _c + 1)"),
        "_h": F.expr("greatest(length(rtrim('F', hi)), _c + 1)"),
        "_one": F.expr("length(rtrim('0', substring(lo, _c + 1))) = 0 and length(rtrim('F', substring(hi, _c + 1))) = 0"),
    })

    def beside(bound: str, upto: str, test: str) -> str:
        digits = f"filter({_EACH}, d -> d {test} substring({bound}, j + 1, 1))"
        steps = f"filter(sequence(_c, length({bound})), j -> j > _c and j < {upto})"
        return f"flatten(transform({steps}, j -> transform({digits}, d -> concat(left({bound}, j), d))))"

    between = f"filter({_EACH}, d -> d > substring(lo, _c + 1, 1) and d < substring(hi, _c + 1, 1))"
    blocks = f"""case when _one then array(left(lo, _c)) else concat(
        array(left(lo, _l), left(hi, _h)), transform({between}, d -> concat(left(lo, _c), d)),
        {beside("lo", "_l", ">")}, {beside("hi", "_h", "<")}) end"""
    return ends.select(*intervals.columns, F.explode(F.expr(blocks)).alias("prefix"))


def most_specific(cut: DataFrame) -> DataFrame:
    """The rule of each block: of all that cover it the one that begins last, then ends first, then the least entry."""
    return cut.groupBy("prefix").agg(F.min(_order()).alias("rule"))


def _order():
    turned = F.translate("lo", DIGITS, DIGITS[::-1])
    return F.struct(turned.alias("turned"), "hi", "entry", "kind", "lo")


def probes(keys: DataFrame, blocks: DataFrame, key: str = "_key") -> DataFrame:
    """Each distinct ``key`` with its beginnings of all lengths that ``blocks`` have.

    Only the lengths, at most 42 numbers, come to the driver.
    """
    lengths = sorted(r.n for r in blocks.select(F.length("prefix").alias("n")).distinct().collect())
    starts = F.array(*[F.left(F.col(key), F.lit(n)) for n in lengths]).cast("array<string>")
    # An IPv4 key is shorter than some lengths: its beginnings of these are the key itself, once.
    return keys.select(key).distinct().select(key, F.explode(F.array_distinct(starts)).alias("prefix"))


def longest_rule(keys: DataFrame, intervals: DataFrame, key: str = "_key") -> DataFrame:
    """``key, entry, kind, lo, hi`` of the most specific interval over each distinct key that has one."""
    blocks = most_specific(cover(intervals))
    found = probes(keys, blocks, key).join(blocks, "prefix").groupBy(key).agg(F.min("rule").alias("rule"))
    return found.select(key, *[F.col(f"rule.{c}").alias(c) for c in ("entry", "kind", "lo", "hi")])


def covering(keys: DataFrame, intervals: DataFrame, key: str = "_key") -> DataFrame:
    """``key, entry, kind`` for every interval over each distinct key, once each."""
    blocks = cover(intervals).select("prefix", "entry", "kind")
    return probes(keys, blocks, key).join(blocks, "prefix").select(key, "entry", "kind")


def inside(keys: DataFrame, intervals: DataFrame, key: str = "_key") -> DataFrame:
    """The distinct keys that any interval covers."""
    blocks = cover(intervals).select("prefix").distinct()
    return probes(keys, blocks, key).join(blocks, "prefix", "left_semi").select(key).distinct()
