"""Shards along a Hilbert curve over metadata, so that files can be skipped by any of its dimensions.

Each dimension is quantised to equal shares of the rows, the cells are numbered along a
Hilbert curve, rows are ordered by curve index and key, and the order is cut into runs.
A run is a compact box in every dimension, so minima and maxima of a file rule it out for
filters on any of them.

Two laws of cutting: ``rows`` (counts of two shards differ by one at most) and ``bytes``
(shards hold near equal weight; a row goes where the middle of its weight falls).

Hot values do no harm: cells may hold any number of rows, as rows of a cell are ordered by
key and then by their place in the input, and ranges are cut between any two rows.

Cases: a null dimension is least of all; a null weight is 0; rows with a null key come first
in their cell; equal rows follow each other in the order of the input; an empty table gives
no rows; input columns named as the result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import free_name, written

LAWS = ("rows", "bytes")
ADDED = ("hilbert", "law", "shard", "slot")
_IN_PART = 33  # bits that monotonically_increasing_id leaves for the place in a partition


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of the cell with these coordinates of ``bits`` bits each.

    The transposed form: undo the turns of each level from the highest bit down, take the
    Gray code across dimensions, then read the bits of all coordinates level by level.
    """
    n = len(cells)
    turns = [(1 << level, i) for level in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, step: Column) -> Column:
        bit, i = step["bit"], step["i"]
        low, own = bit - 1, F.get(x, i)
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        change = F.when(own.bitwiseAND(bit) != 0, F.struct(low.alias("first"), F.lit(0).alias("own"))).otherwise(F.struct(swap.alias("first"), swap.alias("own")))
        return F.transform(F.array(change), lambda c: F.transform(
            x, lambda v, j: v.bitwiseXOR(F.when(j == 0, c["first"]).otherwise(F.when(j == i, c["own"]).otherwise(0))),
        ))[0]

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def last(x: Column) -> Column:
        flips = F.transform(F.sequence(F.lit(1), F.lit(bits - 1)), lambda k: F.call_function("shiftleft", F.lit(1), k)) if bits > 1 else F.array().cast("array<int>")
        flip = F.aggregate(flips, F.lit(0), lambda t, q: F.when(x[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(F.array(flip), lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))[0]

    def read(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(i).alias("i")) for level in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda s: F.call_function("shiftright", F.get(x, s["i"]), s["level"]).bitwiseAND(1)
        return F.aggregate(order, F.lit(0).cast("long"), lambda h, s: h * 2 + bit(s))

    start = F.array(*[c.cast("int") for c in cells])
    if turns:
        steps = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(i).alias("i")) for bit, i in turns])
        start = F.aggregate(steps, start, turn)
    bound = start
    for stage in (gray, last, read):
        bound = F.transform(F.array(bound), stage)[0]
    return bound


def placed(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, str]:
    """A written copy of ``rows`` in global order, and the name of its added column ``place``.

    ``place`` rises along the order: the number of the range partition in its high bits, the
    place inside in its low bits.  The copy is what all later steps read, so that a second
    evaluation can't draw other ranges.
    """
    spark = rows.sparkSession
    tie, place = free_name(rows.columns, "sh_tie"), free_name(rows.columns, "sh_place")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col(tie)]
    laid = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(laid.drop(tie).withColumn(place, F.monotonically_increasing_id()), name), place


def before(table: DataFrame, place: str, weight: Column | None, to: str) -> tuple[DataFrame, int]:
    """Add ``to``: the sum of weights (or the number of rows) in front of each row; and the total.

    Two levels: sums per range partition (as many rows as there are partitions) are added up,
    and a running sum inside each partition is put on top.
    """
    spark = table.sparkSession
    part = free_name(table.columns, "sh_part")
    staged = table.withColumn(part, F.shiftright(place, _IN_PART))
    sums = staged.groupBy(part).agg(F.sum(F.lit(1) if weight is None else weight).alias("w")).orderBy(part).collect()
    total, starts = 0, []
    for row in sums:
        starts.append((row[0], total))
        total += row["w"] or 0
    offset = free_name([*table.columns, part], "sh_offset")
    offsets = F.broadcast(spark.createDataFrame(starts, f"{part} long, {offset} long"))
    if weight is None:
        inside = F.col(place).bitwiseAND(F.lit((1 << _IN_PART) - 1))
    else:
        run = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(run), F.lit(0))
    return staged.withColumn(to, inside).join(offsets, part).withColumn(to, F.col(to) + F.col(offset)).drop(part, offset), total


def cuts(rows: DataFrame, column: str, levels: int) -> list[tuple[int, object]]:
    """``(level, least value)`` of the quantised dimension: the share of rows with less, times ``levels``, rounded down.

    Rows are counted per value before anything is ordered, so a hot value is one row.
    """
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    table, place = placed(counts, [F.col("v").asc_nulls_first()], "cuts")
    shares, total = before(table, place, F.col("n"), "less")
    level = F.expr(f"less * {levels} div {max(total, 1)}L")
    found = shares.where("v is not null").groupBy(level.alias("level")).agg(F.min("v").alias("v")).collect()
    return sorted((int(r["level"]), r["v"]) for r in found)


def level_of(column: str, found: list[tuple[int, object]]) -> Column:
    """The level of a value, given the cuts of its dimension; null is level 0."""
    level = F.lit(0)
    for number, least in found:
        level = F.when(F.col(column) >= F.lit(least), F.lit(number)).otherwise(level)
    return level


def shard_rows(
    rows: DataFrame, dimensions: tuple[str, ...], key: str, weight: str, shards: int = 16, law: str = "rows", bits: int = 5
) -> DataFrame:
    """``rows`` with ``hilbert`` (curve index), ``law``, ``shard`` (from 0) and ``slot`` (place in the shard, from 0).

    Rows come in curve order, each task with a stretch of it.  ``dimensions`` are two or more
    columns of any ordered type, each cut into ``2 ** bits`` levels.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    rows = rows.drop(*[c for c in ADDED if c in rows.columns])
    rows = written(rows, "shard-input")
    found = {d: cuts(rows, d, 1 << bits) for d in dimensions}
    numbered = rows.withColumn("hilbert", hilbert_index([level_of(d, found[d]) for d in dimensions], bits))
    table, place = placed(numbered, [F.col("hilbert"), F.col(key).asc_nulls_first()], "shards")
    rank, front = free_name(table.columns, "sh_rank"), free_name(table.columns, "sh_front")
    ranked, count = before(table, place, None, rank)
    if not count:
        return ranked.drop(rank, place).withColumns({"law": F.lit(law), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    if law == "rows":
        shard = F.expr(f"{rank} * {shards} div {count}L")
        first = F.expr(f"(shard * {count}L + {shards - 1}) div {shards}")
        cut = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(rank) - first)
        return cut.drop(rank, place).withColumn("law", F.lit(law))
    load = F.coalesce(F.col(weight).cast("long"), F.lit(0))
    weighed, total = before(ranked, place, load, front)
    middle = (F.col(front) * 2 + load).cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(2 * total, 1)).cast("decimal(20,0)")).cast("int"))
    cut = weighed.withColumn("shard", shard)
    first = free_name(cut.columns, "sh_first")
    firsts = cut.groupBy("shard").agg(F.min(rank).alias(first))  # a row a shard
    cut = cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(rank) - F.col(first))
    return cut.drop(rank, front, first, place).withColumn("law", F.lit(law))


def document_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus one), ``text_crc32`` and the named metadata of each document, without its text."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        *[F.col(c) for c in also if c not in ("doc_id", "size", "text_crc32")],
    )


def write_shards(
    docs: DataFrame, folder: str, dimensions: tuple[str, ...] = ("lang", "source", "size"), key: str = "doc_id", text: str = "text",
    shards: int = 16, law: str = "bytes", bits: int = 5,
) -> DataFrame:
    """Write whole documents as Parquet below ``folder``, a folder per shard, rows in curve order.

    Returns the written table.  A task holds a stretch of the curve, so a file spans a small
    box of the dimensions and its statistics let readers skip it.  A column ``size`` is added
    where it is missing.
    """
    if "size" not in docs.columns:
        docs = docs.withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"))
    shard_rows(docs, dimensions, key, "size", shards, law, bits).write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
