"""Shared helpers: tables in the shared folder, hot-key-safe components, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all word and line rules of this package: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="palisade-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, lengthened until no column has that name (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def free_prefix(columns: list[str], wish: str) -> str:
    """``wish``, lengthened until no column begins with it."""
    while any(c.lower().startswith(wish.lower()) for c in columns):
        wish += "_"
    return wish


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one run's table below the shared folder."""
    return f"{shared_folder(spark)}/palisade-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Executors that are lost afterwards cost nothing, as the rows are files that all share.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column) -> tuple:
    """``(offsets, data)`` numpy views of an Arrow string or binary column; null is empty."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    step = np.int64 if large else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, step, len(column) + 1, column.offset * np.dtype(step).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0] : ends[-1]]


def pieces(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, so that memory is bounded.

    A slice never cuts a row; one longer than the limit comes alone.
    """
    import numpy as np

    for batch in batches:
        offsets, _ = strings(batch.column(text_at))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` with the smallest node each is connected to, itself included.

    ``edges`` holds pairs of long ids in any direction and number.  Alternating large-star
    and small-star rounds: every node points its larger neighbours to its least neighbour,
    then the smaller ones.  Minima are partial aggregates and the rows of a hub are joined
    to its one minimum, so no task holds the neighbours of a node together; each half round
    is a table in the shared folder, so Spark knows its size and joins small ones without a
    shuffle.  Ends when all edges form stars, which a further round would leave as they are.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = written(edges.select(hi, lo).where("u > v").distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u > v").distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    # Of a star, every node but the least has one row, which names that one.
    return written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ), "components")


def trees(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` as ``components`` gives it, where each ``a`` has one link and no way returns.

    Every node looks past the one it points to, which halves the way to its root each round.
    """
    now, moved = links.select("a", "b"), True
    for _ in range(most_rounds):
        onward = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        then = now.join(onward, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
        now = written(then, "trees")
        moved = not now.where("moved").isEmpty()
        if not moved:
            break
    if moved:
        raise RuntimeError("trees did not settle")
    least = written(now.groupBy("b").agg(F.min("a").alias("m")).select("b", F.least("b", "m").alias("m")), "roots")
    named = now.join(least, "b").select(F.col("a").alias("node"), F.col("m").alias("component"))
    return written(named.unionByName(least.toDF("node", "component")), "components")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u`` itself."""
    if not edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
