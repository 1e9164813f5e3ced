"""Line dedup: drop lines whose key many documents share, and put the rest together again.

Cases: null or empty text is one empty line; lines with fewer code points than
``min_key_chars`` are never dropped; documents are told apart by id, so repeated rows of
one id count once; rows without an id keep frequent lines' counts unchanged but lose such
lines themselves; every input row comes back once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SPACE, free_prefix, lower_ascii


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def dedup_lines(
    docs: DataFrame, min_documents: int = 10, min_key_chars: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``text`` reassembled, and ld_n_lines and ld_n_dropped.

    Lines are exploded to their 128-bit key hash.  Counting starts with partial sums in
    each task, so a line of a third of all documents is a few rows per task when it is
    shuffled.  Occurrences meet the frequent hashes, come together per document as
    positions, and the text keeps the other ones.  Rows are named by a 128-bit hash of id
    and text, so rows with one id but other texts stay apart.  Input columns named as the
    two result columns are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ld_n_lines", "ld_n_dropped")])
    body, p = F.coalesce(F.col(text), F.lit("")), free_prefix(docs.columns, "ld_")
    row = [f"{p}row1", f"{p}row2"]
    named = docs.withColumns({
        row[0]: F.xxhash64(F.col(doc_id), body), row[1]: F.xxhash64(F.lit("row"), F.col(doc_id), body), f"{p}lines": F.split(body, "\n"),
    })
    lines = named.select(F.col(doc_id).alias("id"), F.col(row[0]).alias("r1"), F.col(row[1]).alias("r2"), F.posexplode(f"{p}lines").alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_key_chars)
    lines = lines.select("id", "r1", "r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    once = lines.where("id is not null").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    frequent = once.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("h1", "h2")
    dropped = lines.join(frequent, ["h1", "h2"]).groupBy(F.col("r1").alias(row[0]), F.col("r2").alias(row[1])).agg(F.collect_set("pos").alias(f"{p}drop"))
    out = named.join(dropped, row, "left")
    every = F.sequence(F.lit(0), F.size(f"{p}lines") - 1)
    stay = F.array_except(every, F.coalesce(f"{p}drop", F.array().cast("array<int>")))
    kept = F.when(F.col(f"{p}drop").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col(f"{p}lines"), i)), "\n")
    )
    counts = {
        "ld_n_lines": F.size(f"{p}lines").cast("long"),
        "ld_n_dropped": F.coalesce(F.size(f"{p}drop"), F.lit(0)).cast("long"),
        text: kept,
    }
    return out.withColumns(counts).select(*[F.col(f"`{n}`") for n in docs.columns], "ld_n_lines", "ld_n_dropped")


def filter_lines(docs: DataFrame, min_documents: int = 10, min_key_chars: int = 1) -> DataFrame:
    """Documents without the lines that ``min_documents`` share; ``n_chars`` adjusted."""
    out = dedup_lines(docs, min_documents, min_key_chars)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("ld_n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{n}`") for n in docs.columns])
