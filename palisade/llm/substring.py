"""Substring dedup: windows of words that the corpus holds earlier, found by a count-min prefilter.

Pass 1: every partition counts its windows in a count-min sketch; the partition sketches
are merged.  Counts are never too small, so a window estimated once occurs once.  Pass 2
groups exactly the windows estimated repeated, and none that repeats is lost.

Cases: null, empty and short texts have no window and lose nothing; equal rows (same id, same
text) are one document and do not remove each other; rows that repeat an id with other texts
are documents of their own, whose windows come in order of id, start and the text's hash; a
row without an id takes no part and loses nothing; an empty table gives an empty result.
However the rows are dealt over partitions, the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import pieces, strings, written
from palisade.llm.words import hash_spans, mix, whole_windows, window_hashes, words


TEXT_BYTES = 2 << 20  # of text that a task takes apart at once
OUT_ROWS = 1 << 16  # that a task hands on at once
VARIANT_ROWS = 500_000  # ids with several texts are broadcast up to so many, beyond that joined


@dataclass(frozen=True)
class SubstringRules:
    window: int = 20
    depth: int = 3
    # Counters of one sketch row: a power of two above twice the windows, within these bounds.
    # The upper one bounds what each task holds (depth * 2**bits / 8 bytes); a fuller sketch
    # lets more windows through to the exact pass and changes no result.
    min_bits: int = 20
    max_bits: int = 28
    block_bits: int = 20
    # Windows that a task sums up before it hands on a partial sketch.
    flush: int = 1 << 22


def _rows_of(h: np.ndarray, rules: SubstringRules, bits: int) -> list[np.ndarray]:
    """Counter of each window in every row of the sketch."""
    return [
        (mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (d + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.uint32)
        for d in range(rules.depth)
    ]


def _blocks(batches: Iterator[pa.RecordBatch], rules: SubstringRules, check: bool) -> Iterator[tuple]:
    """``(batch, first word per row, window start, window row, hash, check hash)`` of bounded pieces."""
    for batch in pieces(batches, 1, TEXT_BYTES):
        offsets, data = strings(batch.column(1))
        starts, ends, first = words(data, offsets)
        hashes = hash_spans(data, starts, ends)
        whole = np.flatnonzero(whole_windows(first, rules.window, len(hashes)))
        h = window_hashes(hashes, rules.window)[whole]
        c = window_hashes(hashes, rules.window, seed=7)[whole] if check else None
        yield batch, first, whole, np.searchsorted(first, whole, "right") - 1, h, c


def _sketch(rules: SubstringRules, bits: int):
    """Partial sketches: per row and block the sorted counters hit, as packed gaps."""
    block = rules.block_bits

    def packed(counters: np.ndarray, depth: int) -> Iterator[tuple]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        counters.sort()
        edges = np.searchsorted(counters, np.arange(1, 1 << (bits - block), dtype=np.uint64) << np.uint64(block))
        for b, part in enumerate(np.split(counters, edges)):
            if len(part):
                yield depth, b, squeeze.compress(np.diff(part, prepend=np.uint32(b << block)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in range(rules.depth)]
        n = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for d in range(rules.depth):
                counters = np.concatenate(kept[d])
                kept[d].clear()
                rows = list(packed(counters, d))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    ["depth", "block", "gaps"],
                )

        for *_, h, _c in _blocks(batches, rules, False):
            for d, at in enumerate(_rows_of(h, rules, bits)):
                kept[d].append(at)
            n += len(h)
            if n >= rules.flush:
                yield from flushed()
                n = 0
        if n:
            yield from flushed()

    return run


def _merge(block_bits: int):
    """Sum the partial sketches of a block as they stream in; keep which counters reach two."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        counts = np.zeros(1 << block_bits, np.uint8)
        depth, block = (k.as_py() for k in key)
        for batch in batches:
            for gaps in batch.column(batch.schema.get_field_index("gaps")):
                raw = np.frombuffer(expand.decompress(gaps.as_py()), np.uint8)
                at = np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1), dtype=np.int64)
                once = np.concatenate([[True], at[1:] != at[:-1]])
                again = at[~once]
                counts[at[once]] = np.minimum(counts[at[once]] + 1, 2)
                counts[again] = 2
        bits = np.packbits(counts >= 2, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([depth], pa.int32()), pa.array([block], pa.int32()), pa.array([bits], pa.binary())], ["depth", "block", "bits"])

    return run


def sketch_bits(docs: DataFrame, rules: SubstringRules, text: str = "text") -> int:
    """Size of a sketch row for these texts, from their length in bytes (six to a word)."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(rules.max_bits, max(rules.min_bits, int(size // 3).bit_length()))


def repeated_filter(docs: DataFrame, rules: SubstringRules, bits: int):
    """The merged sketch as a bit per counter: a broadcast of depth * 2**bits / 8 bytes."""
    partial = docs.mapInArrow(_sketch(rules, bits), "depth int, block int, gaps binary")
    merged = partial.groupBy("depth", "block").applyInArrow(_merge(rules.block_bits), "depth int, block int, bits binary")
    table = np.zeros((rules.depth, 1 << (bits - 3)), np.uint8)
    width = 1 << (rules.block_bits - 3)
    for row in merged.toLocalIterator(prefetchPartitions=True):
        table[row["depth"], row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table)


def _estimated(rules: SubstringRules, bits: int, sketch):
    """Windows estimated repeated, settled as far as one task sees.

    Rows with ``place`` >= 0: the least document of this task for a window, to be compared
    with the others'; ``place`` holds 31 check bits of the window above its start.  Rows with
    ``place`` < 0: words of a document, from ``-1 - place`` on, that an earlier window in the
    same task already covers (their ``h`` only spreads them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kept, n = sketch.value, [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            # One column after another, as they are the most that a task holds.
            columns = [np.concatenate([k.pop(0) for k in kept]) for _ in range(5)]
            kept.clear()
            order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
            for i in range(5):
                columns[i] = columns[i][order]
            del order
            h, c, doc, start, variant = columns
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            twin = np.zeros(len(h), bool)  # the same place of a repeated row is judged as the first of its kind
            twin[1:] = same[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (variant[1:] == variant[:-1])
            later = same[np.maximum.accumulate(np.where(twin, 0, np.arange(len(h))))]
            later = doc[later], start[later], variant[later]
            send = np.flatnonzero(~same)
            send = send[np.lexsort((start[send], doc[send]))]  # in text order rows compress best
            del h, c, doc, start, variant, same, twin
            for i in range(5):
                columns[i] = columns[i][send]
            del send
            for i in range(0, len(columns[0]), OUT_ROWS):
                h, c, doc, start, variant = (x[i : i + OUT_ROWS] for x in columns)
                yield _rows(h.view(np.int64), (c.astype(np.int64) >> 1 << 32) + start, doc, variant)
            columns.clear()
            yield from _stretches(*later, rules.window)

        for batch, first, at, row, h, c in _blocks(batches, rules, True):
            ok = np.ones(len(h), bool)
            for d, i in enumerate(_rows_of(h, rules, bits)):
                ok &= (table[d, i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
            ids = batch.column(0)
            ok &= ~np.asarray(ids.is_null())[row]
            doc, mine = np.asarray(ids.fill_null(0), np.int64), row[ok]
            of = np.asarray(batch.column(2), np.int32)[mine]
            kept.append([h[ok], c[ok].astype(np.uint32), doc[mine], (at[ok] - first[mine]).astype(np.int32), of])
            n += int(ok.sum())
            if n >= rules.flush:
                yield from settled()
                n = 0
        if n:
            yield from settled()

    return run


def _rows(h: np.ndarray, place: np.ndarray, doc: np.ndarray, variant: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(place), pa.array(doc), pa.array(variant)], ["h", "place", "id", "variant"])


def _stretches(doc: np.ndarray, start: np.ndarray, variant: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """The later windows: of a stretch only as many as it takes to cover it."""
    order = np.lexsort((start, variant, doc))
    d, s, v = doc[order], start[order].astype(np.int64), variant[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (s[1:] > s[:-1] + window)
    at = np.flatnonzero(new)
    begin = s[at[np.cumsum(new) - 1]] if len(s) else s
    first = new.copy()  # of the starts within the same multiple of the window's length
    first[1:] |= ((s - begin) // window)[1:] != ((s - begin) // window)[:-1]
    need = first | np.append(first[1:], True)[: len(s)]  # and the last of them
    d, s, v = d[need], s[need], v[need]
    for i in range(0, len(d), OUT_ROWS):
        some, at = d[i : i + OUT_ROWS], s[i : i + OUT_ROWS]
        yield _rows(mix((some * 31 + at).view(np.uint64)).view(np.int64), -1 - at, some, v[i : i + OUT_ROWS])


def _named(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """``id``, ``text``, ``variant``; and whether an id has several texts.

    ``variant`` is 0 but for the texts of such an id, which are numbered by their hashes.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    print_ = F.sha2(F.coalesce("text", F.lit("")), 256)
    several = source.where("id is not null").select("id", F.xxhash64("text").alias("x")).groupBy("id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    several = written(several.where("lo <> hi").select("id"), "several")
    if several.isEmpty():
        return source.withColumn("variant", F.lit(0)), False
    if several.limit(VARIANT_ROWS + 1).count() <= VARIANT_ROWS:  # 8 bytes each
        several = F.broadcast(several)
    prints = source.join(several, "id").select("id", print_.alias("print")).distinct()
    prints = prints.withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("print")) - 1)
    numbered = source.withColumn("print", print_).join(prints, ["id", "print"], "left")
    return numbered.select("id", "text", F.coalesce("variant", F.lit(0)).alias("variant")), True


def removed_windows(docs: DataFrame, rules: SubstringRules = SubstringRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, start)``: windows of each document that cover all its words covered by a window
    that also starts earlier in the corpus.

    Each task hands on one row per window that it holds, however often, so the rows of a
    passage that a third of the documents share are as few as tasks, and one shuffle with a
    minimum per window settles the rest.
    """
    return _removed(*_named(docs, doc_id, text), rules).select("id", "start")


def _removed(source: DataFrame, several: bool, rules: SubstringRules) -> DataFrame:
    """``id``, ``variant``, ``start`` of the removed windows of ``_named`` rows."""
    bits = sketch_bits(source, rules, "text")
    sketch = repeated_filter(source, rules, bits)
    seen = source.mapInArrow(_estimated(rules, bits, sketch), "h long, place long, id long, variant int")
    window = Window.partitionBy("h", F.shiftright("place", 32))
    start = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)))
    # One text per id: a window has one first place in it, so the id alone decides.
    rank = F.struct("id", start.alias("start"), "variant") if several else F.col("id")
    settled = seen.withColumn("least", F.min(rank).over(window)).where((F.col("place") < 0) | (rank > F.col("least")))
    return settled.select("id", "variant", start.cast("int").alias("start"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames, for the shuffle that brings them to their windows."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches, 1, TEXT_BYTES):
        packed = [squeeze.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["id", "packed", "variant"])


def _cut(doc_id: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in pieces(batches, 1, TEXT_BYTES):
            texts, starts = batch.column(1).to_pylist(), batch.column(2)
            total, gone, sha, out = [], [], [], []
            for i, text in enumerate(texts):
                parts = expand.decompress(text).split()
                cut = np.zeros(len(parts) + 1, np.int32)
                if starts[i].is_valid:
                    at = starts[i].values.to_numpy()
                    np.add.at(cut, at, 1)
                    np.add.at(cut, at + window, -1)
                stay = np.cumsum(cut)[:-1] <= 0
                left = b" ".join(parts if stay.all() else [parts[j] for j in np.flatnonzero(stay)])
                total.append(len(parts))
                gone.append(len(parts) - int(stay.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                out.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(out, pa.binary()).cast(pa.string())],
                [doc_id, "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, rules: SubstringRules = SubstringRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and kept_text (kept words, one space between)."""
    source, several = _named(docs, doc_id, text)
    per_doc = _removed(source, several, rules).groupBy("id", "variant").agg(F.collect_list("start").alias("starts"))
    packed = source.mapInArrow(_squeeze, "id long, packed binary, variant int")
    joined = packed.join(per_doc, ["id", "variant"], "left").select("id", "packed", "starts")
    schema = f"`{doc_id}` long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_cut(doc_id, rules.window), schema)
