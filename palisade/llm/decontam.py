"""Benchmark decontamination by templates: windows of text with typed placeholders.

Numbers, names and units become placeholders; windows of the result are hashed and joined
with those of the benchmark; aligned windows then must replace each value by one value
throughout, so a question with other numbers or names is found and a chance match is not.

Cases: null and empty texts have no window; items with fewer tokens than a window are not
searched for; repeated rows of one id count once; a row without an id is reported under a
null id; empty documents or an empty benchmark give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import pieces, strings
from palisade.llm.words import hash_spans, spans, window_hashes, whole_windows

# Units that count as such after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg",
    "lb", "lbs", "oz", "pound", "pounds", "gram", "grams", "ton", "tons", "ml", "l", "liter", "liters", "litre",
    "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent",
    "mph", "kmh", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "degree", "degrees", "s", "h", "min",
)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA5A5A5A500000001, 0xA5A5A5A500000002, 0xA5A5A5A500000003))


@dataclass(frozen=True)
class TemplateRules:
    window: int = 8
    # A window needs so many words that are no placeholders, or anything would match it.
    min_literals: int = 5
    # So many aligned windows make a hit (all of them where an item has fewer).
    min_windows: int = 5
    # Share of benchmark values that map to one value each.
    min_consistency: float = 0.75
    # Bits of the filter before the join: a proven bound of 2 MB whatever the benchmark's size.
    filter_bits: int = 24


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    digit = (b >= 0x30) & (b <= 0x39)
    upper, lower = (b >= 0x41) & (b <= 0x5A), (b >= 0x61) & (b <= 0x7A)
    fold = b.astype(np.uint8)
    fold[0x41:0x5B] += 0x20
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".!?:\n\""]] = True
    return {"digit": digit, "upper": upper, "token": digit | upper | lower | (b >= 0x80), "fold": fold, "stop": stop}


_CLASS = _classes()


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes, slots, first)`` of the tokens of a block of texts.

    Tokens are runs of letters or numbers ("3.5" is one, "5km" two).  ``slots`` is 0 for a
    plain word, else 1 number, 2 name, 3 unit, and the hash is then the placeholder's.  A
    name is a capitalised token that does not begin a text, a line or a sentence.
    """
    digit, part = _CLASS["digit"][data], _CLASS["token"][data]
    if len(data) > 2:
        point = np.zeros(len(data), bool)
        point[1:-1] = ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
        part, number = part | point, digit | point
    else:
        number = digit
    edge = np.flatnonzero((number[1:] != number[:-1]) & part[1:] & part[:-1]) + 1
    starts, ends = spans(part, np.union1d(offsets, edge))
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.int8), first
    folded = _CLASS["fold"][data]
    accent = np.zeros(len(data), bool)  # upper-case Latin letters of two bytes
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded = folded + np.where(accent, 0x20, 0).astype(np.uint8)
    hashes = hash_spans(folded, starts, ends)
    is_number = number[starts]
    capital = _CLASS["upper"][data[starts]] | accent[np.minimum(starts + 1, len(data) - 1)] & (data[starts] == 0xC3)
    stops = np.concatenate([[0], np.cumsum(_CLASS["stop"][data])])
    begins = np.ones(len(starts), bool)
    begins[1:] = stops[starts[1:]] > stops[ends[:-1]]
    begins[first[first < len(starts)]] = True
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = is_number[:-1]
    after_number[first[first < len(starts)]] = False
    slots = np.zeros(len(starts), np.int8)
    slots[capital & ~begins & ~is_number] = 2
    slots[after_number & np.isin(hashes, _unit_hashes())] = 3
    slots[is_number] = 1
    for kind, mark in ((1, NUMBER), (2, NAME), (3, UNIT)):
        hashes[slots == kind] = mark
    return starts, ends, hashes, slots, first


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return hash_spans(joined, np.concatenate([[0], ends[:-1]]), ends)


def _windows(rules: TemplateRules, bits=None):
    """Rows (h, id, pos, slots, n) for the windows of each text; with a filter, those that it has."""
    size, shift = rules.window, np.uint64(64 - rules.filter_bits)

    def has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = (h >> shift).astype(np.int64)
        return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else np.frombuffer(bits.value, np.uint64)
        for batch in pieces(batches, 1, 2 << 20):
            offsets, data = strings(batch.column(1))
            starts, ends, hashes, slots, first = template(data, offsets)
            h = window_hashes(hashes, size)
            if not len(h):
                continue
            filled = np.concatenate([[0], np.cumsum(slots > 0)])
            ok = whole_windows(first, size, len(hashes)) & (filled[size:] - filled[:-size] <= size - rules.min_literals)
            if table is not None:
                ok &= has(table, h)
            at = np.flatnonzero(ok)
            row = np.searchsorted(first, at, "right") - 1
            raw, values, counts = data.tobytes(), [], []
            for i in at:
                mine = np.flatnonzero(slots[i : i + size]) + i
                counts.append(len(mine))
                values += [raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in mine]
            totals = np.maximum(np.diff(first) - size + 1, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(h[at].view(np.int64)), batch.column(0).take(pa.array(row)),
                pa.array((at - first[row]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.string())),
                pa.array(totals[row].astype(np.int32)),
            ], ["h", "id", "pos", "slots", "n"])

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules(),
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it: the best aligned occurrence.

    The document windows pass a bit table of the benchmark's window hashes (fixed size, by
    ``filter_bits``; a fuller table only lets more through) before the hash join, so only
    windows that probably match are shuffled.  Groups are (document, item, alignment),
    each at most as long as the item.
    """
    schema = "h long, id long, pos int, slots array<string>, n int"
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    theirs = items.mapInArrow(_windows(rules), schema)
    at = F.shiftrightunsigned("h", 64 - rules.filter_bits)
    words = theirs.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - rules.filter_bits}) & 63 as int))").alias("bit"))
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (rules.filter_bits - 6), np.uint64)
    table[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    bits = spark.sparkContext.broadcast(table.tobytes())
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ours = texts.mapInArrow(_windows(rules, bits), schema).select("h", "id", "pos", "slots")
    theirs = theirs.select("h", F.col("id").alias("item"), F.col("pos").alias("ipos"), F.col("slots").alias("islots"), F.col("n").alias("n_item"))
    pairs = F.transform(F.arrays_zip("islots", "slots"), lambda z: F.struct(z["islots"].alias("was"), z["slots"].alias("now")))
    joined = ours.join(theirs, "h").select("id", "item", "ipos", "n_item", (F.col("pos") - F.col("ipos")).alias("shift"), pairs.alias("pairs"))
    aligned = joined.groupBy("id", "item", "shift").agg(
        F.size(F.collect_set("ipos")).alias("n_windows"), F.first("n_item").alias("n_item"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    values = F.size(F.array_distinct(F.transform("pairs", lambda z: z["was"])))
    changed = F.size(F.filter("pairs", lambda z: z["was"] != z["now"]))
    judged = aligned.select(
        "id", "item", "shift", "n_windows", "n_item", F.size("pairs").alias("n_slots"), changed.alias("n_changed"),
        F.when(F.size("pairs") == 0, 1.0).otherwise(values / F.size("pairs")).alias("consistency"),
    ).where((F.col("n_windows") >= F.least(F.lit(rules.min_windows), "n_item")) & (F.col("consistency") >= rules.min_consistency))
    best = judged.groupBy("id", "item").agg(F.max(F.struct(
        "n_windows", "consistency", (-F.col("n_changed")).alias("same"), (-F.col("shift")).alias("minus"), "n_item", "n_slots",
    )).alias("b"))
    return best.select(
        F.col("id").alias(doc_id), F.col("item").alias(item_id), F.greatest(-F.col("b.minus"), F.lit(0)).cast("long").alias("start_token"),
        F.col("b.n_windows").cast("long").alias("n_windows"), F.col("b.n_item").cast("long").alias("n_item_windows"),
        F.col("b.n_slots").cast("long").alias("n_slots"), (-F.col("b.same")).cast("long").alias("n_changed"),
        F.col("b.consistency").alias("slot_consistency"),
        F.when(F.col("b.same") < 0, "reparameterised").otherwise("copy").alias("kind"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """Documents in which no benchmark item was found; rows without an id stay."""
    hits = contaminated(docs, benchmark, rules).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])
