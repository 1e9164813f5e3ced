"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

Phrases grow one word at a time.  In the pass for ``m`` words every task folds its texts into
stripes, one per (language, prefix of ``m - 1`` words): how often each word follows, and how
often nothing follows that can count.  Stripes of one prefix are merged element by element
after a shuffle on the prefix.  A merged stripe gives

* the phrases that extend its prefix, with their counts (its entries);
* the total of the prefix (the sum of all entries and of the rest);
* the largest entry, which subsumes the prefix if it comes close to the total.

A phrase that occurs ``least`` times holds only phrases that do, so the pass for ``m`` words
looks at places whose first and last ``m - 1`` words passed the pass before.  They are
told by a table of hashed bits of a bounded size, sent to all tasks: a bit that stands for
two phrases lets a place through that is then counted exactly, and loses none.

Hot prefixes: those with a large share of all words, and the empty prefix of the first pass,
are split by a hash of the next word, so that no task merges more than a bounded share of a
stripe.  Merging goes through the sorted stripes one key at a time.

Cases: a null text is empty, a null language is ``und``; rows count each, repeated or not, and
need no id; an empty table, or one without words, gives no rows; a text of any length is read
whole; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import pieces, written
from palisade.llm.words import mix

SLICE = 8 << 20  # bytes of text folded at a time
SPLITS = 64  # parts of a hot stripe
HOT_SHARE = 2000  # a prefix with more than this part of all words is hot, so there are fewer than this many
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28  # bits of the table per phrase; its size as a power of two, 32 MB at most
TOP_SPLITS = 64
STRIPE = "lang string, prefix string, part int, rest long, words array<string>, counts array<long>"

# What ends a piece, what parts words inside one.  BREAK stands for the end of a piece.
ENDS, GAPS, BREAK = b".,;:!?\n\x0b\x0c\r", b" \t", b"."
_CLEAN = bytes(0x20 if c in GAPS else 0x2E if c in ENDS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


class Numbers(dict):
    """Numbers words in the order they are met; the break is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode()))


def chained(first: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + following)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def phrase_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of ``size`` words at every place that has so many."""
    h = words
    for k in range(1, size):
        h = chained(h[:-1], words[k:])
    return h


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """One number for each pair (a, b) with b below n."""
    if len(a) and int(a.max()) >= (1 << 62) // max(n, 1):
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * n + b


class Folder:
    """Folds texts of one language into the stripes of one pass."""

    def __init__(self, size: int, bits: int, table: np.ndarray | None, hot: dict[str, set[str]]):
        self.size, self.bits, self.table, self.hot = size, bits, table, hot

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        at = slots(hashes, self.bits)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def fold(self, lang: str, text: bytes) -> pa.RecordBatch | None:
        number = Numbers()
        words = text.translate(_CLEAN).replace(BREAK, b" . ").split(b" ")
        ids = np.fromiter(map(number.__getitem__, filter(None, words)), np.int64)
        del words
        if len(ids) < self.size:
            return None
        known = list(number)
        if self.size == 1:
            at, open_ = np.flatnonzero(ids != 0), None
        else:
            hashes = np.fromiter((word_hash(lang, w) for w in known), np.uint64, len(known))[ids]
            m = self.size - 1
            whole = np.convolve(ids != 0, np.ones(m, np.int64), "valid") == m
            pass_ = whole & self.passed(phrase_hashes(hashes, m))
            at = np.flatnonzero(pass_)
            open_ = np.r_[pass_[1:], False][at]  # the phrase that starts one word later passes too
        if not len(at):
            return None
        n = len(known)
        prefix = np.zeros(len(at), np.int64)
        for k in range(self.size - 1):
            prefix = joined(prefix, ids[at + k], n)
        after = ids[at] if self.size == 1 else np.where(open_, ids[np.minimum(at + self.size - 1, len(ids) - 1)], 0)
        cell, first, count = np.unique(joined(prefix, after, n), return_index=True, return_counts=True)
        words = pa.array(known, pa.binary()).cast(pa.string())
        order = at[first]
        heads = [words.take(pa.array(ids[order + k])) for k in range(self.size - 1)]
        return self._stripes(lang, heads, prefix[first], after[first], count, words, known)

    def _stripes(self, lang, heads, prefix, after, count, words, known) -> pa.RecordBatch:
        text = heads[0] if len(heads) == 1 else pc.binary_join_element_wise(*heads, " ") if heads else pa.array([""] * len(prefix), pa.string())
        if self.size == 1:
            split = np.ones(len(prefix), bool)
        elif hot := self.hot.get(lang):
            split = pc.is_in(text, pa.array(sorted(hot))).to_numpy(zero_copy_only=False)
        else:
            split = np.zeros(len(prefix), bool)
        part = np.zeros(len(prefix), np.int64)
        if split.any():
            of_word = np.fromiter((1 + xxhash.xxh32_intdigest(w) % SPLITS for w in known), np.int64, len(known))
            part[split] = of_word[after[split]]
        order = np.lexsort((after, part, prefix))
        prefix, part, after, count = prefix[order], part[order], after[order], count[order]
        starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        rest = np.add.reduceat(np.where(after == 0, count, 0), starts)
        kept = after != 0
        ends = np.r_[0, np.cumsum(np.add.reduceat(kept.astype(np.int64), starts))].astype(np.int32)
        values = words.take(pa.array(after[kept]))
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(starts), pa.string()), text.take(pa.array(order[starts])), pa.array(part[starts], pa.int32()), pa.array(rest, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), values), pa.ListArray.from_arrays(pa.array(ends), pa.array(count[kept], pa.int64())),
        ], ["lang", "prefix", "part", "rest", "words", "counts"])


def _folded(size: int, bits: int, table, hot: dict[str, set[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(size, bits, None if table is None else np.frombuffer(table.value, np.uint8), hot)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def fold(lang: str) -> Iterator[pa.RecordBatch]:
            out = folder.fold(lang, b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            for at in range(0, out.num_rows if out is not None else 0, 50_000):
                yield out.slice(at, 50_000)

        for batch in pieces(batches, 1, SLICE):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if body := (text.as_py() or "").encode():
                    held.setdefault(lang, []).append(body)
                    sizes[lang] = sizes.get(lang, 0) + len(body)
                    if sum(sizes.values()) >= SLICE:
                        yield from fold(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from fold(lang)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Equal keys are neighbours: their stripes added up element by element, keys and words in the order met."""
    keys = [table.column(c).combine_chunks() for c in ("lang", "prefix", "part")]
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        new |= pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    new = np.r_[True, new]
    run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    rest = np.add.reduceat(table.column("rest").to_numpy(), starts)
    words, counts = table.column("words").combine_chunks(), table.column("counts").combine_chunks()
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    flat = pa.table({"run": pa.array(np.repeat(run, lengths)), "word": words.flatten(), "n": counts.flatten()})
    summed = flat.group_by(["run", "word"], use_threads=False).aggregate([("n", "sum")])
    of = summed.column("run").to_numpy()
    order = np.argsort(of, kind="stable")
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(starts)))].astype(np.int32))
    at = pa.array(starts)
    return pa.table({
        **{c: key.take(at) for c, key in zip(("lang", "prefix", "part"), keys)}, "rest": pa.array(rest),
        "words": pa.ListArray.from_arrays(ends, summed.column("word").combine_chunks().take(pa.array(order))),
        "counts": pa.ListArray.from_arrays(ends, summed.column("n_sum").combine_chunks().take(pa.array(order))),
    })


def _merged(least: int):
    """Merge sorted stripes and keep the entries that occur ``least`` times; ``total`` and ``largest`` of each."""

    def finish(stripes: pa.Table) -> pa.RecordBatch:
        counts, words = stripes.column("counts").combine_chunks(), stripes.column("words").combine_chunks()
        ends, values = counts.offsets.to_numpy(), counts.flatten().to_numpy()
        sums = np.r_[0, np.cumsum(values)]
        total = stripes.column("rest").to_numpy() + sums[ends[1:]] - sums[ends[:-1]]
        keep = values >= least
        kept = np.r_[0, np.cumsum(keep)][ends]
        held = kept[1:] - kept[:-1]
        largest = np.zeros(len(total), np.int64)
        if keep.any():
            largest[held > 0] = np.maximum.reduceat(values[keep], kept[:-1][held > 0])
        batch = pa.table({
            "lang": stripes.column("lang"), "prefix": stripes.column("prefix"), "total": pa.array(total), "largest": pa.array(largest),
            "words": pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.flatten().filter(pa.array(keep))),
            "counts": pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(values[keep])),
        })
        # A part of a split stripe counts towards the whole, however small it is.
        useful = batch.filter(pa.array((total >= least) | (stripes.column("part").to_numpy() > 0))).combine_chunks()
        return useful.to_batches()[0] if useful.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            now = _merge(pa.concat_tables([open_, table]) if open_ is not None else table)
            # The last key may go on in the next batch.
            if now.num_rows > 1 and (out := finish(now.slice(0, now.num_rows - 1).combine_chunks())) is not None:
                yield out
            open_ = now.slice(now.num_rows - 1).combine_chunks()
        if open_ is not None and (out := finish(open_)) is not None:
            yield out

    return run


MERGED = "lang string, prefix string, total long, largest long, words array<string>, counts array<long>"


def stripes(docs: DataFrame, size: int, least: int, bits: int, table, hot: dict[str, set[str]], lang: str, text: str) -> DataFrame:
    """Merged stripes of one pass, a written table (a hot prefix has a row for each of its parts)."""
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    folded = rows.mapInArrow(_folded(size, bits, table, hot), STRIPE)
    keys = ["lang", "prefix", "part"]
    merged = folded.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(least), MERGED)
    return written(merged, f"stripes-{size}")


def entries(merged: DataFrame) -> DataFrame:
    """``lang``, ``prefix``, ``word``, ``n``: phrases that occur often enough."""
    cell = F.explode(F.arrays_zip("words", "counts")).alias("cell")
    return merged.select("lang", "prefix", cell).select("lang", "prefix", F.col("cell.words").alias("word"), F.col("cell.counts").alias("n"))


def phrase_of(prefix: str = "prefix", word: str = "word"):
    return F.when(F.col(prefix) == "", F.col(word)).otherwise(F.concat_ws(" ", prefix, word))


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.array([word_hash(lang, w) for w in phrase.encode().split(b" ")], np.uint64)
                found.append(phrase_hashes(words, len(words))[0])
            at = slots(np.array(found, np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["place", "bit"])

    return run


def bit_table(phrases: DataFrame) -> tuple[int, bytes]:
    """Bits of the hashes of (lang, phrase) rows; the table has 2 ** bits of them, by the number of phrases up to a bound.

    Bits are or-ed in tasks and by place; at most ``2 ** MOST_BITS / 64`` rows reach the driver.
    """
    n = phrases.count()
    bits = max(LEAST_BITS, min(MOST_BITS, (n * BITS_EACH).bit_length()))
    words = phrases.mapInArrow(_slots(bits), "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[words.column("place").to_numpy()] = words.column("bit").to_numpy()
    return bits, table.tobytes()


def collocations(docs: DataFrame, least: int = 30, most_words: int = 4, best: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases of two and more words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all
    words of the language; the score is ``2000000 * a / (l + r)``, rounded down.  A phrase
    goes if a longer one that holds it occurs at least four fifths as often.
    """
    spark = docs.sparkSession
    levels = [stripes(docs, 1, least, 0, None, {}, lang, text)]
    totals = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    every = totals.agg(F.sum("n")).first()[0] or 0
    for size in range(2, most_words + 1):
        before = entries(levels[-1]).select("lang", phrase_of().alias("phrase"), "n")
        bits, table = bit_table(before.select("lang", "phrase"))
        hot: dict[str, set[str]] = {}
        for row in before.where(F.col("n") * HOT_SHARE > every).collect():  # fewer than HOT_SHARE for each length
            hot.setdefault(row["lang"], set()).add(row["phrase"])
        sent = spark.sparkContext.broadcast(table)
        levels.append(stripes(docs, size, least, bits, sent, hot, lang, text))
        sent.unpersist()

    counts = None
    for merged in levels:
        rows = entries(merged).select("lang", phrase_of().alias("phrase"), "prefix", "n")
        counts = rows if counts is None else counts.unionByName(rows)
    counts = written(counts.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")), "phrases")
    candidates = counts.where("size > 1")

    cut = candidates.select("lang", "phrase", "words", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cut = cut.withColumns({
        "left": F.array_join(F.slice("words", F.lit(1), F.col("cut")), " "),
        "right": F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " "),
    })
    # The left part that ends before the last word is the stripe's own prefix: its total is at hand.
    sums = levels[1].select("lang", "prefix", "total")
    for merged in levels[2:]:
        sums = sums.unionByName(merged.select("lang", "prefix", "total"))
    sums = sums.groupBy("lang", F.col("prefix").alias("left")).agg(F.sum("total").alias("l"))
    parts = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cut.join(sums, ["lang", "left"]).join(parts, ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    scored = scored.withColumn("score", F.call_function("div", big("a") * F.lit(2_000_000), big("l") + big("r")).cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))

    # One word longer is enough to ask: what holds a phrase inside a still longer one is as frequent as that.
    longer = levels[2].select("lang", F.col("prefix").alias("phrase"), F.col("largest").alias("most")) if most_words > 2 else None
    for merged in levels[3:]:
        longer = longer.unionByName(merged.select("lang", F.col("prefix").alias("phrase"), F.col("largest").alias("most")))
    if longer is not None:
        tail = F.array_join(F.slice("words", F.lit(2), F.col("size") - 1), " ")
        longer = longer.unionByName(candidates.where("size > 2").select("lang", tail.alias("phrase"), F.col("n").alias("most")))
        longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        held = lowest.join(longer, ["lang", "phrase"], "left")
        lowest = held.where(F.coalesce(big("most") * 100 < big("a") * 80, F.lit(True)))

    order = [F.desc("score"), F.desc("a"), "phrase"]
    flat = lowest.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    # First inside parts of a language, then among what is left of each.
    part = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SPLITS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return top.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
