"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first scatters shingles over a
circle of positions; the second, fixed for the whole corpus, is read from there in
circular order, so coordinate k of a shingle is the second permutation shifted by k.

Cases: a text of fewer words than a shingle has its whole sequence as one shingle; null,
empty and blank texts have an empty set and are linked with nothing; texts with equal
sets are one class; rows that repeat an id are the same document; a row without an id is
linked with nothing (component null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import components, pieces, strings, trees, written
from palisade.llm.words import TO_LOWER, hash_spans, mix, window_hashes, whole_windows, words

CIRCLE_BITS = 22
HUB_ROUNDS = 2
BANDS, ROWS = 32, 5  # a pair of similarity 0.8 shares no band with probability 0.672**32 = 3e-6


@functools.cache
def _circle(coordinates: int, seed: int) -> np.ndarray:
    """The second permutation, read onward from each position (a view: one row per position)."""
    order = np.random.default_rng(seed).permutation(1 << CIRCLE_BITS).astype(np.uint32)
    round_trip = np.concatenate([order, order[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(round_trip, coordinates)[: 1 << CIRCLE_BITS]


def signature(shingles: np.ndarray, coordinates: int, seed: int = 11) -> np.ndarray:
    """Circulant MinHash signature of a nonempty set of 64-bit shingle hashes."""
    circle = _circle(coordinates, seed)
    at = (mix(shingles ^ np.uint64(seed)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(least, circle[at[i : i + 4096]].min(axis=0), out=least)
    return least


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column, A-Z lower-cased."""
    offsets, data = strings(column)
    data = TO_LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = hash_spans(data, starts, ends)
    windows = window_hashes(hashes, size)
    for row in range(len(first) - 1):
        a, b = first[row], first[row + 1]
        if b - a >= size:
            found = np.sort(windows[a : b - size + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        else:
            yield window_hashes(hashes[a:b], b - a, seed=int(b - a)) if b > a else hashes[:0]


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches, 1):
            prints, counts, signed = [], [], []
            for found in shingle_sets(batch.column(1), size):
                counts.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if len(found):
                    signed.append(signature(found, bands * rows))
            keys = np.zeros((len(signed), bands), np.uint64)
            if signed:
                table = np.stack(signed).reshape(len(signed), bands, rows).astype(np.uint64)
                keys[:] = mix(np.arange(1, bands + 1, dtype=np.uint64))
                for r in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, :, r])
            ends = np.concatenate([[0], np.cumsum([bands * (c > 0) for c in counts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), lists], ["id", "fp", "n", "bands"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = list(shingle_sets(batch.column(1), size))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"]
            )

    return run


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least id reachable), kept.

    Links hold where 100 * |intersection| >= percent * |union| on the full sets.  Equal
    sets become one class first, so copies never meet each other.  Then every class is
    compared with one pivot, the class with most company in its bands; that makes near
    copies one component.  Candidate pairs that are still apart are compared too, except
    those whose overlaps with a common pivot prove that they cannot be linked: first each
    class with one hub of what it shares with others outside the pivot, for some rounds, so
    that variants of one text join without meeting pair by pair; then all that is left.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(source.mapInArrow(_sign(shingle, bands, rows), "id long, fp binary, n long, bands array<long>"), "minhash")
    classes = signed.where("fp is not null and id is not null").groupBy("fp").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = written(banded.join(crowded, "key"), "bands")
    degree = members.groupBy("rep").agg(F.sum("crowd").alias("degree"), F.first("n").alias("n"))
    ranked = members.select("key", "rep").join(degree, "rep")
    best = F.struct("degree", (-F.col("rep")).alias("minus"), "n")
    pivots = ranked.groupBy("key").agg(F.max(best).alias("p"))
    near = (F.least("n", F.col("p.n")) * 100 >= F.greatest("n", F.col("p.n")) * percent) & (F.col("rep") != -F.col("p.minus"))
    stars = written(members.select("key", "rep", "n").join(pivots, "key").where(near).select("rep", "p").distinct(), "stars")

    fetch = members.select(F.col("rep").alias("id")).distinct()
    sets = written(source.join(fetch, "id").mapInArrow(_sets(shingle), "id long, shingles array<long>"), "shingles")

    def with_sets(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(one, "a").join(two, "b")

    def overlaps(pairs: DataFrame) -> DataFrame:
        """``a, b, i, s``: size of the intersection, and of both full sets together."""
        return with_sets(pairs).select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("s"))

    enough = lambda i, s: i * (100 + percent) >= s * percent
    first = stars.groupBy("rep").agg(F.max("p").alias("p")).select(F.col("rep").alias("a"), (-F.col("p.minus")).alias("b"))
    scored = written(overlaps(first), "overlaps")
    links = scored.where(enough(F.col("i"), F.col("s"))).select("a", "b")
    label = trees(links)  # each class has one pivot, which has more company than itself

    # Every class with its pivot (itself, if it has none), their overlap and Jaccard distance.
    away = 1 - F.col("i") / (F.col("s") - F.col("i"))
    placed = degree.select("rep", "n").join(scored.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "i", away.alias("away")), "rep", "left")
    placed = written(placed.select(
        "rep", "n", F.coalesce("pivot", "rep").alias("pivot"), F.coalesce("i", "n").alias("i"), F.coalesce("away", F.lit(0.0)).alias("away")
    ), "placed")
    split = written(_split_bands(members, _labelled(placed, label)), "split")
    outside = written(_outside_pivot(split, with_sets), "outside")
    residue = written(_prefixes(_labelled(outside, label), percent), "residue")
    tried = scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def untried(pairs: DataFrame, name: str) -> DataFrame:
        known = tried.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
        new = (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi"))
        return written(pairs.distinct().join(known, new, "left_anti"), name)

    def linked(pairs: DataFrame) -> DataFrame:
        return written(overlaps(pairs).where(enough(F.col("i"), F.col("s"))), "links")

    for _ in range(HUB_ROUNDS):
        pairs = _hub_pairs(residue, enough).unionByName(_band_hub_pairs(split, percent))
        pairs = untried(pairs, "hubs")
        if pairs.isEmpty():
            break
        more = linked(pairs)
        tried = tried.unionByName(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        joined = _joined(label, more.select("a", "b"))
        if joined is None:
            break
        label = joined
        placed = written(_placed_again(placed, more.select("a", "b", "i", away.alias("away"))), "placed")
        split = written(_split_bands(members, _labelled(placed, label)), "split")
        residue = written(_prefixes(_labelled(outside, label), percent), "residue")
    # Distances between the pivots that meet in a split band bound those between their members.
    met = written(_meeting_pivots(split), "pivots")
    ends = met.select("p", "q").distinct()
    between = written(overlaps(ends.toDF("a", "b")), "between")
    joined = _joined(label, between.where(enough(F.col("i"), F.col("s"))).select("a", "b"))
    if joined is not None:
        label = joined
        split = written(_split_bands(members, _labelled(placed, label)), "split")
        residue = written(_prefixes(_labelled(outside, label), percent), "residue")
    met = written(met.join(between.select(F.col("a").alias("p"), F.col("b").alias("q"), away.alias("between")), ["p", "q"]), "distances")
    rest = _apart_of_one_pivot(split, percent, enough).unionByName(_apart_of_two_pivots(split, met, percent))
    rest = untried(rest.unionByName(_apart_in_residue(residue, enough)), "apart")
    if not rest.isEmpty():
        label = _joined(label, linked(rest).select("a", "b")) or label

    found = classes.select("fp", "rep").join(label.toDF("rep", "component"), "rep", "left")
    found = found.select("fp", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.select("id", "n", "fp").join(found, "fp", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )


def _split_bands(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Members of bands that hold more than one component; ``top`` is the largest one's name, ``hrep`` its least class."""
    known = members.select("key", "rep").join(placed, "rep")
    parts = known.groupBy("key", "component").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("hub"))
    top = parts.groupBy("key").agg(F.max(F.struct("c", "component", "hub")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    hub = (F.col("top.hub.rep").alias("hrep"), F.col("top.hub.n").alias("hn"))
    return known.join(top.select("key", F.col("top.component").alias("top"), *hub), "key")


_NAMES = ("rep", "n", "pivot", "i", "away", "component")
SLACK = 1e-9  # of distances in double precision


def _outside_first(split: DataFrame) -> DataFrame:
    """The members that are not in the band's largest component, named with an x."""
    return split.where("component != top").select("key", *[F.col(c).alias(c + "x") for c in _NAMES])


def _pair_apart(percent: int):
    """Of the largest component's members each pair comes once, of the others' by order."""
    once = (F.col("component") == F.col("top")) | (F.col("repx") < F.col("rep"))
    return (F.col("component") != F.col("componentx")) & once & (F.least("n", "nx") * 100 >= F.greatest("n", "nx") * percent)


def _apart_of_one_pivot(split: DataFrame, percent: int, enough) -> DataFrame:
    """Pairs that share a band and a pivot P, and are apart.

    |A & B| is at most the lesser overlap with P plus what they share outside P; without the
    latter (see ``_apart_in_residue``) the lesser overlap must be enough.
    """
    able = enough(F.col("i"), F.col("n") * (100 + percent) / 100)  # with the smallest partner there can be
    pairs = _outside_first(split.where(able)).withColumnRenamed("pivotx", "pivot").join(split.where(able), ["key", "pivot"])
    pairs = pairs.where(_pair_apart(percent) & enough(F.least("i", "ix"), F.col("n") + F.col("nx")))
    return pairs.select(F.least("repx", "rep").alias("a"), F.greatest("repx", "rep").alias("b"))


def _meeting_pivots(split: DataFrame) -> DataFrame:
    """``key, p, q``: two pivots with members in one band, and how far their members are from them at most."""
    of = split.groupBy("key", "pivot").agg(F.max("away").alias("far"))
    other = of.select("key", F.col("pivot").alias("q"), F.col("far").alias("farq"))
    return of.select("key", F.col("pivot").alias("p"), F.col("far").alias("farp")).join(other, "key").where("p < q")


def _apart_of_two_pivots(split: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a band, have other pivots P and Q and are apart.

    Jaccard distance is a metric, so A and B are at least as far apart as P and Q are, less
    the ways from A to P and from B to Q.  Members that this rules out meet nobody.
    """
    most = 1 - percent / 100 + SLACK
    both = met.unionByName(met.select(F.col("q").alias("p"), F.col("p").alias("q"), "key", F.col("farq").alias("farp"), F.col("farp").alias("farq"), "between"))
    near = _outside_first(split).join(both.withColumnRenamed("p", "pivotx"), ["key", "pivotx"]).where(F.col("between") - F.col("awayx") - F.col("farq") <= most)
    near = near.select("key", F.col("q").alias("pivot"), (F.col("between") - F.col("awayx")).alias("left"), "repx", "nx", "componentx")
    pairs = near.join(split, ["key", "pivot"]).where(_pair_apart(percent) & (F.col("left") - F.col("away") <= most))
    return pairs.select(F.least("repx", "rep").alias("a"), F.greatest("repx", "rep").alias("b"))


def _placed_again(placed: DataFrame, more: DataFrame) -> DataFrame:
    """Hubs become pivots: of the classes linked to them, and of themselves."""
    hubs = more.select(F.col("b").alias("rep")).distinct().withColumn("own", F.lit(True))
    moved = more.groupBy("a").agg(F.min(F.struct("away", "b", "i")).alias("to")).withColumnRenamed("a", "rep")
    both = placed.join(hubs, "rep", "left").join(moved, "rep", "left")
    pick = lambda own, to, old: F.when(F.col("own"), own).otherwise(F.coalesce(to, old))
    return both.select(
        "rep", "n", pick(F.col("rep"), F.col("to.b"), F.col("pivot")).alias("pivot"), pick(F.col("n"), F.col("to.i"), F.col("i")).alias("i"),
        pick(F.lit(0.0), F.col("to.away"), F.col("away")).alias("away"),
    )


def _joined(label: DataFrame, more: DataFrame) -> DataFrame | None:
    """Components after some more links, or None if all of these lie inside components.

    Only components that the links join are named again.
    """
    known = label.toDF("node", "component")
    ends = more.join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left")
    ends = written(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"), "joins")
    if ends.isEmpty():
        return None
    fresh = components(ends)
    moved = known.join(fresh.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(fresh.join(known, "node", "left_anti").select("node", "component")), "components")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component that each ``rep`` is in by now."""
    return rows.drop("component").join(label.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _outside_pivot(split: DataFrame, with_sets) -> DataFrame:
    """The shingles of each class that its pivot lacks."""
    own = split.select("rep", "n", "pivot", "i").distinct().where("rep != pivot")
    return with_sets(own.withColumnsRenamed({"rep": "a", "pivot": "b"})).select(
        F.col("a").alias("rep"), "n", F.col("b").alias("pivot"), "i", F.explode(F.array_except("sa", "sb")).alias("shingle")
    )


def _prefixes(outside: DataFrame, percent: int) -> DataFrame:
    """Of each class, the shingles outside its pivot that a partner of another component must meet.

    A partner B of A needs an overlap of at least ``percent`` of |A|; their common shingles
    inside the pivot P are at most |A & P|, so at least ``q = percent * |A| / 100 - |A & P|`` lie
    outside.  Shingles are ordered by how many classes of the pivot have them, those that
    can't join two components first; two sets with q common ones share one that is not among
    the last q - 1 of either.  ``shared`` is how many of the class's shingles can join at all.
    """
    held = outside.groupBy("pivot", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("f"))
    common = outside.join(held.where("lo < hi").select("pivot", "shingle", "f"), ["pivot", "shingle"])
    of = Window.partitionBy("rep")
    common = common.withColumns({"shared": F.count("*").over(of), "place": F.row_number().over(of.orderBy("f", "shingle"))})
    q = F.greatest(F.ceil(F.col("n") * percent / 100) - F.col("i"), F.lit(1))
    return common.where(F.col("place") <= F.col("shared") - q + 1).select("rep", "n", "pivot", "i", "shared", "component", "shingle")


_OWN = ("rep", "n", "i", "shared")


def _may_link(enough, x: str):
    """Whether a pair with one pivot can overlap enough, by what each has inside and outside of it."""
    inside, outside = F.least("i", f"{x}i"), F.least("shared", f"{x}shared")
    return enough(inside + outside, F.col("n") + F.col(f"{x}n"))


def _hub_pairs(keyed: DataFrame, enough) -> DataFrame:
    """At most one pair per class: with the hub that it shares most shingles with, of those in other components.

    The hub of a (pivot, shingle) is the least class of the component with most members there.
    """
    parts = keyed.groupBy("pivot", "shingle", "component").agg(F.count("*").alias("c"), F.min(F.struct(*_OWN)).alias("hub"))
    tops = parts.groupBy("pivot", "shingle").agg(F.max(F.struct("c", "component", "hub")).alias("top"), F.count("*").alias("parts"))
    tops = tops.where("parts > 1").select("pivot", "shingle", F.col("top.component").alias("top"), *[F.col(f"top.hub.{c}").alias(f"h{c}") for c in _OWN])
    met = keyed.join(tops, ["pivot", "shingle"]).where((F.col("component") != F.col("top")) & _may_link(enough, "h"))
    return _best_hub(met)


def _best_hub(met: DataFrame) -> DataFrame:
    """The hub that each class met most often.  A class meets one hub per shingle or band of its own: no key is hot."""
    met = met.select("rep", "hrep").repartition("rep").groupBy("rep", "hrep").agg(F.count("*").alias("c"))
    return met.groupBy("rep").agg(F.max(F.struct("c", "hrep")).alias("best")).select(F.col("rep").alias("a"), F.col("best.hrep").alias("b"))


def _band_hub_pairs(split: DataFrame, percent: int) -> DataFrame:
    """The same over bands: each class outside a band's largest component with the least class of that, one hub each."""
    met = split.where("component != top").where(F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent)
    return _best_hub(met.where("rep != hrep"))


def _apart_in_residue(keyed: DataFrame, enough) -> DataFrame:
    """Pairs with one pivot that are apart, meet outside it and can overlap enough."""
    other = keyed.select("pivot", "shingle", *[F.col(c).alias("x" + c) for c in (*_OWN, "component")])
    met = keyed.join(other, ["pivot", "shingle"]).where((F.col("rep") < F.col("xrep")) & (F.col("component") != F.col("xcomponent")) & _may_link(enough, "x"))
    return met.select(F.col("rep").alias("a"), F.col("xrep").alias("b")).distinct()


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Documents that are the least of their component; rows without an id stay."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])
