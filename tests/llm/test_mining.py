"""Hard negatives, collocations and shards against brute force."""

import glob
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from palisade.llm import collocation, hardneg, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations", "op13_hilbert_shards"])
def test_query_matches_oracle(spark, name):
    assert difference(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


# ---- hard negatives


def test_index_omits_dimensions_and_finds_every_pair():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(600, 20)) * np.linspace(1, 0.05, 20))
    y = np.floor(256 * rng.normal(size=(30, 20)) * np.linspace(1, 0.05, 20))
    edges = [0, 8, 16, 20]
    xn, yn = hardneg.suffix_norms(x, edges), hardneg.suffix_norms(y, edges)
    scores = x @ y.T
    for share in (0.999, 0.99, 0.9, 0.5, 0.0):
        t = np.quantile(scores, share, axis=0)
        index = hardneg.Index(x, xn, edges, float(t.min()), yn.max(axis=0))
        row, col, score = index.search(y, yn, t)
        assert set(zip(row.tolist(), col.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(scores >= t))))
        assert (score == scores[row, col]).all()
        if share == 0.999:
            assert (index.depth < 3).mean() > 0.5
    everything = hardneg.Index(x, xn, edges, -np.inf, yn.max(axis=0)).search(y, yn, np.full(30, -np.inf))
    assert len(everything[0]) == scores.size


def brute_negatives(rows, every, positives, negatives, low, high):
    seen = {(i, lab, tuple(q)) for i, lab, q in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, lab, q in sorted(seen):
        if i % every == 0:
            anchors.setdefault(i, (lab, q))
    out = []
    for a, (lab, q) in anchors.items():
        scored = [(-dot(q, v), i, o) for i, o, v in seen if i != a]
        near = sorted((s, i) for s, i, o in scored if o == lab)[:positives]
        for p, pid in near:
            window = sorted((s, i) for s, i, o in scored if o != lab and low * -p <= 100 * -s <= high * -p)[:negatives]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("cell_values", [64 * 6, 1 << 21])
def test_hard_negatives_equal_brute_force(spark, cell_values):
    rng = random.Random(3)
    centre = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(700):
        lab = rng.randrange(4)
        rows.append((i, [float(np.float32(c + rng.gauss(0, 0.4))) for c in centre[lab]], lab, "x", i))
    rows += rows[:50]  # repeated rows
    rows += [(9, [0.1] * 6, 2, "x", 1), (20, [0.5] * 3, 1, "y", 2)]  # a repeated id, a shorter vector
    bad = [
        (None, [1.0] * 6, 1, "x", 1), (1001, None, 1, "x", 1), (1002, [1.0, None], 1, "x", 1), (1003, [1.0, float("nan")], 1, "x", 1),
        (1004, [float("inf")] * 6, 1, "x", 1), (1005, [1.0] * 6, None, "x", 1), (1006, [1e30] * 6, 1, "x", 1), (1010, [], 1, "x", 1),
    ]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, q string, id long")
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab, _, _ in rows + [(1010, [], 1, "x", 1)]]
    got = hardneg.hard_negatives(hardneg.quantised(df, 256), 10, 5, 10, 30, 90, cell_values=cell_values)
    got = sorted(tuple(r) for r in got.collect())
    want = brute_negatives(whole, 10, 5, 10, 30, 90)
    assert got == want and len(got) > 1000


def test_hard_negatives_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(hardneg.quantised(empty, 256), 10, 5, 10, 30, 90).collect() == []
    # Negative and zero scores of positives: no window, and one that holds zeros only.
    some = spark.createDataFrame(
        [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [1.0, 0.0], 2), (10, [1.0, 0.0], 3), (11, [-1.0, 0.0], 3)],
        "vec_id long, embedding array<double>, label int",
    )
    got = hardneg.hard_negatives(hardneg.quantised(some, 256), 10, 5, 10, 30, 90).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 0, 0)]


def test_whole_scores_beyond_double_precision(spark):
    rows = [(0, [100_000.25, 99_999.5], 1), (1, [100_000.0, 3.0], 1), (2, [60_000.0, 17.0], 2), (3, [60_000.0, 17.00390625], 2)]
    big = [(i, [x * 50 for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hardneg.hard_negatives(hardneg.quantised(df, 256), 10, 5, 10, 30, 90).collect())
    assert got == brute_negatives([(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in big], 10, 5, 10, 30, 90) and got


# ---- collocations


def brute_collocations(rows, least, most, best):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and inside(q) and 100 * b >= 80 * a for q, b in cand.items()):
                continue
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(8)
    vocab = ["The", "the", "a", "über", "\x1cx", "x\x85y", "b", "c", "new", "york", "city", " "]
    text = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", "!", " ? "]) for _ in range(rng.randrange(1, 60)))
    rows = [(rng.choice(["en", "de", None, "", "q r"]), text()) for _ in range(250)]
    rows += [("en", "new york city hall is in new york city " * 40), ("en", "a " * 3000), ("xx", None), ("xx", ""), ("xx", " .\t,\n"), (None, "new york"), ("en", None)]
    return rows + rows[:20]


def as_documents(spark, rows):
    full = [(None if k % 9 == 0 else k, t, lang, "p", k) for k, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, prefix string, n long")


@pytest.mark.parametrize("best", [2000, 3])
def test_collocations_equal_brute_force(spark, best, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocation, "HOT_SHARE", 20)  # split stripes of frequent prefixes
    got = sorted(tuple(r) for r in collocation.collocations(as_documents(spark, rows).repartition(5), least=4, best=best).collect())
    assert got == brute_collocations(rows, 4, 4, best) and len({r[0] for r in got}) >= 4


@pytest.mark.parametrize("bits", [2, 28])
def test_a_full_or_roomy_bit_table_changes_nothing(spark, bits, monkeypatch):
    monkeypatch.setattr(collocation, "LEAST_BITS", max(bits, 6))
    monkeypatch.setattr(collocation, "MOST_BITS", max(bits, 6))
    rows = phrase_rows()[:120]
    got = sorted(tuple(r) for r in collocation.collocations(as_documents(spark, rows), least=5, best=50).collect())
    assert got == brute_collocations(rows, 5, 4, 50)


def test_collocations_of_no_rows_and_short_lengths(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocation.collocations(empty, least=2).collect() == []
    rows = [("en", "a b c a b c a b")]
    got = sorted(tuple(r) for r in collocation.collocations(as_documents(spark, rows), least=2, most_words=2).collect())
    assert got == brute_collocations(rows, 2, 2, 2000)


def test_stripes_merge_across_batches(spark):
    """A key whose stripes fill several batches is still one stripe."""
    rows = [("en", " ".join(f"hub w{i % 40}." for i in range(k, k + 30))) for k in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(r) for r in collocation.collocations(as_documents(spark, rows).repartition(16), least=30).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_collocations(rows, 30, 4, 2000) and len(got) == 40


# ---- shards


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_each_cell_once_and_moves_to_neighbours(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    rows = df.select("*", sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(cells)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def odd_documents(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 300), rng.choice(["en", "de", None]), f"s{rng.randrange(30)}") for i in range(300)]
    rows += [(7, "same text", "en", "hot")] * 200 + [(None, None, None, None), (None, "", "en", ""), (301, "z" * 400_000, "fr", "s1")]
    return spark.createDataFrame([(*r, 5, "law", 1) for r in rows], "doc_id long, text string, lang string, source string, shard int, law string, sh_tie int")


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_keep_their_law_with_ties_nulls_and_clashing_names(spark, law):
    docs = odd_documents(spark)
    rows = sharding.document_rows(docs, also=("lang", "source", "shard", "law", "sh_tie"))
    out = sharding.shard_rows(rows, ("lang", "source", "size"), "doc_id", "size", 16, law).collect()
    assert len(out) == 503 and {r.law for r in out} == {law} and all(r.sh_tie == 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    line = [(r.hilbert, -1 if r.doc_id is None else r.doc_id) for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert line == sorted(line)
    if law == "rows":
        assert set(by) == set(range(16)) and {len(p) for p in by.values()} == {31, 32}
    else:
        total, longest = sum(r.size for r in out), max(r.size for r in out)
        assert all(sum(r.size for r in p) <= total / 16 + longest for p in by.values())


def test_levels_share_rows_equally_and_nulls_are_least(spark):
    rows = spark.createDataFrame([(v,) for v in [None, *"aabbbbbbccdddef", None]], "v string")
    found = sharding.cuts(rows, "v", 4)
    got = {r.v: r.l for r in rows.select("v", sharding.level_of("v", found).alias("l")).collect()}
    values = ["", "", *"aabbbbbbccdddef"]
    want = {v or None: sum(x < v for x in values) * 4 // len(values) for v in set(values)}
    assert got == want


def test_shards_of_one_and_no_rows(spark):
    docs = odd_documents(spark)
    for n in (0, 1, 5):
        out = sharding.shard_rows(sharding.document_rows(docs.where("doc_id < 300 and doc_id != 7").limit(n)), ("lang", "size"), "doc_id", "size").collect()
        assert len(out) == n and all(r.slot == 0 for r in out) and len({r.shard for r in out}) == n


def test_written_files_are_narrow_in_every_dimension(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "x" * rng.randrange(1, 2000), f"l{rng.randrange(8)}", f"s{rng.randrange(50):02d}") for i in range(4000)], "doc_id long, text string, lang string, source string")
    back = sharding.write_shards(docs, str(tmp_path / "out"), shards=16, law="bytes")
    assert back.count() == 4000 and back.select("shard").distinct().count() == 16
    files = glob.glob(str(tmp_path / "out" / "shard=*" / "*.parquet"))
    box = {}
    for f in files:
        meta = pq.read_metadata(f)
        names = meta.schema.names
        for c in ("lang", "source", "size"):
            stats = [meta.row_group(g).column(names.index(c)).statistics for g in range(meta.num_row_groups)]
            box.setdefault(c, []).append((min(s.min for s in stats), max(s.max for s in stats)))
    # A filter on any one dimension rules out at least a third of the files.
    for c, value in (("lang", "l3"), ("source", "s25"), ("size", 1000)):
        hit = sum(low <= value <= high for low, high in box[c])
        assert hit <= 2 / 3 * len(files), (c, hit, len(files))
