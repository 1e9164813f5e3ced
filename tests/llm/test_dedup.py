"""Near duplicates, substrings, lines, quality and decontamination against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, difference
from palisade.llm import decontam, linededup, neardup, quality, substring
from palisade.llm.common import components, trees
from palisade.llm.words import hash_spans, whole_windows, window_hashes, words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_near_duplicates", "op5_substring_dedup", "op8_quality_rules", "op9_line_dedup"])
def test_query_matches_oracle(spark, name):
    assert difference(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_word_hashes_follow_the_words():
    rows = ["a b", "", "b\ta  a", "x" * 700_000 + " b", "é b"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(r.encode()) for r in rows])
    starts, ends, first = words(data, offsets)
    found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
    assert found == [w for r in rows for w in r.split()] and first.tolist() == [0, 2, 2, 5, 7, 9]
    by_word = {}
    for w, h in zip(found, hash_spans(data, starts, ends).tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    h = np.arange(50, dtype=np.uint64)
    for size in (1, 2, 3, 5, 8, 20):
        wins = window_hashes(np.concatenate([h, h]), size)
        assert len(wins) == 101 - size and (wins[: 51 - size] == wins[50:]).all() and len(set(wins.tolist())) == 50
    assert np.flatnonzero(whole_windows(np.array([0, 3, 3, 7]), 3, 7)).tolist() == [0, 3, 4]


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 400)) and got[502] == 500 and len(got) == 344


def test_trees_name_the_least_node_below_each_root(spark):
    links = [(i, i + 1) for i in range(40)] + [(i, 100) for i in range(101, 400)] + [(900, 800), (700, 800)]
    got = dict(trees(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 400), 100) | dict.fromkeys((700, 800, 900), 700)
    assert trees(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 10
    for _ in range(4):
        base = [word() for _ in range(120)]
        for k in range(14):
            copy = list(base)
            for _ in range(k % 7):
                copy[rng.randrange(120)] = word()
            rows.append((n, " ".join(copy).upper() if k % 2 else "\n".join(copy)))
            n += 1
    for k in range(20):  # each like its neighbour only
        rows.append((n, " ".join(f"w{j}" for j in range(9 * k, 9 * k + 100))))
        n += 1
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "two one"), (7, "É a b"), (8, "é a b")]


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    top = {i: i for i in sets}
    find = lambda x: x if top[x] == x else find(top[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(4, 80), (5, 80)])
def test_near_duplicates_equal_brute_force(make, size, percent):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(make(rows), size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_near_duplicates_edges(edges, empty):
    rows = neardup.near_duplicates(edges, 4).collect()
    assert len(rows) == 8 and all(r.kept for r in rows) and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == 8


def brute_substrings(rows, size):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone.update(range(k, k + size))
            seen.setdefault(key, i)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def substring_rows():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        body = [f"d{i}_{k}" for k in range(rng.randrange(0, 60))]
        at = rng.randrange(len(body) + 1)
        rows.append((100 - i, " ".join(body[:at] + (passage[: rng.randrange(15, 61)] if i % 3 else []) + body[at:])))
    return rows + [(200, "z " * 50), (201, None), (202, ""), (203, " ".join(["q r s"] * 30))]


def test_substrings_equal_brute_force(make):
    rows = substring_rows()
    for rules in (substring.SubstringRules(), substring.SubstringRules(min_bits=20, max_bits=20, flush=50)):
        docs = make(rows).repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(docs, rules).collect()}
        assert got == brute_substrings(rows, 20)


def test_a_full_sketch_loses_nothing(make):
    rows = substring_rows()
    got = substring.dedup_substrings(make(rows), substring.SubstringRules(min_bits=10, max_bits=10, block_bits=8, depth=2))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == brute_substrings(rows, 20)


def test_substring_tasks_work_in_bounded_memory():
    words = [f"w{k * k % 99_991}" for k in range(100_000)]
    texts = [" ".join(words[k : k + 1_000]) for k in range(0, 99_000, 100)]  # 7 MB in one Arrow batch, ten times each window
    batch = pa.RecordBatch.from_arrays([pa.array(range(990)), pa.array(texts), pa.array([0] * 990, pa.int32())], ["id", "text", "variant"])
    full = SimpleNamespace(value=np.full((3, 1 << 17), 255, np.uint8))
    rules = substring.SubstringRules()
    list(substring._estimated(rules, 20, full)(iter([batch.slice(0, 9)])))
    peaks, rows = [], []
    for run in (substring._sketch(rules, 28), substring._estimated(rules, 20, full)):
        tracemalloc.start()
        rows.append([x.num_rows for x in run(iter([batch]))])
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert max(peaks) < 90 and max(rows[1]) <= 1 << 16 < sum(rows[1]), (peaks, rows[1])


def test_substring_edges(edges, empty):
    got = substring.dedup_substrings(edges).collect()
    assert len(got) == 8 and sum(r.n_removed for r in got if r.doc_id != 6) == 0
    assert [r.n_removed for r in got if r.doc_id == 6] == [29_999] and substring.dedup_substrings(empty).count() == 0


def test_line_edges(make, edges, empty):
    rows = [(i, f"own {i}\n  Shared LINE \t\nend {i}\n\n") for i in range(12)] + [(3, "shared line"), (None, "shared line\nx")]
    got = {(r.doc_id, r.text): (r.ld_n_lines, r.ld_n_dropped) for r in linededup.dedup_lines(make(rows), 12).collect()}
    assert got[(5, "own 5\nend 5\n\n")] == (5, 1) and got[(3, "")] == (1, 1) and got[(None, "x")] == (2, 1) and len(got) == 14
    few = linededup.dedup_lines(make(rows), 13).where("ld_n_dropped > 0")
    assert few.count() == 0
    out = linededup.filter_lines(edges, 1)
    assert out.columns == edges.columns and out.count() == 8 and linededup.dedup_lines(empty).count() == 0


def brute_repeats(w, size=8):
    grams = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return len({i + k for i in range(len(w) - size + 1) if grams[tuple(w[i : i + size])] > 1 for k in range(size)})


def test_quality(make, edges, empty):
    loop = " ".join(f"w{i}." for i in range(10))
    prose = "This line has quite a few words and ends well.\n" * 3
    rows = [(1, f"{loop} x {loop} y {loop[:20]}"), (2, prose), (3, prose + "Home | News | Sport | More\nPlease accept cookies now.\nno end of this line at all"),
            (4, "word word no end here at all\n" * 2 + prose[:48]), (5, "a b " * 40)]
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    for i, t in rows:
        assert got[i].q_n_repeat_words == brute_repeats(t.split()) and got[i].q_n_words == len(t.split())
    assert got[3].q_cleaned == prose[:-1] and got[3].q_n_failed_lines == 3 and not got[4].q_kept
    assert [r.q_n_failed_lines for r in quality.judge(make([(1, prose)])).collect()] == [0]
    assert quality.judge(edges).count() == 8 and quality.judge(empty).count() == 0
    varied = "\n".join(f"Line {i} tells of thing {i * 7} and ends here." for i in range(5))
    kept = quality.filter_quality(make([(1, varied + "\nHome | News | Sport | More"), (2, None), (3, varied)])).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in kept} == {1: (varied, len(varied)), 3: (varied, len(varied))}
    plan = quality.judge(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


ITEM = "A farmer named Alice has 12 apples and gives Bob exactly 5 of them before Alice walks 3 km home to count the rest."


def test_decontamination(spark, make, edges, empty):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "47").replace("5", "9").replace("3 km", "8 miles")
    mixed = "A farmer named Alice has 12 apples and gives Bob exactly 5 of them. Unrelated words follow here and nothing else is shared at all."
    broken = ITEM.replace("Alice has", "Carol has").replace("before Alice", "before Erin").replace("Bob", "Frank")
    prose = "Quiet rivers run past old mills where nobody counts anything and the days are long and warm in the valley below. " * 20
    rows = [(1, prose + ITEM + " " + prose), (2, other), (3, prose), (4, "x " + ITEM.lower()), (5, mixed), (6, broken), (7, None), (1, ITEM)]
    bench = spark.createDataFrame([(0, ITEM, 1), (1, "too short", 1), (2, None, 1)], "item_id long, text string, id int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(make(rows), bench).collect()}
    assert got[(1, 0)].kind == "copy" and got[(2, 0)].kind == "reparameterised" and got[(2, 0)].n_changed == 6
    assert (3, 0) not in got and (6, 0) in got and got[(6, 0)].slot_consistency < 1
    strict = decontam.contaminated(make(rows), bench, decontam.TemplateRules(min_consistency=1.0))
    assert 6 not in {r.doc_id for r in strict.collect()}
    left = decontam.decontaminate(make(rows), bench)
    assert 3 in {r.doc_id for r in left.collect()} and left.columns == make([]).columns
    assert decontam.contaminated(edges, bench).count() == 0 and decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(make(rows), bench.limit(0)).count() == 0


def test_decontamination_equals_a_plain_search(spark):
    """Documents that hold eight windows in a row of an item, found by string search, are all reported."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if " ".join(b.text.split()[1:]) in " ".join((d.text or "").split())}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op2_decontaminate"](spark, "/root/testdata/sf0.01").collect()}
    assert want and want <= got
    short = {(d.doc_id, b.item_id) for d in docs for b in bench if any(
        " ".join(b.text.split()[k : k + 7]) in " ".join((d.text or "").split()) for k in range(1, max(2, len(b.text.split()) - 7), 3))}
    assert got <= short


def test_pipeline_equals_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    judged = {r.doc_id for r in entry.queries()["op8_quality_rules"](spark, SF).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == judged and first.columns == docs.columns
    second = corpus_pipeline.STAGES[1][1](spark, first, SF).cache()
    assert second.count() == len(judged)
    third = corpus_pipeline.STAGES[2][1](spark, second, SF)
    want = brute_components([(r.doc_id, r.text) for r in second.collect()], 5, 80)
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in want.items() if c == i}
    out = entry.queries()["pipeline"](spark, SF)
    hits = {r.doc_id for r in decontam.contaminated(third, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in third.collect()} - hits
    assert out.where(F.col("n_tokens") * 4 != F.octet_length("packed")).count() == 0


def test_pipeline_stages_on_edges(spark, edges, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edges, empty):
            out = stage(spark, docs.drop("key", "id"), SF)
            assert out.count() <= docs.count() and (name == "encode" or out.columns == docs.drop("key", "id").columns)


def test_a_loose_family_is_compared_in_proportion_to_its_size(spark, make, monkeypatch):
    """Six variants of one text, unlike each other, in many near copies: no meeting pair by pair."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(300)]
    variants = []
    for v in range(6):
        copy = list(base)
        copy[40 * v : 40 * v + 45] = [f"v{v}x{k}" for k in range(45)]
        variants.append(copy)

    def family(size):
        rows = []
        for i in range(size):
            copy = list(variants[i % 6])
            for _ in range(2):
                copy[rng.randrange(300)] = f"own{i}"
            rows.append((1000 + i, " ".join(copy)))
        return rows

    compared, plain = {}, neardup.written

    def counting(df, name):
        out = plain(df, name)
        if name in ("hubs", "apart"):
            compared[name] = compared.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "written", counting)
    for size in (60, 240):
        compared.clear()
        rows = family(size)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(make(rows), 5, 80).collect()}
        assert got == {i: c for i, (_, c) in brute_components(rows, 5, 80).items()} and len(set(got.values())) == 6
        assert sum(compared.values()) <= 6 * size, compared


def test_substrings_of_a_repeated_id_do_not_depend_on_the_partitions(spark, make):
    """Rows that repeat an id with other texts: one answer in any number of partitions."""
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(45)]
    rows = []
    for i in range(12):
        own = [f"o{i}x{k}" for k in range(rng.randrange(5, 40))]
        rows.append((i // 3, " ".join(own + shared[rng.randrange(10) :] + own[:3])))
    rows += [(0, rows[0][1]), (None, " ".join(shared)), (77, " ".join(shared + shared))]

    def brute():
        words = {(i, t): t.split() for i, t in rows if i is not None}
        key = lambda p, d: (d[0], p, hashlib.sha256(d[1].encode()).hexdigest())
        first = {}
        for d, w in words.items():
            for p in range(len(w) - 19):
                g = tuple(w[p : p + 20])
                first[g] = min(first.get(g, key(p, d)), key(p, d))
        out = []
        for i, t in rows:
            w, gone = t.split(), set()
            if i is not None:
                for p in range(len(w) - 19):
                    if key(p, (i, t)) > first[tuple(w[p : p + 20])]:
                        gone |= set(range(p, p + 20))
            out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        return sorted(out, key=repr)

    want = brute()
    assert sum(r[2] for r in want) > 200
    for n in (1, 2, 8):
        got = substring.dedup_substrings(make(rows).repartition(n)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == want


def test_columns_of_a_caller_keep_their_values(spark, make):
    """Names that the line and quality operators use themselves stay the caller's."""
    docs = make([(1, "This is a first sentence that goes on for long enough to stay here.\n" * 3), (2, "x")])
    mine = docs.withColumns({c: F.lit(f"my {c}") for c in ("ld_row1", "ld_drop", "ld_lines", "q_kept", "q_words", "q_stays")})
    for got in (linededup.filter_lines(mine, min_documents=1), quality.filter_quality(mine)):
        assert got.columns == mine.columns
        assert {r[c] for r in got.collect() for c in mine.columns if c[:2] in ("ld", "q_")} <= {f"my {c}" for c in mine.columns}


def test_the_filter_judges_each_document_once(spark, make):
    plan = quality.filter_quality(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    alone = quality.judge(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(") + plan.count("hash(") <= alone.count("xxhash64(") + alone.count("hash(")


def test_pipeline_with_repeats_and_missing_ids_and_texts(spark, tmp_path):
    rng = random.Random(1)
    body = lambda: " ".join(rng.sample([f"w{i:03d}" for i in range(900)], 60)) + "."
    same, one, two = body(), body(), body()
    rows = [(1, None, "a"), (2, "", "b"), (3, same, "c"), (3, same, "d"), (4, same, "e"), (None, one, "f"), (None, same, "g"), (5, two, "h")]
    spark.createDataFrame(rows, "doc_id long, text string, ld_row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 0, 3, 3, 5]
