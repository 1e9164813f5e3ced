"""Named queries of the training-data operators over the driver tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, collocation, decontam, hardneg, langid, linededup, neardup, quality, records, sharding, substring, tokencount, urlfilter
from palisade.llm.common import scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page and every document; text likelihoods from all labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.train_text(docs)
    of_pages = langid.identify(langid.page_rows(pages), model, markup=True)
    of_docs = langid.identify(langid.document_rows(docs), model)
    none = F.lit(None).cast("long")
    shape = lambda df, doc, page: df.select(
        doc.alias("doc_id"), page.alias("page_id"), "host", "declared", "lang", F.round("probability", 6).alias("probability")
    )
    return shape(of_docs, F.col("id"), none).unionByName(shape(of_pages, none, F.col("id")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names and units."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


URL_RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.train(urlfilter.default_labels(spark))
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, model)
    return judged.select(
        "page_id", F.col("uf_host").alias("host"), F.col("uf_path").alias("path"), F.col("uf_rule").alias("rule"),
        F.col("uf_verdict").alias("verdict"), F.round("uf_probability", 6).alias("probability"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines")
    return judged.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_key_chars=1)
    return out.select(
        "doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, path = scratch(spark, "records"), public_tokenizers.path("word_bpe_49k.json")
    manifest = records.write_records(table(spark, sf_dir, "documents"), folder, path)
    read = records.read_records(spark, folder, manifest, records.id_bytes(path))
    return read.select("doc_id", "start", "n_tokens", F.crc32("packed").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hardneg.quantised(rows.withColumn("label", label), scale=256)
    return hardneg.hard_negatives(vectors, every=100, positives=5, negatives=10, low_percent=30, high_percent=90)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"), least=30, most_words=4, best=2000)


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.document_rows(table(spark, sf_dir, "documents"))
    out = sharding.shard_rows(docs, ("lang", "source", "size"), "doc_id", "size", shards=16, law="rows")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontaminate, op3_near_duplicates, op4_url_filter, op5_substring_dedup, op6_byte_bpe,
        op7_token_counts, op8_quality_rules, op9_line_dedup, op10_token_records, op11_hard_negatives, op12_collocations,
        op13_hilbert_shards,
    )
}

_SPACE = r"\x20\x09-\x0D"
_BOILER = "|".join(quality.BOILERPLATE)



def _hilbert_sql(cells: str, bits: int, n: int = 3) -> str:
    """Common table expressions ``h0`` to ``hilbert`` over ``cells`` (columns x0, x1, ...), one per turn of the curve."""
    xs = [f"x{i}" for i in range(n)]
    steps, at = [f"h0 as (select * from {cells})"], 0

    def add(new: dict[str, str]) -> None:
        nonlocal at
        kept = ", ".join(f"{e} as {x}" for x, e in new.items())
        steps.append(f"h{at + 1} as (select * exclude ({', '.join(new)}), {kept} from h{at})")
        at += 1

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            bit, low = 1 << level, (1 << level) - 1
            swap = f"(xor(x0, x{i}) & {low})"
            new = {"x0": f"case when x{i} & {bit} <> 0 then xor(x0, {low}) else xor(x0, {swap}) end"}
            if i:
                new[f"x{i}"] = f"case when x{i} & {bit} <> 0 then x{i} else xor(x{i}, {swap}) end"
            add(new)
    for i in range(1, n):
        add({f"x{i}": f"xor(x{i}, x{i - 1})"})
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, case when x{n - 1} & {1 << level} <> 0 then {(1 << level) - 1} else 0 end)"
    add({x: f"xor({x}, {flip})" for x in xs})
    index = " + ".join(
        f"((x{i} >> {level}) & 1) * {1 << (level * n + n - 1 - i)}" for level in range(bits) for i in range(n)
    )
    return ",\n".join(steps) + f",\nhilbert as (select *, cast({index} as bigint) as h from h{at})"


ORACLES: dict[str, str] = {
    "op13_hilbert_shards": f"""
with crc_table as materialized (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
 lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
bodies as (select doc_id, lang, source, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, list_transform(regexp_extract_all(
 hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as body, count(*) over () as total from documents),
d as (select * exclude (body, t), xor(list_reduce(list_prepend(4294967295, body),
 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from bodies, crc_table),
cells as (select *, ((rank() over (order by lang nulls first) - 1) * 32 // total)::bigint as x0,
 ((rank() over (order by source nulls first) - 1) * 32 // total)::bigint as x1,
 ((rank() over (order by size nulls first) - 1) * 32 // total)::bigint as x2 from d),
{_hilbert_sql("cells", 5)},
ranked as (select *, row_number() over (order by h, doc_id nulls first) - 1 as place from hilbert),
cut as (select *, cast(place * 16 // total as integer) as shard from ranked)
select doc_id, size, text_crc32, 'rows' as law, shard,
 row_number() over (partition by shard order by place) - 1 as slot, cast(null as integer) as grown_shard, h as hilbert from cut""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
      list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
      from embeddings where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as integer) as rank,
 other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 10""",
    "op12_collocations": r"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
pieces as (select r, lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) as piece from d),
lists as (select row_number() over () as p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
wd as (select p, lang, unnest(ws) as w1, generate_subscripts(ws, 1) as i from lists),
x as (select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3, lead(w1, 3) over o as w4 from wd window o as (partition by p order by i)),
f as materialized (select lang, 1 as k, w1 as ph, count(*) as a from x group by all
      union all select lang, 2, w1 || ' ' || w2, count(*) from x where w2 is not null group by all having count(*) >= 30
      union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from x where w3 is not null group by all having count(*) >= 30
      union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from x where w4 is not null group by all having count(*) >= 30),
n as (select lang, sum(a) as n from f where k = 1 group by lang),
c as (select *, string_split(ph, ' ') as ws from f where k >= 2),
halves as materialized (select lang, ph, k, a, cut, array_to_string(ws[1:cut], ' ') as lph, array_to_string(ws[cut+1:], ' ') as rph
      from c, (values (1), (2), (3)) t(cut) where cut < k),
lefts as materialized (select h.*, f.a as l from halves h join f on f.lang = h.lang and f.ph = h.lph),
cuts as (select h.lang, h.ph, h.a, cut, l, f.a as r, cast(2000000::hugeint * h.a // (l + f.a) as bigint) as score
      from lefts h join f on f.lang = h.lang and f.ph = h.rph),
best as (select * from cuts qualify row_number() over (partition by lang, ph order by score, cut) = 1),
inner_ as (select lang, a, ws, k, m, unnest(range(1, k - m + 2)) as i from c, (values (2), (3)) t(m) where m < k),
longer as (select lang, array_to_string(ws[i:i+m-1], ' ') as ph, max(a) as a from inner_ group by all),
kept as (select b.*, b.ph as phrase from best b left join longer o on o.lang = b.lang and o.ph = b.ph
      where o.a is null or not (100::hugeint * o.a >= 80::hugeint * b.a)),
top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from top join n using (lang) where rank <= 2000""",
    "op8_quality_rules": f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as body from documents),
w as (select r, doc_id, body, list_filter(regexp_split_to_array(body, '[{_SPACE}]+'), lambda x: x <> '') as words,
             string_split(body, chr(10)) as lines from d),
grams as (select r, i, array_to_string(words[i:i+7], ' ') as g
          from (select r, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
reps as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from twice) group by r),
ln as (select r, pos, line, regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') as bare
       from (select r, unnest(lines) as line, generate_subscripts(lines, 1) as pos from w)),
lf as (select r, pos, line, bare, bare <> '' as worded,
       len(regexp_extract_all(bare, '[{_SPACE}]+')) as gaps, len(regexp_extract_all(bare, '[|•·»>/]')) as marks from ln),
judged as (select r, pos, line, bare, worded, worded and (
       (gaps + 1 >= 6 and not regexp_matches(bare, '[.!?…:;。！？]["''”’»)\\]*_]*$'))
       or (marks >= 3 and 2 * marks >= gaps + 1) or regexp_matches(lower(bare), '{_BOILER}')) as failed from lf),
per as (select r, count(*) filter (worded) - count(distinct line) filter (worded) as dup, count(*) filter (failed) as failed,
       sum(case when failed then 0 else length(regexp_replace(line, '[{_SPACE}]+', '', 'g')) end) as left_chars
       from judged group by r),
f as (select w.doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
       len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols, dup, coalesce(reps.n, 0) as rep, failed, left_chars
       from w join per using (r) left join reps using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
 cast(n_symbols as bigint) as n_symbols, cast(dup as bigint) as n_dup_lines, cast(rep as bigint) as n_repeat_words,
 (n_words < 20 or 100 * rep > 30 * n_words) as base_failed,
 not (n_words < 20 or 100 * rep > 30 * n_words) and not (100 * left_chars < 50 * word_chars) as kept,
 cast(failed as bigint) as n_failed_lines from f""",
    "op9_line_dedup": f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
ln as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, translate(regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from ln),
freq as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, freq.key is not null as gone from k left join freq using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by r""",
    "op5_substring_dedup": f"""
with d as (select row_number() over () as r, doc_id,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACE}]+'), lambda x: x <> '') as words from documents),
wd as (select r, unnest(words) as word, generate_subscripts(words, 1) as p from d),
win as (select r, doc_id, i, md5(array_to_string(words[i:i+19], ' ')) as g
        from (select r, doc_id, words, unnest(range(1, len(words) - 18)) as i from d where len(words) >= 20)),
later as (select r, i from (select r, i, row_number() over (partition by g order by doc_id, i) as n from win) where n > 1),
gone as (select distinct r, unnest(range(i, i + 20)) as p from later),
kept as (select wd.r, count(gone.p) as n_removed, string_agg(word, ' ' order by wd.p) filter (gone.p is null) as t
         from wd left join gone on wd.r = gone.r and wd.p = gone.p group by wd.r)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
 sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r)""",
    "op3_near_duplicates": f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_SPACE}]+'), lambda x: x <> '') as words from documents),
s as (select distinct doc_id, md5(array_to_string(words[i:i+3], ' ')) as g
      from (select doc_id, words, unnest(case when len(words) >= 4 then range(1, len(words) - 2)
            when len(words) > 0 then [1] else [] end) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)),
link as (select a, b from e union all select b, a from e),
reach(x, y) as (select doc_id, doc_id from n union select reach.x, link.b from reach join link on link.a = reach.y),
c as (select x, min(y) as m from reach group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.m, d.doc_id) as component_id,
 coalesce(c.m, d.doc_id) = d.doc_id as kept from d left join n using (doc_id) left join c on c.x = d.doc_id""",
}
