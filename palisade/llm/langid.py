"""Language identification by Bayesian evidence fusion.

Four sources of evidence add up as log probabilities: character trigrams of the text, the
language that the markup declares, the address suffix, and a prior of the host that is
smoothed towards its domain, that one towards its suffix, and that one towards the whole
corpus.  Likelihoods come from labelled documents, priors from the judged rows themselves,
all by grouped sums.

Cases: null or empty text, no declared language, no host: that evidence is absent, and the
wider prior speaks; rows repeat as often as they come; extra columns are left out; an empty
table gives an empty result, and no labelled documents leave the text out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import lower_ascii, pieces, strings, written
from palisade.llm.words import TO_LOWER

BUCKETS = 1 << 16
# countries' address suffixes and the language that they speak for.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es",
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en",
}


@dataclass(frozen=True)
class LanguageSettings:
    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    # Neighbouring trigrams overlap, so each counts as a third of an observation.
    temper: float = 1 / 3
    # Probability that a declaration, or a country's suffix, names the true language.
    declared_trust: float = 0.9
    suffix_trust: float = 0.8
    # Weight in rows of the wider prior at every level (host, domain, suffix, corpus).
    smoothing: float = 5.0


def _text_of(html: bytes) -> bytes:
    import re

    html = re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", b" ", html)
    return re.sub(rb"<[^>]*>|&#?\w{1,10};", b" ", html)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams with a letter, and the row of each."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = TO_LOWER[data].astype(np.uint32)
    letter = (low >= 0x61) & (low <= 0x7A) | (low >= 0x80)
    low = np.where(letter, low, 0x20)
    key = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    ok = letter[:-2] | letter[1:-1] | letter[2:]
    for edge in np.unique(offsets[1:-1]):
        ok[max(0, edge - 2) : edge] = False
    at = np.flatnonzero(ok)
    bucket = (key[at] * np.uint32(2654435761)) >> np.uint32(16)
    return bucket.astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def _counts(settings: LanguageSettings):
    """Per task the trigram counts of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {n: i for i, n in enumerate(settings.languages)}
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in pieces(batches, 1, 2 << 20):
            offsets, data = strings(batch.column(1))
            language = np.array([names.get(x, -1) for x in batch.column(0).to_pylist()])
            bucket, row = _trigrams(data, offsets)
            mine = language[row] if len(row) else row
            for i in range(len(names)):
                total[i] += np.bincount(bucket[mine == i], minlength=BUCKETS)
        i, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[i, bucket])], ["language", "bucket", "n"]
        )

    return run


def train_text(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), language: str = "lang", text: str = "text") -> np.ndarray:
    """Log probability of every trigram bucket in each language, from all labelled documents.

    Counts are summed on Spark; the model has languages * 65,536 entries whatever the input.
    """
    rows = docs.select(F.col(language).alias("language"), F.col(text).alias("text")).where(F.col("language").isin(*settings.languages))
    sums = rows.mapInArrow(_counts(settings), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(settings.languages), BUCKETS), 0.5)
    counts[sums["language"].to_numpy(), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _evidence(settings: LanguageSettings, shared, markup: bool):
    """Log likelihood of each text in every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, size = shared.value, len(settings.languages)
        for batch in pieces(batches, 1, 2 << 20):
            column = batch.column(1)
            if markup:
                column = pa.array([_text_of(t.encode()) if t else b"" for t in column.to_pylist()], pa.binary())
            offsets, data = strings(column)
            bucket, row = _trigrams(data, offsets)
            out = np.zeros((batch.num_rows, size))
            for i in range(size):
                out[:, i] = np.bincount(row, model[i][bucket], minlength=batch.num_rows)
            flat = pa.array((out * settings.temper).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, size, dtype=np.int32)), flat)], ["id", "evidence"]
            )

    return run


def _fused(parts: list[Column], size: int) -> Column:
    """Posterior: the sum of log evidence arrays, normalised."""
    total = F.array(*[sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(size)])
    return F.transform(total, lambda x: 1 / F.aggregate(total, F.lit(0.0), lambda a, y: a + F.exp(F.least(y - x, F.lit(700.0)))))


def _trust(named: Column, settings: LanguageSettings, trust: float) -> Column:
    """Log likelihood of a named language; none named or an unknown one says nothing."""
    other = float(np.log((1 - trust) / max(1, len(settings.languages) - 1)))
    one = lambda x: F.when(named == x, float(np.log(trust))).otherwise(other)
    known = F.coalesce(named.isin(*settings.languages), F.lit(False))
    return F.array(*[F.when(known, one(x)).otherwise(0.0) for x in settings.languages])


def declared_language(html: Column) -> Column:
    """The primary language of ``<html lang="..">``, lower-cased; null if there is none."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1)
    return F.when(found != "", F.lower(found))


def host_priors(rows: DataFrame, settings: LanguageSettings) -> DataFrame:
    """``host`` and ``prior``: per language the smoothed share, level by level.

    ``rows`` holds host, domain, zone and ``p`` (first posterior per language).  Sums per
    host are partial in each task; the wider levels add up the sums of the narrower one, and
    only (level, sum) tables are joined, so a host with a third of all rows is one row here.
    """
    size, k = len(settings.languages), settings.smoothing
    names = [f"s{i}" for i in range(size)]
    add = lambda df, keys: df.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    each = rows.select("host", "domain", "zone", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    host = written(add(each, ["host", "domain", "zone"]), "hosts")
    domain = add(host, ["domain", "zone"])
    zone = add(domain, ["zone"])
    sums = lambda df, name: df.select(*df.columns[: -size], F.array(*names).alias(name))
    whole = add(zone, []).select(F.coalesce(F.array(*names), F.array(*[F.lit(0.0)] * size)).alias("all"))
    total = [float(x or 0) for x in whole.first()["all"]]
    base = F.array(*[F.lit((t + k / size) / (sum(total) + k)) for t in total])
    smooth = lambda own, wider: F.zip_with(
        own, wider, lambda s, w: (s + k * w) / (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + k)
    )
    zones = sums(zone, "z").select("zone", smooth(F.col("z"), base).alias("pz"))
    domains = sums(domain, "d").join(zones, "zone").select("domain", "zone", smooth(F.col("d"), F.col("pz")).alias("pd"))
    hosts = sums(host, "own").join(domains, ["domain", "zone"])
    return hosts.select("host", "own", "pd")


def identify(
    rows: DataFrame, model: np.ndarray, settings: LanguageSettings = LanguageSettings(), markup: bool = False
) -> DataFrame:
    """``id``, ``host``, ``declared``, ``lang``, ``probability`` of rows (id, text, declared, host).

    Two passes: text, declaration and suffix give a first posterior, its sums per host the
    priors, and both together the answer.  A row's own share is taken out of its host's sums.
    """
    size, spark = len(settings.languages), rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keyed = rows.select(F.struct("id", "declared", "host").alias("id"), "text")
    kind = keyed.schema["id"].dataType.simpleString()
    scored = keyed.mapInArrow(_evidence(settings, shared, markup), f"id {kind}, evidence array<double>")
    labels = F.split(F.coalesce("host", F.lit("")), r"\.")
    scored = scored.select("id.*", "evidence").withColumns({
        "host": F.coalesce("host", F.lit("")),
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
        "zone": F.element_at(labels, -1),
    })
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    named = F.when(F.size(labels) > 1, F.try_element_at(suffix, F.col("zone")))
    parts = [F.col("evidence"), _trust(F.col("declared"), settings, settings.declared_trust), _trust(named, settings, settings.suffix_trust)]
    first = scored.withColumn("own_evidence", F.array(*[sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(size)]))
    first = written(first.withColumn("p", _fused([F.col("own_evidence")], size)).drop("evidence"), "evidence")
    priors = host_priors(first, settings)
    k = settings.smoothing
    rest = F.zip_with("own", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    prior = F.zip_with(rest, F.col("pd"), lambda s, w: F.log((s + k * w) / (F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) + k)))
    joined = first.join(priors, "host").withColumn("prior", prior)
    joined = joined.withColumn("posterior", _fused([F.col("own_evidence"), F.col("prior")], size))
    ranked = F.array_sort(F.zip_with(
        F.array(*map(F.lit, settings.languages)), "posterior", lambda n, p: F.struct((-p).alias("minus"), n.alias("lang"))
    ))
    best = joined.withColumn("best", ranked[0])
    return best.select("id", "host", "declared", F.col("best.lang").alias("lang"), (-F.col("best.minus")).alias("probability"))


def page_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, text, declared, host)`` of web pages; the text is still markup."""
    host = lower_ascii(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#:]*)", 1))
    return pages.select(F.col(page_id).alias("id"), F.col(html).alias("text"), declared_language(F.col(html)).alias("declared"), host.alias("host"))


def document_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(id, text, declared, host)`` of documents: their source stands for the host."""
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.lit(None).cast("string").alias("declared"), F.col(source).alias("host"))
