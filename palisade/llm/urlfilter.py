"""URL filters: listed rules first, then a logistic regression on hashed character n-grams.

Cases: a null url or one without ``://`` has empty host and path and fits no rule; the model
still judges it (no n-grams: the model's prior); rows repeat as often as they come; extra
columns stay; an empty table gives an empty result.  No shuffle of the judged rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import lower_ascii

MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the beginning of a path (with its slash)."""

    host: str
    path: str
    verdict: str  # "allow" or "block"


@dataclass(frozen=True)
class UrlModelSettings:
    """The labelled table is small by contract: more than ``most_labels`` rows are refused."""

    sizes: tuple[int, ...] = (3, 4, 5)
    buckets: int = 1 << 16
    regularisation: float = 1e-3
    iterations: int = 60
    threshold: float = 0.5
    most_labels: int = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (to ``?``, ``#`` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null.

    The rules are a literal map from host to its paths; each suffix of the url's host at a
    dot is looked up, so the cost follows the host's labels and not the number of rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    entry = lambda r: F.struct(
        F.lit(len(r.host) + len(r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"),
        F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"),
    )
    table = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))])
    labels = F.split(host, r"\.")
    suffix = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    lists = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.try_element_at(table, suffix(i)))
    fitting = F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _grams(text: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    """Tagged character n-grams of a text between marks; linear in its length."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    n = F.size(chars)
    of = lambda size: F.when(n < size, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.concat(F.lit(tag), *[F.get(chars, i + k) for k in range(size)])))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*[of(s) for s in sizes]))


def _featured(df: DataFrame, settings: UrlModelSettings, url: str) -> DataFrame:
    """With ``uf_features``: hashed n-grams of host and path, repeats counted once."""
    host, path = host_and_path(F.col(url))
    grams = F.concat(_grams(host, "h:", settings.sizes), _grams(lower_ascii(path), "p:", settings.sizes))
    return HashingTF(inputCol="uf_grams", outputCol="uf_features", numFeatures=settings.buckets, binary=True).transform(
        df.withColumn("uf_grams", grams)
    )


def train(labelled: DataFrame, settings: UrlModelSettings = UrlModelSettings(), url: str = "url", label: str = "blocked") -> LogisticRegressionModel:
    """Fit on a small table of urls and labels (1 block, 0 allow); rows with a null are left out."""
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("url is not null and label is not null")
    if rows.limit(settings.most_labels + 1).count() > settings.most_labels:
        raise ValueError(f"more than {settings.most_labels} labelled urls")
    data = _featured(rows, settings, "url").select("label", "uf_features").coalesce(1)
    fit = LogisticRegression(featuresCol="uf_features", maxIter=settings.iterations, regParam=settings.regularisation)
    return fit.fit(data)


def judge_urls(
    pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel | PipelineModel,
    settings: UrlModelSettings = UrlModelSettings(), url: str = "url",
) -> DataFrame:
    """``pages`` with uf_host, uf_path, uf_rule, uf_verdict and uf_probability (of block)."""
    host, path = host_and_path(F.col(url))
    df = pages.withColumns({"uf_host": host, "uf_path": path})
    df = df.withColumn("uf_best", longest_rule(F.col("uf_host"), F.col("uf_path"), rules))
    model = model.copy().setPredictionCol("").setRawPredictionCol("uf_raw").setProbabilityCol("uf_p")
    scored = model.transform(_featured(df, settings, url))
    p = vector_to_array("uf_p")[1]
    learned = F.when(p >= settings.threshold, "block").otherwise("allow")
    return scored.withColumns({
        "uf_probability": p, "uf_rule": F.col("uf_best.rule"), "uf_verdict": F.coalesce(F.col("uf_best.verdict"), learned),
    }).drop("uf_best", "uf_grams", "uf_features", "uf_raw", "uf_p")


# Words of which the default labelled table is made.
BLOCKED_WORDS = (
    "casino", "win", "bets", "free", "pills", "cheap", "adult", "xxx", "porn", "sex", "spam", "farm", "ads", "track",
    "loan", "payday", "viagra", "poker", "slots", "crack", "warez", "click", "hot", "girls", "jackpot", "replica",
)
ALLOWED_WORDS = (
    "library", "museum", "news", "school", "garden", "weather", "history", "science", "music", "travel", "recipes",
    "health", "city", "books", "nature", "sport", "theatre", "then", "there", "other", "ring", "that", "ration", "tion",
    "the", "and",
)


def default_labels(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, blocked) made by rule from two word lists: 2,600 rows."""
    def urls(words: tuple[str, ...], blocked: int):
        zones, leads = ("com", "net", "org", "info"), ("", "www.", "m.", "blog.")
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if a != b:
                    glue = "-" if blocked or j % 3 == 0 else ""
                    where = "/en/{}" if (i + j) % 2 else "/{}.html"
                    for k in range(2):
                        n = i * len(words) + j + k
                        yield f"https://{leads[n % 4]}{a}{glue}{b}.{zones[(i + k) % 4]}{where.format(n)}", blocked
    rows = [*urls(BLOCKED_WORDS, 1), *urls(ALLOWED_WORDS, 0)]
    return spark.createDataFrame(rows, "url string, blocked int")
