"""URL filter: rules first, then gradient-boosted trees on lexical features.

The urls that a rule covers are the labelled ones.  The trees learn from them length,
depth, digit ratio, entropy, parameter counts and the statistics of the host's suffix and
of the first directory, and judge the urls that no rule covers.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, read, sample_by_hash

QUERY = "op7_url_filter"
#: (verdict, rule): a host and the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
#: The trees are fitted on about so many labelled urls, chosen by hash.
TRAIN_URLS = 20_000
TREES, DEPTH = 15, 4
#: Weight of the overall block rate in the rate of a suffix or directory.
SMOOTHING = 20.0

FEATURES = ["url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters",
            "hyphens", "has_fragment", "suffix_rate", "suffix_share", "directory_rate", "directory_share"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest() -> Column:
    """What follows the first ://, empty for a null url or one without it."""
    at = F.locate("://", F.coalesce(F.col("url"), F.lit("")))
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")


def parsed(urls: DataFrame) -> DataFrame:
    """page_id, url, host (lower case) and path."""
    rest = _rest()
    return urls.select("page_id", "url",
                       F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
                       F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def matched_rule(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, start = text.partition("/")
        fits = (((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host)))
                & F.startswith(F.col("path"), F.lit(slash + start)))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with the features of the url's own text, its suffix and directory."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: n - F.length(F.replace(url, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0))
    return (urls
            .withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
            .withColumn("directory", F.regexp_extract("path", r"^/([^/]*)/", 1))
            .withColumn("url_length", n.cast("double"))
            .withColumn("host_length", F.length("host").cast("double"))
            .withColumn("path_length", F.length("path").cast("double"))
            .withColumn("labels", F.size(F.split("host", r"\.")).cast("double"))
            .withColumn("depth", (F.size(F.split("path", "/")) - 1).cast("double"))
            .withColumn("digit_ratio", F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(n, F.lit(1)))
            .withColumn("entropy", F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0))
            .withColumn("parameters", F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")))
            .withColumn("hyphens", (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"))
            .withColumn("has_fragment", F.contains(url, F.lit("#")).cast("double")))


class UrlModel:
    """Fitted trees with the statistics of suffixes and directories.  Where the labelled
    urls are all of one verdict, or there are none, that verdict (or allow) is the answer."""

    def __init__(self, suffixes: DataFrame | None = None, directories: DataFrame | None = None, base: float = 0.0,
                 trees: PipelineModel | None = None):
        self.suffixes, self.directories, self.base, self.trees = suffixes, directories, base, trees

    def features(self, urls: DataFrame) -> DataFrame:
        """Joins the statistics; a name that no labelled url has gets the base rate."""
        return (lexical(urls).join(self.suffixes, "suffix", "left").join(self.directories, "directory", "left")
                .fillna({"suffix_rate": self.base, "suffix_share": 0.0, "directory_rate": self.base,
                         "directory_share": 0.0}))

    def blocks(self, urls: DataFrame) -> DataFrame:
        """``urls`` with the column blocked (0.0 or 1.0)."""
        if self.trees is None:
            return urls.withColumn("blocked", F.lit(float(self.base > 0.5)))
        return self.trees.transform(self.features(urls)).withColumnRenamed("prediction", "blocked")


def _rates(labelled: DataFrame, name: str, total: int, base: float) -> DataFrame:
    """Smoothed block rate and share of the labelled urls, by suffix or directory."""
    return labelled.groupBy(name).agg(F.sum("label").alias("b"), F.count("*").alias("n")).select(
        name, ((F.col("b") + SMOOTHING * base) / (F.col("n") + SMOOTHING)).alias(f"{name}_rate"),
        (F.col("n") / total).alias(f"{name}_share"))


def learn(labelled: DataFrame, train_urls: int = TRAIN_URLS) -> UrlModel:
    """A model of urls with their host, path and label (1 block, 0 allow)."""
    total, blocked = labelled.agg(F.count("*"), F.sum("label")).first()
    if not total or blocked in (0, total):
        return UrlModel(base=float(bool(blocked)))
    base = blocked / total
    names = lexical(labelled).select("suffix", "directory", "label")
    model = UrlModel(kept(_rates(names, "suffix", total, base), "suffixes"),
                     kept(_rates(names, "directory", total, base), "directories"), base)
    sample = kept(model.features(sample_by_hash(labelled, "url", train_urls, total)).select("label", *FEATURES), "urls")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return UrlModel(base=base)
    model.trees = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features_vector"),
        GBTClassifier(featuresCol="features_vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7),
    ]).fit(sample)
    return model


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A null url or one without :// has an empty host and path; no rule fits it, and the
    trees judge it like others.  The longest rule that fits decides.  Repeated rows are rows like
    others; an empty table gives an empty result.  No column but page_id and url is read.
    """
    rule, verdict = matched_rule(rules)
    urls = parsed(pages).withColumn("rule", rule).withColumn("by_rule", verdict)
    labelled = urls.where("by_rule is not null").select(
        "url", "host", "path", (F.col("by_rule") == "block").cast("double").alias("label"))
    out = learn(labelled, train_urls).blocks(urls)
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "by_rule", F.when(F.col("blocked") > 0.5, "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))
