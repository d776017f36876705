"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

All features are column expressions; the trees are trained on labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name

# Labelled URLs that training uses at most, by hash order; a documented bound.
TRAIN_URLS = 20_000
TREES, DEPTH, SEED = 20, 4, 1
# Weight of the overall share of blocked URLs in that of a suffix.
PRIOR = 20.0

FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "labels", "longest_label", "depth", "parameters",
    "digit_ratio", "host_digits", "hyphens", "odd_ratio", "host_entropy", "path_entropy", "secure", "fragment",
    "suffix1_rate", "suffix1_log_n", "suffix2_rate", "suffix2_log_n",
]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Model:
    trees: GBTClassificationModel
    suffixes: DataFrame  # suffix, rate, log_n of all labelled URLs
    rate: float


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(url, _SPLIT, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.

    Equally long rules count in the order of their text.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own letter frequencies; 0 if it is empty."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(acc: Column, c: Column) -> Column:
        p = F.size(F.filter(letters, lambda d: d == c)) / F.size(letters)
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(letters), F.lit(0.0), bits)


def suffix_of(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add the features that need nothing but the URL; null counts as empty."""
    text, h, p = F.coalesce(F.col(url).cast("string"), F.lit("")), F.col(host), F.col(path)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    whole = F.greatest(F.length(text), F.lit(1))
    features = {
        "url_length": F.length(text),
        "host_length": F.length(h),
        "path_length": F.length(p),
        "query_length": F.length(query),
        "labels": F.size(F.split(h, r"\.")),
        "longest_label": F.array_max(F.transform(F.split(h, r"\."), F.length)),
        "depth": _count(p, "/"),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "digit_ratio": _count(text, "[0-9]") / whole,
        "host_digits": _count(h, "[0-9]"),
        "hyphens": _count(h, "-"),
        "odd_ratio": _count(text, "[^A-Za-z0-9]") / whole,
        "host_entropy": _entropy(h),
        "path_entropy": _entropy(p),
        "secure": _ascii_lower(text).startswith("https:").cast("int"),
        "fragment": text.contains("#").cast("int"),
    }
    return df.withColumns({k: v.cast("double") for k, v in features.items()})


def _with_suffixes(df: DataFrame, host: str, suffixes: DataFrame, rate: float) -> DataFrame:
    """Add the suffix statistics; Spark decides by the table's size whether every task gets it whole."""
    for n in (1, 2):
        side = suffixes.select(
            F.col("suffix").alias(f"suffix{n}"), F.col("rate").alias(f"suffix{n}_rate"), F.col("log_n").alias(f"suffix{n}_log_n")
        )
        df = df.withColumn(f"suffix{n}", suffix_of(F.col(host), n)).join(side, f"suffix{n}", "left")
    filled = {f"suffix{n}_rate": rate for n in (1, 2)} | {f"suffix{n}_log_n": 0.0 for n in (1, 2)}
    return df.fillna(filled).drop("suffix1", "suffix2")


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", most_urls: int = TRAIN_URLS) -> Model | None:
    """Train on URLs labelled 0 or 1, at most ``most_urls`` distinct ones by hash; None without both labels.

    The suffix statistics count all distinct labelled URLs.  A URL's own label is left out of the suffix statistics that it is trained with.
    """
    rows = labelled.select(F.col(url).cast("string").alias("url"), F.col(blocked).cast("int").alias("blocked"))
    rows = rows.filter("url IS NOT NULL AND blocked IN (0, 1)").dropDuplicates(["url", "blocked"])
    known = materialize(rows, "labelled")
    place = F.shiftrightunsigned(F.xxhash64("url"), 11).cast("double") / float(1 << 53)
    rows = known.df.filter(place < min(1.0, most_urls / max(known.rows, 1)))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    sample = materialize(rows, "urls")
    labels = sample.df.agg(F.countDistinct("blocked")).first()[0]
    if labels < 2:
        return None
    rate = known.df.agg(F.avg("blocked")).first()[0]
    hosts = known.df.select("blocked", host_of(F.col("url")).alias("host"))
    ends = hosts.select("blocked", F.explode(F.array_distinct(F.array(suffix_of(F.col("host"), 1), suffix_of(F.col("host"), 2)))).alias("suffix"))
    sums = materialize(ends.groupBy("suffix").agg(F.sum("blocked").alias("bad"), F.count(F.lit(1)).alias("n")), "suffixes").df
    stats = sums.select("suffix", ((F.col("bad") + PRIOR * rate) / (F.col("n") + PRIOR)).alias("rate"), F.log1p("n").alias("log_n"))
    ready = _with_suffixes(lexical(sample.df, "url", "host", "path"), "host", stats, rate)
    n1, n2 = (F.expm1(f"suffix{n}_log_n") for n in (1, 2))
    without = lambda n, c: (F.col(c) * (n + PRIOR) - F.col("blocked")) / (n + PRIOR - 1)
    ready = ready.withColumn("suffix1_rate", without(n1, "suffix1_rate")).withColumn("suffix2_rate", without(n2, "suffix2_rate"))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready.select("blocked", *FEATURES))
    assembled = materialize(assembled.select("blocked", "features"), "features").df
    trees = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(assembled)
    return Model(trees, stats, rate)


def judge(df: DataFrame, rules: list[Rule], model: Model | None, url: str = "url") -> DataFrame:
    """All columns plus ``host, path, rule, verdict, block_score``.

    A fitting rule decides; else the trees do (block from a score of 0.5), and
    without a model the verdict is allow.  Null URLs and URLs without ``://``
    have empty host and path and are judged by the trees.  Columns of these
    names are replaced; rows are neither joined by the URL nor reordered into
    groups by it; suffixes are joined.
    """
    kept = df.drop("host", "path", "rule", "verdict", "block_score")
    own = {c: free_name(kept, f"url_{c}") for c in ("host", "path", "rule")}
    address = F.col(url).cast("string")
    ready = kept.withColumn(own["host"], host_of(address)).withColumn(own["path"], path_of(address))
    ready = ready.withColumn(own["rule"], rule_of(F.col(own["host"]), F.col(own["path"]), rules))
    score = F.lit(0.0)
    if model is not None:
        # the trees see a struct of the row and its features, so no column of df can clash
        packed = F.struct(*[F.col(f"`{c}`") for c in ready.columns]).alias("row")
        ready = ready.select(packed, address.alias("url"), F.col(own["host"]).alias("host"), F.col(own["path"]).alias("path"))
        ready = _with_suffixes(lexical(ready, "url", "host", "path"), "host", model.suffixes, model.rate)
        ready = model.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready))
        ready = ready.select("row.*", vector_to_array("probability")[1].alias("block_score"))
        score = F.col("block_score")
    host, path, rule = (F.col(own[c]) for c in ("host", "path", "rule"))
    verdict = F.coalesce(rule["verdict"], F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return ready.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        host.alias("host"),
        path.alias("path"),
        rule["rule"].alias("rule"),
        verdict.alias("verdict"),
        score.alias("block_score"),
    )
