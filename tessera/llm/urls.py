r"""URL filters: ordered allow and block rules, and gradient-boosted trees on lexical
features for the URLs that no rule covers.  DataFrame functions only.

Features are lengths, depths, ratios, entropies, parameter counts and, for the suffix
of the host, the smoothed share of bad URLs among labelled ones with that suffix.  The
trees are trained on a bounded sample of labelled URLs: the ``sample`` rows of each
label with the smallest hashes.

Defined results.  Where the url is null or has no ``://``, host and path are empty and
no rule fits; the trees judge it by the features of an empty url.  Where labelled URLs
of one class are missing, the method allows.  Rows are judged one by one.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosting:
    #: Labelled URLs per label that training reads.
    sample: int = 2000
    rounds: int = 8
    depth: int = 3
    seed: int = 11


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules: list[UrlRule], url_col: str = "url") -> DataFrame:
    """Adds _host, _path, _rule and _ruled (the rule's verdict); the longest rule that fits wins."""
    out = pages.withColumn("_url", F.coalesce(F.col(url_col), F.lit("")))
    host, path = parts(F.col("_url"))
    out = out.withColumn("_host", host).withColumn("_path", path)
    if not rules:
        return out.withColumn("_rule", F.lit(None).cast("string")).withColumn("_ruled", F.lit(None).cast("string"))
    table = F.array(*(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))))
    dotted = F.concat(F.lit("."), F.col("_host"))
    fits = F.filter(table, lambda r: F.endswith(dotted, F.concat(F.lit("."), r["host"])) & F.startswith(F.col("_path"), r["path"]))
    best = F.try_element_at(fits, F.lit(1))
    return out.withColumn("_rule", best["name"]).withColumn("_ruled", best["verdict"])


def _entropy(name: str) -> Column:
    share = lambda c: (F.length(name) - F.length(F.replace(F.col(name), c, F.lit("")))) / F.length(name)
    return F.aggregate(F.array_distinct(F.split(F.col(name), "")), F.lit(0.0), lambda x, c: x - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def _many(name: str, characters: str) -> Column:
    return (F.length(name) - F.length(F.regexp_replace(F.col(name), f"[{characters}]", ""))).cast("double")


#: Names of the features; the last one needs statistics of labelled URLs.
FEATURES = ["f_length", "f_host", "f_path", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_host_entropy", "f_path_entropy", "f_params", "f_hyphens", "f_secure", "f_fragment", "f_extension", "f_longest", "f_suffix"]


def with_features(urls: DataFrame) -> DataFrame:
    """Adds all features but the suffix statistic, and _suffix, to rows with _url, _host and _path."""
    length = F.greatest(F.length("_url"), F.lit(1))
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    return urls.select(
        "*",
        F.length("_url").cast("double").alias("f_length"), F.length("_host").cast("double").alias("f_host"), F.length("_path").cast("double").alias("f_path"),
        _many("_host", ".").alias("f_labels"), _many("_path", "/").alias("f_depth"), (_many("_url", "0-9") / length).alias("f_digits"), _many("_host", "0-9").alias("f_host_digits"),
        F.coalesce(_entropy("_host"), F.lit(0.0)).alias("f_host_entropy"), F.coalesce(_entropy("_path"), F.lit(0.0)).alias("f_path_entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("f_params"), _many("_host", "-").alias("f_hyphens"),
        F.startswith("_url", F.lit("https://")).cast("double").alias("f_secure"), F.contains("_url", F.lit("#")).cast("double").alias("f_fragment"),
        F.col("_path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double").alias("f_extension"),
        F.array_max(F.transform(F.split("_host", r"\."), lambda x: F.length(x))).cast("double").alias("f_longest"),
        F.substring_index("_host", ".", -1).alias("_suffix"),
    )


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    prior: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds _bad, the probability of a bad URL, to rows with _url, _host and _path."""
        if self.trees is None:
            return rows.withColumn("_bad", F.lit(0.0))
        met = with_features(rows).join(self.suffixes, "_suffix", "left").withColumn("f_suffix", F.coalesce("_share", F.lit(self.prior)))
        out = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(met))
        return out.select(*rows.columns, vector_to_array("probability")[1].alias("_bad"))


def _sampled(rows: DataFrame, p: Boosting) -> DataFrame:
    """The ``sample`` different URLs of each label with the smallest hashes.

    Rows are first cut by a bound on the hash below which each label is expected to have many times as many; only those
    are shuffled.  A label that has fewer URLs below the bound, as its rows repeat them, is cut by no bound.
    """
    place = F.shiftrightunsigned(F.xxhash64("_url"), 12)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    bound = lambda n: min(1.0, 16 * p.sample / n)
    below = lambda bounds: reduce(lambda c, x: c | x, ((F.col("label") == label) & (place <= int(share * (1 << 52))) for label, share in bounds.items()), F.lit(False))
    bounds = {label: bound(n) for label, n in sizes.items()}
    if any(share < 1 for share in bounds.values()):
        found = {r.label: r["count"] for r in rows.where(below(bounds)).distinct().groupBy("label").count().collect()}
        bounds = {label: share if found.get(label, 0) >= p.sample else 1.0 for label, share in bounds.items()}
    order = Window.partitionBy("label").orderBy(place, "_url")
    return rows.where(below(bounds)).distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= p.sample).drop("_k")


def train(labelled: DataFrame, p: Boosting = Boosting(), url_col: str = "url", label_col: str = "label") -> UrlModel:
    """Trees from rows of url and label (1: bad)."""
    host, path = parts(F.col("_url"))
    rows = _sampled(labelled.select(F.col(url_col).alias("_url"), F.col(label_col).cast("double").alias("label")).where("_url is not null and label is not null"), p)
    rows = with_features(rows.withColumn("_host", host).withColumn("_path", path)).cache()
    try:
        seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if not {0.0, 1.0} <= seen.keys():
            return UrlModel(None, None, 0.0)
        prior = seen[1.0] / sum(seen.values())
        # Smoothed by ten URLs of the prior; at most one row per sampled URL.  In training a URL doesn't count towards its own suffix.
        sums = rows.groupBy("_suffix").agg(F.sum("label").alias("_bad"), F.count(F.lit(1)).alias("_n"))
        suffixes = sums.select("_suffix", ((F.col("_bad") + 10 * prior) / (F.col("_n") + 10)).alias("_share"))
        met = rows.join(sums, "_suffix").withColumn("f_suffix", (F.col("_bad") - F.col("label") + 10 * prior) / (F.col("_n") + 9))
        held = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(met).select("features", "label")
        trees = GBTClassifier(maxIter=p.rounds, maxDepth=p.depth, seed=p.seed, stepSize=0.3).fit(held)
        small = labelled.sparkSession.createDataFrame([(r["_suffix"], r["_share"]) for r in suffixes.collect()], "_suffix string, _share double")
        return UrlModel(trees, small, prior)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, labelled: DataFrame, rules: list[UrlRule], p: Boosting = Boosting(), threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, bad (the method's probability)."""
    model = train(labelled, p)
    rows = with_rules(pages.select(id_col, url_col), rules, url_col)
    out = model.score(rows)
    method = F.when(F.col("_bad") >= threshold, "block").otherwise("allow")
    return out.select(id_col, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_ruled", method).alias("verdict"), F.round("_bad", 4).alias("bad"))
