"""URL filter: allow and block rules, and gradient-boosted trees on lexical features where no rule fits.

Everything is DataFrame functions and Spark's own trees. The rules label the URLs they fit; a bounded
sample of those trains the trees.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.scratch import stage

#: The most labelled URLs that train the trees; number and depth of the trees.
LEARN_ROWS, TREES, DEPTH, SEED = 10_000, 20, 4, 11
#: Labelled URLs that the overall rate of blocking stands for when a suffix is rare.
PRIOR = 5.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the start of a path; it fits the host itself and all its subdomains."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        own_host, slash, rest = self.text.partition("/")
        return ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)


def judged_by_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` (with host and path) and ``rule``, ``ruled``: text and verdict of the longest rule that fits, else null.

    The rules are part of the expression: meant for lists of up to some hundreds.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    host, path = F.col("host"), F.col("path")

    def first(value) -> Column:
        return F.coalesce(*[F.when(r.fits(host, path), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))

    return df.withColumn("rule", first(lambda r: r.text)).withColumn("ruled", first(lambda r: r.verdict))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def lexical_features(df: DataFrame) -> DataFrame:
    """Adds lexical columns to ``df`` (with url, host and path) and the last one and two labels of the host."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, string.digits, ""))
    return df.withColumns(
        {
            "f_length": F.length(url),
            "f_host_length": F.length(host),
            "f_path_length": F.length(path),
            "f_depth": _count(path, "/"),
            "f_labels": _count(host, "."),
            "f_hyphens": _count(url, "-"),
            "f_digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
            "f_entropy": _entropy(url),
            "f_host_entropy": _entropy(host),
            "f_parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
            "suffix_1": F.substring_index(host, ".", -1),
            "suffix_2": F.substring_index(host, ".", -2),
        }
    )


FEATURES = "f_length f_host_length f_path_length f_depth f_labels f_hyphens f_digit_ratio f_entropy f_host_entropy f_parameters f_suffix_1 f_suffix_2".split()


@dataclass
class UrlModel:
    """Trees, the blocked share by suffix and overall, of all labelled URLs."""

    trees: GBTClassificationModel | None
    shares: dict[str, DataFrame]
    overall: float

    def featured(self, df: DataFrame) -> DataFrame:
        out = lexical_features(df)
        for name, share in self.shares.items():
            out = out.join(share, name, "left").fillna(self.overall, [f"f_{name}"])
        return out

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds ``block_score`` (0 to 1). With one class among the labels there are no trees and it is that class."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(float(self.overall > 0.5)))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(self.featured(df))
        return self.trees.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])


def learn(labelled: DataFrame, learn_rows: int = LEARN_ROWS) -> UrlModel:
    """Learns from distinct URLs of ``labelled`` (url, host, path, ruled): shares by suffix from all, trees from at most ``learn_rows``, those that hash lowest."""
    distinct = labelled.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label")).dropDuplicates(["url"])
    counts = lexical_features(distinct).groupBy("suffix_1", "suffix_2").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    counts = stage(counts, "suffixes")
    n, blocked = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    overall = blocked / n if n else 0.0
    shares = {}
    for name in ("suffix_1", "suffix_2"):
        totals = counts.groupBy(name).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        shares[name] = stage(totals.select(name, ((F.col("b") + PRIOR * overall) / (F.col("n") + PRIOR)).alias(f"f_{name}")), "suffixes")
    model = UrlModel(None, shares, overall)
    rows = stage(distinct.orderBy(F.xxhash64("url"), "url").limit(learn_rows), "urls")
    if rows.select("label").distinct().count() == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(model.featured(rows))
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, checkpointInterval=-1, seed=SEED)
        model.trees = trees.fit(stage(vectors.select("features", "label"), "vectors"))
    return model


def filter_urls(df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score``, a row per input row.

    ``verdict`` is 'allow' or 'block': the rule's where one fits, else the trees' (block from a score
    of 0.5). Null URLs and such without '://' have an empty host and path and are judged as empty
    ones. Repeated rows are judged alike; other columns are ignored; an empty table gives an empty
    result; without labelled URLs everything unruled is allowed.
    """
    host, path = host_and_path(F.col("url"))
    source = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    ruled = judged_by_rules(source.withColumns({"host": host, "path": path}), rules)
    scored = learn(ruled).scored(ruled)
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"), "block_score")
