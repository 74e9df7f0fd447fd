"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

The rules are parameters. The trees learn from the URLs that a rule decides: the features are length, depth, digit ratio,
entropy, parameter counts and the share of blocked URLs per host suffix. Everything runs on DataFrame functions; the fitted
trees are compiled into one SQL expression, so scoring has no join and no user function.

A null URL, or one without ``://``, has an empty host and path, no rule, and the verdict of the trees. Repeated rows and null
ids are rows like any other; extra columns of the input are not looked at. Without any labelled URL, or with one class only,
every undecided URL gets the only known verdict (``allow`` if there is none).
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

#: Rules of the registered query: (host and path prefix, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
FEATURES = ("url_length", "path_depth", "digit_ratio", "entropy", "n_parameters", "host_labels", "suffix_blocked", "suffix_weight")
#: Host suffixes are counted in so many hash buckets, which bounds what the driver receives.
SUFFIX_BUCKETS = 512
#: At most so many distinct labelled URLs are used to fit the trees, chosen by hash.
TRAINING_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty without ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule whose host is ``host`` or a parent domain of it and whose path starts ``path``, else null."""
    branches = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own_host, slash, own_path = rule.partition("/")
        branches.append(F.when(((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path), F.lit(rule)))
    return F.coalesce(*branches, F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits: run lengths of the sorted characters."""
    chars = F.sort_array(F.split(text, ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(
        chars,
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(
            c.alias("last"),
            F.when(c == s["last"], s["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(c == s["last"], s["sum"]).otherwise(s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)).alias("sum")),
        lambda s: F.log2(F.length(text).cast("double"))
        - (s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)) / F.length(text)))


def _suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.regexp_extract(host, r"[^.]*$", 0)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical_features(df: DataFrame, suffixes: dict[int, tuple[float, float]]) -> DataFrame:
    """``df`` (id, url, host, path) with the columns of ``FEATURES``."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    blocked = F.array(*[F.lit(suffixes.get(b, (0.5, 0.0))[0]) for b in range(SUFFIX_BUCKETS)])
    weight = F.array(*[F.lit(suffixes.get(b, (0.5, 0.0))[1]) for b in range(SUFFIX_BUCKETS)])
    at = _suffix_bucket(host) + 1
    return df.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+")).cast("double").alias("n_parameters"),
        F.regexp_count(host, F.lit(r"[^.]+")).cast("double").alias("host_labels"),
        F.element_at(blocked, at).alias("suffix_blocked"),
        F.element_at(weight, at).alias("suffix_weight"),
    )


def suffix_statistics(labelled: DataFrame) -> dict[int, tuple[float, float]]:
    """Smoothed share of blocked URLs and log count per bucket of the last host label, over all labelled rows."""
    rows = (
        labelled.groupBy(_suffix_bucket(F.col("host")).alias("b"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).collect()
    )
    return {r.b: ((r.blocked + 1.0) / (r.n + 2.0), float(len(str(r.n)))) for r in rows}


def compile_trees(model) -> Column:
    """The fitted ensemble as one expression over the feature columns: true where the verdict is ``block``."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + weight * F.expr(_tree_sql(tree.toDebugString))
    return total > 0


def _tree_sql(described: str) -> str:
    """SQL of one described tree; the lines are ``If (feature i <= x)``, ``Else (...)`` and ``Predict: y``, indented by depth."""
    lines = [line.strip() for line in described.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]

    def read(at: int) -> tuple[str, int]:
        if lines[at].startswith("Predict"):
            return f"{float(lines[at].split(':')[1])!r}D", at + 1
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        yes, at = read(at + 1)
        no, at = read(at + 1)
        return f"if({FEATURES[int(feature)]} <= {float(cut)!r}D, {yes}, {no})", at

    return read(0)[0]


def fit_trees(labelled: DataFrame, suffixes: dict[int, tuple[float, float]], rows: int = TRAINING_ROWS) -> Column:
    """Boosted trees from at most ``rows`` distinct labelled URLs (columns id, url, host, path, label); the label 1 means blocked."""
    # host, path and label follow from the URL
    distinct = labelled.groupBy("url", "host", "path", "label").agg(F.min("id").alias("id"))
    chosen = distinct.orderBy(F.xxhash64("url"), "url").limit(rows)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(lexical_features(chosen, suffixes))
    table = table.select("features", F.col("label").cast("double").alias("label")).coalesce(4).cache()
    try:
        classes = [r.label for r in table.select("label").distinct().collect()]
        if len(classes) < 2:
            return F.lit(bool(classes and classes[0] == 1.0))
        return compile_trees(GBTClassifier(maxIter=10, maxDepth=4, maxBins=32, seed=7, maxMemoryInMB=64).fit(table))
    finally:
        table.unpersist()


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Id, host, path, rule and verdict of every row, and the features the trees saw."""
    url = F.col(url_col).cast("string")
    host, path = split_url(url)
    parsed = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    decided = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))
    ruled = ruled.withColumn("decided", decided)
    labelled = ruled.where("decided is not null").select("id", "url", "host", "path", (F.col("decided") == "block").cast("int").alias("label"))
    suffixes = suffix_statistics(labelled)
    blocked = fit_trees(labelled, suffixes, training_rows)
    return lexical_features(ruled, suffixes).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("decided", F.when(blocked, "block").otherwise("allow")).alias("verdict"), *FEATURES)
