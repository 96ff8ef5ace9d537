"""URL filter: rules first, gradient-boosted trees for the rest (operator 2;
DataFrame and SQL functions and Spark's own learner only).

A rule is a host, for itself and its subdomains, and the start of a path; the
longest fitting rule wins.  Urls that a rule judges are the labelled ones.  Trees
are fitted on lexical features - lengths, depth, labels, share of digits, entropy,
parameter counts, and two statistics of the host's suffix (how many labelled urls
have it, and their smoothed share of blocks) - of at most ``TRAIN_ROWS`` labelled
urls, drawn by a hash; the suffix statistics count all of them, but a labelled url's come
from the folds of other hosts.

Defined results: a null url or one without ``://`` has an empty host and path and is
judged by the trees; without labelled urls the verdict is ``allow``, with labels of
one kind only it is that kind; repeated rows each get their row; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .registry import register

#: The rules to apply, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Bound of the training sample.
TRAIN_ROWS = 50_000
ROUNDS, DEPTH, SEED = 12, 4, 5
#: Weight of the overall share of blocks in a suffix's share.
SMOOTHING = 10.0
#: Folds of hosts for the suffix statistics.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_share", "entropy",
            "parameters", "has_fragment", "is_https", "suffix_count", "suffix_block")

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/")
        own, start = text[:cut], text[cut:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character."""
    counted = F.transform(F.array_distinct(F.split(text, "")), lambda c: (
        F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.aggregate(F.filter(counted, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (with ``url, host, path``) and the features that a url alone gives."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return pages.select(
        "*", F.substring_index("host", ".", -1).alias("suffix"), size.cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").alias("depth"), _count(F.col("host"), r"\.").alias("labels"),
        _count(F.col("host"), "-").alias("hyphens"),
        F.when(size > 0, _count(url, "[0-9]") / size).otherwise(0.0).alias("digit_share"),
        F.when(size > 0, entropy(url)).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("parameters"),
        url.contains("#").cast("double").alias("has_fragment"),
        url.startswith("https:").cast("double").alias("is_https"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", id_col: str = "page_id",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; ``score`` is the
    trees' probability of a block."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialize(lexical(base.select("*", rule.alias("rule"), verdict.alias("ruled"))), "urls")

    block = (F.col("ruled") == "block").cast("double")
    known = rows.where("ruled IS NOT NULL")
    n, blocked = known.agg(F.count(F.lit(1)), F.sum(block)).first()
    if not n or blocked in (0, n):
        return rows.select("page_id", "host", "path", "rule", F.coalesce(
            "ruled", F.lit("block" if n and blocked else "allow")).alias("verdict"),
            F.lit(float(bool(blocked))).alias("score"))
    # Suffix statistics of a labelled url come from the other hosts' folds, so that its own
    # label is not among its features; an unlabelled one (fold -1) takes those of all folds.
    fold = F.when(F.col("ruled").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    overall = blocked / n
    per_fold = known.groupBy("suffix", fold.alias("fold")).agg(F.count(F.lit(1)).alias("k"), F.sum(block).alias("b"))
    # A suffix has at most FOLDS of these rows.
    per_fold = per_fold.groupBy("suffix").agg(F.collect_list(F.struct("fold", "k", "b")).alias("folds"))
    rows = rows.withColumn("fold", fold.cast("bigint")).join(per_fold, "suffix", "left")
    others = F.filter(F.coalesce("folds", F.array().cast("array<struct<fold:bigint,k:bigint,b:double>>")),
                      lambda x: x["fold"] != F.col("fold"))
    k = F.aggregate(others, F.lit(0.0), lambda s, x: s + x["k"])
    b = F.aggregate(others, F.lit(0.0), lambda s, x: s + x["b"])
    rows = rows.withColumns({"suffix_count": F.log2(k + 1.0),
                             "suffix_block": (b + SMOOTHING * overall) / (k + SMOOTHING)}).drop("folds", "fold")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = (rows.where("ruled IS NOT NULL").where(draw < train_rows / n)
              .select("features", block.alias("label")))
    if sample.select("label").distinct().count() < 2:  # one kind was drawn: learn from all
        sample = rows.where("ruled IS NOT NULL").select("features", block.alias("label"))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED).fit(sample)
    scored = trees.transform(rows)
    by_trees = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"),
                         F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


@register("op2_gbt_urls")
def op2_gbt_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return judge(pages).drop("score")
