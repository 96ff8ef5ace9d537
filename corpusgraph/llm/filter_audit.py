"""Filter interaction audit by an existential self-join (operator 13).

1. *Facts*: one scan computes each document's part, the MD5 of its text and the
   bits of the filters that look at one text only (A to D).
2. *Existential self-join*: texts whose hash stands under several ids are joined,
   left semi, with the smallest id of each (hash, exact text); a smaller id there
   marks E.  The smallest ids are combined before the shuffle, so a hot text costs
   a row per task on that side, and AQE splits the other.
3. *Union*: the ids marked E are united with the facts and their bits combined by
   ``bit_or``; rows are then counted by (part, combination), at most 32 a part.
4. *Orders*: every combination is opened to the 120 orders x 5 steps, a fixed list,
   and summed.

The counts need no row numbers: rows that share id, part and text share their bits
too, and count as often as they stand in the table.

Defined results: a null text is empty, a null part the empty string; a null id is
neither smaller nor larger than any other, so such a row never fails E, makes none
fail it and has no labels; rows that repeat an id are documents of their own, none
smaller than the other; of several label rows of an id one that says so is enough;
very long texts are read whole; a table without rows has no parts and so no result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents
from .registry import register

FILTERS = "ABCDE"
#: Bit of the existential filter.
COPY = 1 << FILTERS.index("E")
KEY = ["doc_id", "part", "hash"]


def text_bits(text: Column) -> Column:
    """Bits of the filters A to D, which look at one (non-null) text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * upper.cast("bigint") > 10 * F.length(text),
             text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def copies(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct ``doc_id, part, hash`` of the rows of ``texts`` (``doc_id, part, hash,
    text``) whose very text stands under a smaller id."""
    again = (facts.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
             .where("lo < hi").select("hash"))
    several = materialize(texts.join(again, "hash", "left_semi"), "several")
    # Written, so that nothing but an exchange stands below the join and AQE can split it.
    first = materialize(several.groupBy("hash", "text").agg(F.min("doc_id").alias("first_id")), "first")
    d, f = several.alias("d"), first.alias("f")
    return d.join(f, (F.col("d.hash") == F.col("f.hash")) & (F.col("d.text") == F.col("f.text"))
                  & (F.col("f.first_id") < F.col("d.doc_id")), "left_semi").select(*KEY)


def combinations(docs: DataFrame, labels: DataFrame, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.md5(text.cast("binary")).alias("hash"), text.alias("text"))
    facts = materialize(base.select(*KEY, text_bits(F.col("text")).alias("bits")), "facts")
    marked = facts.select(*KEY, "bits", F.lit(1).alias("one")).unionByName(
        copies(base, facts).select(*KEY, F.lit(COPY).alias("bits"), F.lit(0).alias("one")))
    masks = (marked.groupBy(*KEY).agg(F.bit_or("bits").alias("mask"), F.sum("one").alias("n"))
             .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n"))
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), flag("is_good").alias("good"), flag("is_toxic").alias("toxic"))


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's filter)."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(combos: DataFrame) -> DataFrame:
    """Counts per part, order and step from ``part, mask, n, good, toxic``."""
    # One constant, not 600 expressions that the optimizer would walk through.
    steps = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "before", "bit"), x)) for x in orders()])),
                        "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    opened = combos.select("*", F.explode(steps).alias("at")).select("part", "mask", "n", "good", "toxic", "at.*")
    fails, gone = F.expr("mask & bit") != 0, F.expr("mask & before") != 0
    total = lambda when, col: F.sum(F.when(when, F.col(col)).otherwise(F.lit(0))).cast("bigint")
    # In 120 / |mask| of the orders the filter is the first of those the document fails.
    first = F.expr(f"n * ({len(list(permutations(FILTERS)))} div bit_count(mask))")
    return opened.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, "n").alias("kept"), total(fails & ~gone, "n").alias("removed"),
        total(fails & gone, "n").alias("redundant"), total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, first).otherwise(F.lit(0))).cast("bigint").alias("shapley"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END AS a,
         CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 1 ELSE 0 END AS e
  FROM d),
docs AS (
  SELECT part, [CASE WHEN a = 1 THEN 'A' END, CASE WHEN b = 1 THEN 'B' END, CASE WHEN c = 1 THEN 'C' END,
                CASE WHEN d = 1 THEN 'D' END, CASE WHEN e = 1 THEN 'E' END] AS bad, a + b + c + d + e AS n_bad,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic
  FROM f),
kinds AS (SELECT part, bad, n_bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perms AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS x, string_split(filter_order[1:step - 1], '') AS before
  FROM perms, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN NOT list_has_any(bad, before) AND NOT list_contains(bad, x) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT list_has_any(bad, before) AND list_contains(bad, x) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_has_any(bad, before) AND list_contains(bad, x) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN n_bad = 1 AND list_contains(bad, x) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT list_has_any(bad, before) AND list_contains(bad, x) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT list_has_any(bad, before) AND list_contains(bad, x) THEN toxic ELSE 0 END) AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""


@register("op13_filter_interactions", ORACLE)
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each order, per language of ``documents``."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return audit(combinations(documents(spark, sf_dir), labels))
