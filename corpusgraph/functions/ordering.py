"""Ordering inside groups that may be huge.

A ``Window.partitionBy(group).orderBy(...)`` puts every row of a group into one
task.  When one corpus can hold a third of all rows that is a single-task
stage.  The helpers here split a group over range partitions instead:

* :func:`group_ordinal` — exact 1-based row number within a group, computed as
  "rows of this group in earlier range partitions" + "position inside this
  partition" (a zipWithIndex done with DataFrame operators).
* :func:`fill_forward` — the last value at or before each row, carried over partitions.
* :func:`ordered_parts` — a group's text in order, as numbered parts of a
  bounded number of rows; no cell ever holds a whole group.

:func:`concat_in_order` is for groups that are bounded by their nature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one part of an ordered text.
ROWS_PER_PART = 1000


def _n_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def group_ordinal(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  out: str = "ord", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its group, ordered by
    ``order_cols`` (which should be unique within the group for a stable
    result, as a ``row_number()`` would need too).

    The range layout is written once and both the counts and the rows are read
    from it: planned twice, the two branches would sample their own bounds and
    the numbers would not fit each other.  No task holds more than one range
    partition, however large a single group is.  Null groups are groups.
    """
    ranged, stats = _ranged(df, group_cols, order_cols, partitions)
    joined = null_safe_join(ranged, stats.select(*group_cols, "_pid", "_first", "_off"), [*group_cols, "_pid"])
    return (joined
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_first", "_off"))


def _ranged(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], partitions: int | None = None,
            *aggs: Column) -> tuple[DataFrame, DataFrame]:
    """The rows in written range partitions (``_pid``, and ``_mid`` rising within one), and per group
    and partition ``_first``, ``_off`` (the group's rows in earlier partitions) and ``aggs``."""
    n = _n_partitions(df, partitions)
    keys = _cols([*group_cols, *order_cols])
    ranged = materialize(df.repartitionByRange(n, *keys)
                         .sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "ranged")
    # At most (#partitions a group spans) rows per group: small, safe to window.
    stats = ranged.groupBy(*group_cols, "_pid").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"), *aggs)
    before = _earlier(group_cols)
    return ranged, stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _earlier(group_cols: Sequence[str]):
    spec = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    return spec.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)


def fill_forward(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                 out: str = "carried", ord_col: str = "ord", from_col: str = "from_ord") -> DataFrame:
    """Add ``out``, the last non-null ``value_col`` at or before each row of its group, ``ord_col``, the
    row's place (from 1), and ``from_col``, the place that value stands at (both null before the first).

    In two levels, so that no task holds a group: inside a range partition by a window, and over the
    partitions of a group by a window over one row each.  Ties of ``order_cols`` are in any order;
    null groups are groups.
    """
    last = F.max_by(F.struct(F.col(value_col).alias("v"), F.col("_mid").alias("m")),
                    F.when(F.col(value_col).isNotNull(), F.col("_mid")))
    ranged, stats = _ranged(df, group_cols, order_cols, None, last.alias("_l"))
    stats = stats.withColumn("_l", F.when(F.col("_l").isNotNull(), F.struct(
        F.col("_l.v").alias("v"), (F.col("_off") + F.col("_l.m") - F.col("_first") + 1).alias("o"))))
    stats = stats.withColumn("_held", F.last("_l", ignorenulls=True).over(_earlier(group_cols)))
    j = null_safe_join(ranged, stats.select(*group_cols, "_pid", "_first", "_off", "_held"), [*group_cols, "_pid"])
    j = j.withColumn(ord_col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
    own = F.when(F.col(value_col).isNotNull(), F.struct(F.col(value_col).alias("v"), F.col(ord_col).alias("o")))
    upto = Window.partitionBy(*group_cols, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_held", F.coalesce(F.last(own, ignorenulls=True).over(upto), F.col("_held")))
    return (j.withColumn(out, F.col("_held.v")).withColumn(from_col, F.col("_held.o").cast("bigint"))
            .drop("_pid", "_mid", "_first", "_off", "_held"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-null ``on``; keeps the left side's columns of them."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [left[c].eqNullSafe(named[f"_r_{c}"]) for c in on]
    return left.join(named, cond, how).drop(*[f"_r_{c}" for c in on])


def concat_in_order(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                    sep: str = "\n", out: str = "text") -> DataFrame:
    """One row per group: non-null ``value_col`` joined with ``sep`` in order.  For
    groups bounded by their nature only (the specs of one declaration, one part)."""
    cell = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], F.col(value_col).alias("_v"))
    return df.where(F.col(value_col).isNotNull()).groupBy(*group_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda s: s["_v"]), sep).alias(out),
        F.count(F.lit(1)).cast("bigint").alias("_n")).select(*group_cols, out, F.col("_n").alias("n_rows"))


def ordered_parts(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                  sep: str = "\n", out: str = "text", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The group's non-null values in order, joined with ``sep`` to parts of at most
    ``rows_per_part`` rows: ``group_cols, part`` (from 0) ``, out, n_rows``.  A group's
    text is its parts in order, joined with ``sep``."""
    ranked = group_ordinal(df.where(F.col(value_col).isNotNull()), group_cols, order_cols, out="_ord")
    ranked = ranked.withColumn("part", F.floor((F.col("_ord") - 1) / F.lit(rows_per_part)).cast("bigint"))
    return concat_in_order(ranked, [*group_cols, "part"], ["_ord"], value_col, sep, out)
