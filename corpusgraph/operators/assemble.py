"""Ordering and assembly of bundles (O1, B1).

The reference prints sections in this order: imports, const blocks, vars,
types, then functions sorted by key with ``main``/``init`` last.  Here the
order is a set of columns; ``bundle_order`` numbers rows with the distributed
:func:`group_ordinal`, ``assemble_text`` joins them to :func:`ordered_parts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ROWS_PER_PART, group_ordinal, ordered_parts

# Section order of a bundle (the reference emits imports, const
# blocks, vars, types, then functions; root functions come last).
SECTION_RANK = {"import": 0, "const": 1, "var": 2, "type": 3, "func": 4}


def section_rank(kind_col: str = "kind"):
    return F.coalesce(*[F.when(F.col(kind_col) == k, F.lit(r)) for k, r in SECTION_RANK.items()],
                      F.lit(len(SECTION_RANK)))


def bundle_order(specs: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                 out: str = "ord") -> DataFrame:
    """O1: position of every spec inside its bundle, by ``order_cols``.

    ``natural`` order passes (section, is_root, path, line, col); the
    reference's ``lexicographic`` order passes the key string instead.
    """
    return group_ordinal(specs, group_cols, order_cols, out=out)


def assemble_text(parts: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  text_col: str = "text", sep: str = "\n", out: str = "text",
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """B1: each group's text in order, joined with ``sep``, as numbered parts of at
    most ``rows_per_part`` rows: ``group_cols, part, n_parts`` (rows in it)
    ``, n_bytes, out``.  Written part by part (S6) they are the group's text."""
    text = ordered_parts(parts, group_cols, order_cols, text_col, sep, out, rows_per_part)
    return text.select(*group_cols, "part", F.col("n_rows").alias("n_parts"),
                       F.octet_length(out).cast("bigint").alias("n_bytes"), out)
