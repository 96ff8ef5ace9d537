"""Symbol tables: keys, de-duplication policies, universes and lookups
(P9, A1-A7, U1, J1, J2, J5, J7, J9).

All operators are keyed by caller-given columns so they run unchanged on code
specs and on the driver-table adapters.  Aggregations use ``max_by``/``min_by``
and ``bool_or`` so partial (map-side) aggregation absorbs hot keys; nothing
collects a whole group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import null_safe_join, ordered_parts
from ..session import ensure_checkpoint_dir, materialize


def _order_struct(order_cols: Sequence[str]):
    return F.struct(*[F.col(c) for c in order_cols])


# ---------------------------------------------------------------- P9 / J1 / U1

def identifier_refs(units: DataFrame, key_cols: Sequence[str], words_col: str,
                    ref: str = "ref") -> DataFrame:
    """Every distinct identifier mentioned by a unit."""
    return units.select(*key_cols, F.explode(words_col).alias(ref)).distinct()


def known_refs(refs: DataFrame, symbols: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep only mentions of known symbols (``left_semi``)."""
    return refs.join(symbols.select(*on).distinct(), list(on), "left_semi")


#: Parts that the mentions of one word are dealt to, by a hash of who mentions it.
MENTION_PARTS = 4


def _dealt(refs: DataFrame, symbols: DataFrame, on: Sequence[str], by: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """``refs`` dealt by ``on`` and ``_part`` (a hash of ``by``), and every row of ``symbols`` for each
    part, to be hashed: what is joined on ``on, _part`` moves once and is not sorted, and a word
    that everything mentions is no single task."""
    part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
    each = symbols.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return refs.withColumn("_part", part).repartition(*on, "_part"), each.hint("shuffle_hash")


def distinct_known_refs(refs: DataFrame, symbols: DataFrame, on: Sequence[str], by: str,
                        parts: int = MENTION_PARTS) -> DataFrame:
    """J1 on references with repeats: the distinct ``on, by`` whose ``on`` is a symbol.  One
    shuffle serves the lookup and the distinct, and only known references are made distinct."""
    dealt, known = _dealt(refs.select(*on, by), symbols.select(*on).distinct(), on, by, parts)
    return dealt.join(known, [*on, "_part"], "left_semi").distinct().drop("_part")


def symbol_universe(*frames: DataFrame, name: str = "name") -> DataFrame:
    """Distinct union of the name columns of several tables."""
    out = None
    for f in frames:
        one = f.select(F.col(f.columns[0]).alias(name)) if name not in f.columns else f.select(name)
        out = one if out is None else out.unionByName(one)
    return out.where(F.col(name).isNotNull()).distinct()


# ---------------------------------------------------------------- A1 / A2 / A3

def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A1: the row with the greatest ``order`` per ``key`` (map assignment, last wins)."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), _order_struct(order))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A2 fast path for single-name specs: first row per key."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), _order_struct(order))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*")


def keep_first_greedy(specs: DataFrame, group_cols: Sequence[str], spec_col: str,
                      order_col: str, names_col: str, max_rounds: int | None = None) -> DataFrame:
    """A2: a spec is kept only if none of its names belongs to an earlier *kept*
    spec of the same group; names of dropped specs do not block anything.

    Exact and distributed, without collecting a group.  In a round, the first undecided
    spec of every name is found; a spec that is first for all its names is kept, and every
    undecided spec that holds a name of a kept one is decided with it.  So the first
    undecided spec of every group is decided in each round (usually whole runs are).
    Decisions are only ever appended; the worklist of undecided specs is written anew
    when half of it is decided, so that all rounds together write at most three rows for
    each spec.  Per-name minima are map-side aggregates, so a name shared by a third of
    all specs is no hot task.  Returns ``specs`` plus boolean ``kept``.
    ``_`` is not a name (it never blocks); a null group is a group of its own.
    """
    ensure_checkpoint_dir(specs.sparkSession)
    ids = list(dict.fromkeys([*group_cols, spec_col, order_col]))
    names = F.filter(F.coalesce(F.col(names_col), F.array().cast("array<string>")), lambda n: n != "_")
    group = F.struct(*group_cols) if group_cols else F.lit(0)
    # Structs compare null fields as equal, so null groups and ids join like others.
    work, n_open = materialize(
        specs.select(group.alias("_g"), F.struct(*ids).alias("_id"), F.col(order_col).alias("_o"), names.alias("_names"))
        .where(F.size("_names") > 0), "greedy_work", with_count=True)
    decided, recent, n_recent, rnd = None, None, 0, 0
    while n_open:
        rnd += 1
        if max_rounds is not None and rnd > max_rounds:
            raise RuntimeError(f"greedy policy did not converge within {max_rounds} rounds")
        open_ = work if recent is None else work.join(recent, "_id", "left_anti")
        if recent is not None and 2 * n_recent >= n_open:
            work, n_open = materialize(open_, "greedy_work", with_count=True)
            open_, recent, n_recent = work, None, 0
            if not n_open:
                break
        each = open_.select("_g", "_id", "_o", F.explode("_names").alias("_name"))
        first = each.groupBy("_g", "_name").agg(F.min("_o").alias("_first"))
        winners = (each.join(first, ["_g", "_name"]).groupBy("_g", "_id")
                   .agg(F.bool_and(F.col("_first") == F.col("_o")).alias("_keep"), F.collect_set("_name").alias("_names"))
                   .where("_keep"))
        taken = winners.select("_g", F.col("_id").alias("_by"), F.explode("_names").alias("_name"))
        step = (each.join(taken, ["_g", "_name"]).groupBy("_id")
                .agg(F.bool_or(F.col("_id") == F.col("_by")).alias("_kept")))
        step, n_new = materialize(step, f"greedy_decided{rnd}", with_count=True)
        if not n_new:
            break
        decided = step if decided is None else decided.unionByName(step)
        recent = step.select("_id") if recent is None else recent.unionByName(step.select("_id"))
        n_recent += n_new
    if decided is None:
        return specs.withColumn("kept", F.lit(True))
    return (specs.withColumn("_id", F.struct(*ids)).join(decided.where("_kept").distinct(), "_id", "left")
            .withColumn("kept", F.coalesce("_kept", F.size(names) == 0)).drop("_id", "_kept"))


def distinct_on(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """A3: one row per key (imports by path)."""
    return df.dropDuplicates(list(key))


# ---------------------------------------------------------------- A4-A7

def methods_by_type(funcs: DataFrame, type_cols: Sequence[str], method_col: str,
                    out: str = "methods", sep: str = ",") -> DataFrame:
    """A4: type -> its method keys, sorted and ``sep``-joined, in numbered parts
    (``part`` from 0), so that a type with millions of methods is no single cell.
    Duplicates are kept."""
    return ordered_parts(funcs.withColumn("_m", F.col(method_col).cast("string")),
                         type_cols, [method_col], "_m", sep=sep, out=out)


def name_multimap(decls: DataFrame, name: str, by: str) -> DataFrame:
    """A5: names declared more than once: number of declarations and of
    distinct ``by`` values (the clash report)."""
    return (decls.groupBy(name)
            .agg(F.count(F.lit(1)).alias("n_units"),
                 F.countDistinct(by).alias("n_sources"))
            .where(F.col("n_units") > 1)
            .select(name, F.col("n_units").cast("bigint"), F.col("n_sources").cast("bigint")))


def block_any(rows: DataFrame, block_cols: Sequence[str], flag: Column | str,
              out: str = "block_used") -> DataFrame:
    """A block counts as used when any of its members is.

    ``bool_or`` per block is aggregated map-side and joined back, instead of a
    window over the block (a hot block would be one task for the window).
    """
    flag_col = F.col(flag) if isinstance(flag, str) else flag
    per_block = rows.groupBy(*block_cols).agg(F.bool_or(flag_col).alias(out))
    return null_safe_join(rows, per_block, block_cols)


def exists_by_name(left: DataFrame, right: DataFrame, on: Sequence[str],
                   out: str = "exists") -> DataFrame:
    """Does ``right`` hold a row with the same ``on`` values."""
    marks = right.select(*on).distinct().withColumn(out, F.lit(True))
    return (left.join(marks, list(on), "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(False))))


# ---------------------------------------------------------------- J2 / J5 / J7 / J9

def resolve_key_or_name(refs: DataFrame, by_key: DataFrame, by_name: DataFrame,
                        key_on: Sequence[str], name_on: Sequence[str],
                        key_target: str, name_target: str, out: str = "target") -> DataFrame:
    """Look a reference up by its full key, else by its bare name.

    ``by_key``/``by_name`` must hold one row per lookup key (use A1/A5 first).
    Two left joins + ``coalesce``; ``status`` tells which one hit.
    """
    k = by_key.select(*key_on, F.col(key_target).alias("_kt"))
    n = by_name.select(*name_on, F.col(name_target).alias("_nt"))
    j = refs.join(k, list(key_on), "left").join(n, list(name_on), "left")
    return (j.withColumn(out, F.coalesce("_kt", "_nt"))
            .withColumn("status", F.when(F.col("_kt").isNotNull(), "key")
                        .when(F.col("_nt").isNotNull(), "name").otherwise("missing"))
            .drop("_kt", "_nt"))


def resolve_distinct_refs(refs: DataFrame, by_key: DataFrame, by_name: DataFrame, key_on: Sequence[str],
                          name_on: Sequence[str], by: str, key_target: str, name_target: str, out: str = "target",
                          parts: int = MENTION_PARTS) -> DataFrame:
    """J2 on references with repeats: :func:`resolve_key_or_name` of the distinct ``key_on, by``.
    One shuffle serves the distinct and the lookup by key, no lookup sorts."""
    dealt, keys = _dealt(refs.select(*key_on, by), by_key, key_on, by, parts)
    return resolve_key_or_name(dealt.distinct(), keys, by_name.hint("shuffle_hash"), [*key_on, "_part"], name_on,
                               key_target, name_target, out).drop("_part")


def merge_if_absent(base: DataFrame, extra: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add only the rows of ``extra`` whose key is not in ``base`` yet."""
    return base.unionByName(extra.join(base.select(*key).distinct(), list(key), "left_anti"))


def provider_index(decls: DataFrame, key: Sequence[str], kind: str,
                   kind_rank: dict[str, int], provider: str | None = None) -> DataFrame:
    """Name -> (provider, kind).  A higher-ranked kind overrides a lower one
    (reference order var < type < func < const); ties go to the smallest
    provider.  ``max_by`` over a struct, aggregated map-side."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(r)) for k, r in kind_rank.items()],
                      F.lit(-1))
    # Highest rank first, then the smallest provider (or kind) within that rank.
    tie = F.col(provider or kind)
    best = F.min_by(F.struct(*[F.col(c) for c in ([provider] if provider else []) + [kind]]), F.struct(-rank, tie))
    return decls.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*")


def type_method_edges(types: DataFrame, methods: DataFrame, group_cols: Sequence[str],
                      type_col: str, recv_col: str, method_key: str) -> DataFrame:
    """An edge type -> method key for every method whose receiver is the type."""
    t = types.select(*group_cols, F.col(type_col).alias("src")).distinct()
    m = methods.select(*group_cols, F.col(recv_col).alias("src"), F.col(method_key).alias("dst"))
    return t.join(m, [*group_cols, "src"]).select(*group_cols, "src", "dst",
                                                  F.lit("method").alias("rule"))


def block_steps(rows: DataFrame, group_cols: Sequence[str], block: str, key: str) -> tuple[DataFrame, DataFrame]:
    """A6 as edges ``src, dst``, those into a block and those out of it; a row that stands
    twice makes an edge twice.  Rows without a block make none."""
    r = rows.where(F.col(block).isNotNull() & F.col(key).isNotNull())
    return (r.select(*group_cols, F.col(key).alias("src"), F.col(block).alias("dst")),
            r.select(*group_cols, F.col(block).alias("src"), F.col(key).alias("dst")))


def block_edges(rows: DataFrame, group_cols: Sequence[str], block: str, key: str) -> DataFrame:
    """A6 as edges: any member of a block reaches all others.  The block is a node of its
    own between them, so a block of M members makes 2 M edges.  Rows without a block make none."""
    to, back = block_steps(rows.select(*group_cols, block, key).distinct(), group_cols, block, key)
    return to.unionByName(back).withColumn("rule", F.lit("block"))
