"""Conversation prefix trie by truncation peeling (operator 11).

1. *Layout*: turns are range-partitioned by (conversation, turn, role, text), so that
   a conversation may span many tasks, and leave their texts behind there: two 64-bit
   hashes and a word count go on.  Positions and running sums come from sums inside a
   partition and the sums of the partitions before.
2. *Rebuilding*: a conversation's first h turns are those of its block's first
   conversation (at most 3 rows each), its own later turns move to follow them.
   A node's key is the sum of hashes of (position, turn) over the prefix, 128 bits, so
   the key of a prefix cut by its last turn is the same sum less one term.
3. *Peeling*: starting from the deepest, conversations that end are merged with the
   nodes that survive from below, the last turn is stripped and what is left regrouped,
   adding up leaves and saved tokens.  Turns at which no conversation ends or parts
   from the others change no group; a run of them is stripped in one step, so the
   rounds are the depths at which conversations end above others or part, not all
   depths, and only such *stops* move.  Each round is written to the shared folder.
4. *Ends*: the digest of a node in which several conversations end streams their
   sorted ids through SHA-256, a batch at a time; no list of them is held.

Defined results: a null turn comes first; rows of one turn are ordered by role, then
text (null as empty, by code points), repeated rows count each; rows of a null conv_id
belong to no conversation and are left out; ids below 0 take the remainder of their
sign (-5 belongs to block 0); a conversation whose rebuilt form has no turn is a member
of the root alone; an empty table has no nodes; very long texts and conversations are
read whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .registry import register

#: Conversations of a block share the head of the block's first one; heads have 0 to 3 turns.
BLOCK, HEADS = 20, 4
WIDE = "decimal(38,0)"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def key(sum1: Column, sum2: Column) -> list[Column]:
    """A prefix's 128-bit key from the two sums of its turns' hashes."""
    return [F.xxhash64(F.lit(1), sum1, sum2), F.xxhash64(F.lit(2), sum1, sum2)]


def _laid_out(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, at, pid, t1, t2, w`` of every turn in order, and per conversation and
    partition ``conv_id, pid, first, off, len`` (where its turns begin, how many before, in all)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", empty("role").alias("role"),
        empty("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]  # nulls first
    laid = materialize(
        rows.withColumn("t1", F.xxhash64("role", "text")).withColumn("t2", F.xxhash64(F.lit(3), "text", "role"))
        .withColumn("w", words(F.col("text"))).repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("pid"),
                "t1", "t2", "w"), "turns")
    whole = Window.partitionBy("conv_id")
    parts = laid.groupBy("conv_id", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return laid, parts.select("conv_id", "pid", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"),
                              F.sum("n").over(whole).alias("len"))


def chains(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, depth, a, b, pa, pb, w, upto, last`` (node and parent key,
    words of the turn and up to it) and conversations ``conv_id, depth``."""
    laid, parts = _laid_out(turns)
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    convs = parts.groupBy("conv_id").agg(F.max("len").alias("len")).select(
        "*", base.alias("base"), head_length(F.col("conv_id")).alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("len").alias("base_len"))
    convs = materialize(
        convs.join(bases, "base", "left").select(
            "conv_id", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).cast("bigint").alias("k"), "len")
        .withColumn("depth", F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "convs")

    at = (F.col("off") + F.col("at") - F.col("first") + 1).cast("bigint")
    placed = laid.join(parts.drop("len").join(convs.select("conv_id", "h", "k"), "conv_id"), ["conv_id", "pid"])
    placed = materialize(placed.select("conv_id", "pid", at.alias("pos"), "h", "k", "t1", "t2", "w"), "placed")
    head = placed.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "w")
    heads = (convs.where("k > 0").select("conv_id", "base", "k").join(head, "base").where("pos <= k")
             .select("conv_id", F.lit(-1).alias("pid"), F.col("pos").alias("depth"), "t1", "t2", "w"))
    own = placed.where("pos > h").select("conv_id", "pid", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"),
                                         "t1", "t2", "w")
    rebuilt = heads.unionByName(own).select(
        "conv_id", "pid", "depth", F.xxhash64("depth", "t1", "t2").cast(WIDE).alias("v1"),
        F.xxhash64("t2", "depth", "t1").cast(WIDE).alias("v2"), "w")

    # Running sums: inside a partition (bounded by the range layout), then what came before.
    sums = {"v1": "s1", "v2": "s2", "w": "upto"}
    cast = lambda c, kind: c.cast(WIDE if kind != "w" else "bigint")
    inside = Window.partitionBy("conv_id", "pid").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rebuilt.groupBy("conv_id", "pid").agg(*[cast(F.sum(v), v).alias(v) for v in sums]).select(
        "conv_id", "pid", *[cast(F.coalesce(F.sum(v).over(earlier), F.lit(0)), v).alias(f"o_{v}") for v in sums])
    run = (rebuilt.select("*", *[cast(F.sum(v).over(inside), v).alias(s) for v, s in sums.items()])
           .join(offsets, ["conv_id", "pid"])
           .select("conv_id", "depth", "v1", "v2", "w",
                   *[cast(F.col(s) + F.col(f"o_{v}"), v).alias(s) for v, s in sums.items()]))
    a, b = key(F.col("s1"), F.col("s2"))
    pa_, pb = key((F.col("s1") - F.col("v1")).cast(WIDE), (F.col("s2") - F.col("v2")).cast(WIDE))
    out = run.select("conv_id", "depth", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "w", "upto")
    last = convs.select("conv_id", F.col("depth").alias("end"))
    out = out.join(last, "conv_id").select(*out.columns, (F.col("depth") == F.col("end")).alias("last"))
    return materialize(out, "chains"), convs.select("conv_id", "depth")


def root_key() -> list[Column]:
    zero = F.lit(0).cast(WIDE)
    return key(zero, zero)


def found_nodes(chain: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``a, b, depth, conv_id, pa, pb, w, upto, n_convs, n_children, n_ends,
    one_end, parent_conv_id`` and the ends ``a, b, conv_id``."""
    a, b = root_key()
    null = F.lit(None).cast("bigint")
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), a.alias("a"), b.alias("b"),
                         null.alias("pa"), null.alias("pb"), F.lit(0).cast("bigint").alias("w"),
                         F.lit(0).cast("bigint").alias("upto"), (F.col("depth") == 0).alias("last"))
    rows = chain.unionByName(roots)
    # Members of a node agree in all but conv_id.
    nodes = rows.groupBy("a", "b").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("pa").alias("pa"),
        F.min("pb").alias("pb"), F.min("w").alias("w"), F.min("upto").alias("upto"),
        F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("one_end"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parent = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    nodes = (nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"])
             .join(parent, ["pa", "pb"], "left"))
    return materialize(nodes, "nodes"), rows.where("last").select("a", "b", "conv_id")


def segments(nodes: DataFrame) -> DataFrame:
    """Stops, each with the run of nodes above it that have its members: ``conv_id``,
    depths ``(above, depth]``, ``above_upto`` words before, the next stop up ``pa, pb``."""
    keep = ["conv_id", "depth", "a", "b", "upto", "n_convs", "n_children", "w", "top"]
    stops = nodes.where("n_children != 1 OR n_ends > 0 OR depth = 0").select(*keep[:-1], F.lit(False).alias("top"))
    # The parent of a conversation's first own node is a stop: others branch off or end there.
    tops = nodes.where("depth > 0 AND conv_id != parent_conv_id").select(
        "conv_id", (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"),
        (F.col("upto") - F.col("w")).alias("upto"), "n_convs", "n_children", "w", F.lit(True).alias("top"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    up = lambda c: F.lag(c).over(along)
    found = stops.unionByName(tops).select(
        *keep, up("a").alias("pa"), up("b").alias("pb"),
        F.coalesce(up("depth"), F.lit(-1)).alias("above"), F.coalesce(up("upto"), F.lit(0)).alias("above_upto"))
    return materialize(found.where("NOT top").drop("top"), "stops")


def peel(stops: DataFrame) -> DataFrame:
    """``a, b, leaves, saved`` of every stop: childless nodes and saved tokens of the
    subtree that hangs on the run above the stop, run included."""
    own = (F.col("n_convs") - 1) * (F.col("upto") - F.col("above_upto"))
    state = ["a", "b", "pa", "pb", "above", "leaves", "saved"]
    done = materialize(stops.where("n_children = 0").select(
        "a", "b", "pa", "pb", "above", F.lit(1).cast("bigint").alias("leaves"), own.alias("saved")), "peeled")
    inner = stops.where("n_children > 0")
    for r in inner.groupBy("depth").count().orderBy(F.desc("depth")).collect():  # numbers of depths only
        below = done.where(F.col("above") == r["depth"]).groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        at = inner.where(F.col("depth") == r["depth"]).join(below, ["a", "b"])
        done = done.unionByName(materialize(at.withColumn("saved", F.col("below") + own).select(*state), "peeled"))
    return done.select("a", "b", "leaves", "saved")


def end_digests(ends: DataFrame) -> DataFrame:
    """``a, b, digest``: SHA-256 of the ends' ids in order, streamed per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for a, b, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256(str(conv_id).encode())
                else:
                    state.update(f",{conv_id}".encode())
            yield _digests(out)
        if at is not None:
            yield _digests([(*at, state.hexdigest())])

    return (ends.select("a", "b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
            .mapInArrow(run, "a bigint, b bigint, digest string"))


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, digest = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())],
                                      names=["a", "b", "digest"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt ``turns`` (``conv_id, turn, role, text``)."""
    nodes, ends = found_nodes(*chains(turns))
    stops = segments(nodes)
    peeled = stops.join(peel(stops), ["a", "b"]).select(
        F.col("conv_id").alias("owner"), "above", F.col("depth").alias("stop"), "above_upto", "leaves", "saved")
    # The words strictly above a node in its run are not in its subtree.
    above = F.col("upto") - F.col("w") - F.col("above_upto")
    full = nodes.join(peeled, (nodes["conv_id"] == peeled["owner"]) & (nodes["depth"] > peeled["above"])
                      & (nodes["depth"] <= peeled["stop"]))
    several = ends.join(nodes.where("n_ends > 1").select("a", "b"), ["a", "b"], "left_semi")
    digest = (F.when(F.col("n_ends") == 0, F.lit(EMPTY_SHA))
              .when(F.col("n_ends") == 1, F.sha2(F.col("one_end").cast("string").cast("binary"), 256))
              .otherwise(F.col("digest")))
    return full.join(end_digests(several), ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * above).alias("saved_tokens"), digest.alias("ends_sha256"))


@register("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt ``conversations``."""
    return prefix_trie(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))
