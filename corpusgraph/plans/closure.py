"""Fixed points over the mention graph (C1-C4) and pruning.

``reachable`` is the only driver loop in the library: one iteration per
*round* of a semi-naive breadth-first search, for all corpora at once.  The
edges are laid out by their source once (buckets, sources of many edges in
parts), so a round moves only its frontier.  Each
round joins only the new frontier with the edge table, removes what was seen
(``left_anti``) and checkpoints the result to the reliable checkpoint
directory, so lineage stays one round deep and a lost executor only costs the
current round.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, ensure_checkpoint_dir, materialize, materialize_bucketed
from ..operators import symbols


#: Rounds after which the tables of seen nodes become one again.
COMPACT_EVERY = 8
#: Edges of one source that one task reads; a source of more is split.
HUB_EDGES = 100_000


class RoundLimitExceeded(RuntimeError):
    """Raised when ``max_rounds`` is reached before the closure converged."""


def reachable(seeds: DataFrame, edges: DataFrame | Sequence[DataFrame], group_cols: Sequence[str] = ("corpus_id",),
              node: str = "key", src: str = "src", dst: str = "dst",
              max_rounds: int | None = None, carry: Sequence[str] = (),
              written: bool = False, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Nodes reachable from ``seeds`` over ``edges``, with the smallest hop.

    ``carry``: further columns of the seeds that travel along (an owner, say): the
    closure of each is its own, over the same edges.

    ``edges``: one frame, or several that are laid out one after the other and so need less
    disk at once; an edge that several of them hold, or one twice, stands there as often.
    ``written``: the edges are a table already, each edge once (saves a write).
    ``hub_edges``: a source with more edges is split by a hash of the other end, so that
    no task reads a hub; its frontier row goes to every part.

    seeds: ``group_cols + [node]``; edges: ``group_cols + [src, dst]``.
    Returns ``group_cols + [node, hop]`` (hop 0 for seeds), one row per
    reached node.  Rounds = the largest eccentricity over all corpora, not
    their sum.  Each round is one job that writes its new nodes; the nodes seen
    so far are compacted to one table every ``COMPACT_EVERY`` rounds.

    ``max_rounds`` raises when a further round would find new nodes; a closure
    whose last new node is in round ``max_rounds`` has converged.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    g, own = list(group_cols), [*group_cols, *carry]
    e, hubs, _ = _laid_out(edges, g, node, src, dst, written, hub_edges)
    frontier = materialize(seeds.select(*own, node).where(F.col(node).isNotNull()).distinct(), "seeds")
    seen = frontier.withColumn("hop", F.lit(0).cast("bigint"))
    rnd, rounds = 0, [frontier]
    while True:
        rnd += 1
        step = (_edges_of(frontier, e, hubs, g, node)
                .select(*own, node)
                .distinct()
                .join(seen.hint("shuffle_hash"), [*own, node], "left_anti"))
        frontier, n_new = materialize(step, f"round{rnd}", with_count=True)
        if n_new == 0 or (max_rounds is not None and rnd > max_rounds):
            _drop(e)
        if n_new == 0:
            return seen
        if max_rounds is not None and rnd > max_rounds:
            raise RoundLimitExceeded(f"closure did not converge within {max_rounds} rounds")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(rnd).cast("bigint")))
        if rnd % COMPACT_EVERY == 0:
            seen, before = materialize(seen, "seen"), rounds
            discard(*before)
            rounds = [seen]
        rounds.append(frontier)


def _laid_out(edges: DataFrame | Sequence[DataFrame], g: Sequence[str], node: str, src: str, dst: str, written: bool,
              hub_edges: int) -> tuple[DataFrame, DataFrame | None, str]:
    """The edges in buckets of (group, source, part), the sources of more than one part with
    their number ``_k``, and the table's name.  There are at most edges / hub_edges such sources; without any, both they
    and ``_p`` are left out: a part that is always 0 is dropped from the keys of a join, which then
    no longer fit the buckets.  Several frames are laid out by source first, where hubs are counted
    without a shuffle; only with a hub are they written again."""
    def bare(edges: DataFrame) -> DataFrame:
        return (edges.select(*g, F.col(src).alias("_s"), F.col(dst).alias(node))
                .where(F.col("_s").isNotNull() & F.col(node).isNotNull()))

    name = f"corpusgraph_edges_{uuid.uuid4().hex}"
    several = not isinstance(edges, DataFrame)
    if several:
        e = materialize_bucketed([bare(x) for x in edges], [*g, "_s"], name)
    else:
        e = bare(edges) if written else materialize(bare(edges).distinct(), "edges")
    hubs, n = materialize(e.groupBy(*g, "_s").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub_edges)
                          .select(*g, "_s", F.ceil(F.col("_n") / hub_edges).cast("int").alias("_k")), "hubs", with_count=True)
    if not n:
        out = e if several else materialize_bucketed([e], [*g, "_s"], name)
    else:
        parted = e.join(hubs, [*g, "_s"], "left").select(
            *g, "_s", node, F.pmod(F.xxhash64(node), F.coalesce("_k", F.lit(1))).cast("int").alias("_p"))
        name = f"{name}_parts"
        out = materialize_bucketed([parted], [*g, "_s", "_p"], name)
        if several:
            _drop(e)
    if not several and not written:
        discard(e)
    return out, hubs if n else None, name


def _drop(e: DataFrame) -> None:
    """The laid-out edges go, name and files."""
    e.sparkSession.sql(f"DROP TABLE IF EXISTS {e._written_to.rsplit('/', 1)[1]}")
    discard(e)


def _edges_of(frontier: DataFrame, e: DataFrame, hubs: DataFrame | None, g: Sequence[str], node: str) -> DataFrame:
    """The frontier with its edges.  Only the frontier moves, and it is what is hashed, so the
    edges are neither shuffled nor sorted."""
    return _to_parts(frontier.withColumnRenamed(node, "_s"), hubs, g).hint("shuffle_hash").join(
        e, [*g, "_s"] if hubs is None else [*g, "_s", "_p"])


def _to_parts(frontier: DataFrame, hubs: DataFrame | None, g: Sequence[str]) -> DataFrame:
    """Every frontier row to every part ``_p`` of its source."""
    if hubs is None:
        return frontier
    parts = F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)
    return frontier.join(hubs, [*g, "_s"], "left").withColumn("_p", F.explode(parts)).drop("_k")


def typed_closure(seeds: DataFrame, mentions: DataFrame, methods: DataFrame, blocks: DataFrame,
                  group_cols: Sequence[str] = ("corpus_id",)) -> DataFrame:
    """Closure over three rules at once.

    seeds: ``group_cols, key``; mentions and methods: ``group_cols, src, dst`` (what a symbol
    mentions, a type's methods, J9); blocks: ``group_cols, block, key``, of which any member
    reaches all others (A6).  Returns ``group_cols, key, hop``; a step into a block and a step
    out of it count one each.  A block may have the name of a symbol.
    """
    g = list(group_cols)

    def own(name: str):
        return F.concat(F.lit("n"), F.col(name).cast("string"))

    # A rule at a time, so that the shuffle files of one lie on the disks, not those of all.
    rules = [mentions.select(*g, own("src").alias("src"), own("dst").alias("dst")),
             methods.select(*g, own("src").alias("src"), own("dst").alias("dst")),
             *symbols.block_steps(blocks.select(*g, F.concat(F.lit("b"), F.col("block").cast("string")).alias("block"),
                                                own("key").alias("key")), g, "block", "key")]
    out = reachable(seeds.select(*g, own("key").alias("key")), rules, g)
    return out.where(F.col("key").startswith("n")).withColumn("key", F.expr("substring(key, 2)"))


def prune(units: DataFrame, reach: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep the units whose key was reached (``left_semi``; roots are in
    ``reach`` with hop 0, so they always stay)."""
    return units.join(reach.select(*on).distinct(), list(on), "left_semi")


def missing_symbols(mentions: DataFrame, declared: DataFrame, offered: DataFrame,
                    on: Sequence[str], offered_on: Sequence[str] | None = None) -> DataFrame:
    """Mentioned, not declared locally, but offered by some provider."""
    m = mentions.select(*on).distinct()
    return (m.join(declared.select(*on).distinct(), list(on), "left_anti")
            .join(offered.select(*(offered_on or on)).distinct(), list(offered_on or on), "left_semi"))


def flatten_packages(imports: DataFrame, roots: DataFrame, group_cols: Sequence[str] = ("corpus_id",)) -> DataFrame:
    """C3 with ``flatten``: which packages become part of which (Q21).

    imports: ``group_cols, src, dst``; roots: ``group_cols, key``.  Every direct import of
    the root is an owner; what it imports, directly or not, that neither the root nor
    another direct import is, becomes part of it.  Returns ``group_cols, owner, key, hop``
    (hop 0: the owner itself); a package private to two owners is part of both (Q22).
    """
    g = list(group_cols)
    direct = materialize(imports.join(roots.select(*g, F.col("key").alias("src")), [*g, "src"])
                         .where(F.col("dst") != F.col("src")).select(*g, F.col("dst").alias("key")).distinct(), "direct")
    named = direct.unionByName(roots.select(*g, "key")).distinct().withColumnRenamed("key", "dst")  # J4
    inner = imports.join(named, [*g, "dst"], "left_anti")
    return reachable(direct.withColumn("owner", F.col("key")), inner, g, carry=["owner"])


def flattened_names(members: DataFrame, declares: DataFrame, group_cols: Sequence[str] = ("corpus_id",),
                    name: str = "name", order: Sequence[str] = ("hop", "key")) -> DataFrame:
    """Who declares each name of an owner (Q21): ``group_cols, owner, name, key, winner, lost``
    for every member ``key`` that declares it.  The parent wins over the child: the member
    with the smallest ``order`` (fewest imports away, then by path); ``lost`` marks the others."""
    g = list(group_cols)
    every = materialize(members.join(declares.select(*g, "key", name).distinct(), [*g, "key"]), "flat_names")
    best = every.groupBy(*g, "owner", name).agg(F.min_by("key", F.struct(*order)).alias("winner"))
    return every.join(best, [*g, "owner", name]).select(
        *g, "owner", name, "key", "winner", (F.col("key") != F.col("winner")).alias("lost"))


def complete_missing(declared: DataFrame, mentions: DataFrame, chosen: DataFrame, source_mentions: DataFrame,
                     source_names: DataFrame) -> DataFrame:
    """C4: add what is mentioned, not declared and offered, until nothing is missing.

    declared: ``name`` of what is there; mentions: ``name`` of what that mentions;
    chosen: ``name, provider, kind, source``, the one provider of each offered name (J7)
    and what it gives: a spec or, for a constant, its whole block; source_mentions:
    ``source, name`` that a source mentions; source_names: ``source, name`` that a block
    declares beside the name it was asked for.

    A round asks for every missing name; the sources asked for declare their names, and
    only what they mention is looked at next.  Returns ``name, provider, kind, hop, asked``
    (hop 0: declared from the start, without provider; not ``asked``: came with a block).
    A block's name that two blocks of one round declare belongs to the smaller provider.
    Names and sources are distinct before each join, so a name that a third of all specs
    mention is one row there.
    """
    seen = materialize(declared.select("name").where(F.col("name").isNotNull()).distinct().select(
        "name", F.lit(None).cast(chosen.schema["provider"].dataType).alias("provider"),
        F.lit(None).cast("string").alias("kind"), F.lit(0).cast("bigint").alias("hop"), F.lit(True).alias("asked")), "declared")
    frontier, rnd = mentions.select("name").distinct(), 0
    while True:
        rnd += 1
        asked = materialize(chosen.join(frontier, "name", "left_semi").join(seen, "name", "left_anti"), f"asked{rnd}")
        sources = asked.groupBy("source").agg(F.min("provider").alias("provider"), F.min("kind").alias("kind"))
        given = sources.join(source_names, "source").select("name", "provider", "kind", F.lit(False).alias("asked"))
        every = asked.select("name", "provider", "kind", F.lit(True).alias("asked")).unionByName(given)
        best = F.min_by(F.struct("provider", "kind", "asked"), F.struct(~F.col("asked"), "provider"))
        added = (every.groupBy("name").agg(best.alias("_b")).select("name", "_b.*").join(seen, "name", "left_anti")
                 .select("name", "provider", "kind", F.lit(rnd).cast("bigint").alias("hop"), "asked"))
        added, n_new = materialize(added, f"added{rnd}", with_count=True)
        if n_new == 0:
            return seen
        seen = seen.unionByName(added)
        if rnd % COMPACT_EVERY == 0:
            seen = materialize(seen, "seen")
        frontier = materialize(source_mentions.join(asked.select("source").distinct(), "source").select("name").distinct(),
                               f"mentioned{rnd}")


def min_seed(edges: DataFrame, group_cols: Sequence[str], src: str = "src",
             node: str = "key") -> DataFrame:
    """One seed per group: the smallest source node of its edges."""
    return edges.groupBy(*group_cols).agg(F.min(src).alias(node))
