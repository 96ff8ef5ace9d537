"""Properties of the generic operators against brute force on small inputs."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import scalars as S
from corpusgraph.functions.ordering import group_ordinal, ordered_parts
from corpusgraph.operators import symbols
from corpusgraph.plans import closure as C
from corpusgraph.session import materialize, table_scope


def bfs(seeds, edges):
    out, frontier, hop = {s: 0 for s in seeds}, list(seeds), 0
    while frontier:
        hop += 1
        nxt = []
        for u in frontier:
            for a, b in edges:
                if a == u and b not in out:
                    out[b] = hop
                    nxt.append(b)
        frontier = nxt
    return out


def test_reachable_matches_bfs_and_is_idempotent(spark):
    rnd = random.Random(7)
    edges = [(f"c{c}", f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for c in range(3) for _ in range(60)]
    seeds = [("c0", "n1"), ("c1", "n2"), ("c2", "n3"), ("c2", "n4")]
    e = spark.createDataFrame(edges, "corpus_id string, src string, dst string")
    s = spark.createDataFrame(seeds, "corpus_id string, key string")
    got = {(r.corpus_id, r.key): r.hop for r in C.reachable(s, e).collect()}
    want = {}
    for c in ("c0", "c1", "c2"):
        ce = [(a, b) for cc, a, b in edges if cc == c]
        for k, h in bfs([k for cc, k in seeds if cc == c], ce).items():
            want[(c, k)] = h
    assert got == want
    # idempotent: closing the closure again adds nothing
    again = C.reachable(C.reachable(s, e).select("corpus_id", "key"), e)
    assert {(r.corpus_id, r.key) for r in again.collect()} == set(want)
    # monotone in the seeds
    fewer = C.reachable(s.where("key <> 'n4'"), e)
    assert {(r.corpus_id, r.key) for r in fewer.collect()} <= set(want)


def test_reachable_raises_instead_of_truncating(spark):
    e = spark.createDataFrame([("c", f"n{i}", f"n{i+1}") for i in range(6)], "corpus_id string, src string, dst string")
    s = spark.createDataFrame([("c", "n0")], "corpus_id string, key string")
    assert C.reachable(s, e, max_rounds=6).count() == 7  # converged in the last round allowed
    with pytest.raises(C.RoundLimitExceeded):
        C.reachable(s, e, max_rounds=5)


def test_group_ordinal_and_ordered_parts_match_window(spark):
    rnd = random.Random(3)
    groups = ["hot", None, *(f"g{k}" for k in range(5))]
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(groups), i, f"v{i}" if i % 9 else None)
            for i in rnd.sample(range(5000), 800)]
    df = spark.createDataFrame(rows, "g string, o long, v string")
    got = {(r.g, r.o): r.ord for r in group_ordinal(df, ["g"], ["o"], partitions=7).collect()}
    w = Window.partitionBy("g").orderBy("o")
    want = {(r.g, r.o): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want
    parts = ordered_parts(df, ["g"], ["o"], "v", sep=",", rows_per_part=10).collect()
    assert all(r.n_rows <= 10 for r in parts)
    for g in {r[0] for r in rows}:
        text = ",".join(r.text for r in sorted((p for p in parts if p.g == g), key=lambda p: p.part))
        assert text == ",".join(v for gg, o, v in sorted(rows, key=lambda x: x[1]) if gg == g and v)


def test_group_ordinal_on_many_rows_with_payload(spark):
    """Columns that only one of the two branches needs must not change the layout."""
    n = 300_000
    df = spark.range(n).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"),
                               F.repeat(F.lit("x"), F.lit(20)).alias("payload"), "id")
    ranked = group_ordinal(df, ["g"], ["o"], partitions=13)
    w = Window.partitionBy("g").orderBy("o")
    right = df.select("id", F.row_number().over(w).alias("rn"))
    assert ranked.select("id", "ord").join(right, "id").where("ord <> rn").count() == 0
    assert ranked.count() == n


def test_keep_first_greedy_matches_sequential(spark):
    rnd = random.Random(11)
    specs = []
    for grp in ("p", "q"):
        for i in range(120):
            names = sorted({f"x{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 4))})
            specs.append((grp, i, names))
    specs.append(("p", 999, ["_"]))
    specs += [(None, i, [f"c{i}", f"c{i + 1}", "_"]) for i in range(40)]  # a chain: each blocks the next
    specs += [("q", 2000 + i, ["hot"]) for i in range(300)]
    df = spark.createDataFrame(specs, "g string, o long, names array<string>")
    got = {(r.g, r.o): r.kept for r in symbols.keep_first_greedy(df, ["g"], "o", "o", "names").collect()}
    want = {}
    for grp in ("p", "q", None):
        seen = set()
        for g, o, names in sorted((s for s in specs if s[0] == grp), key=lambda s: s[1]):
            real = [n for n in names if n != "_"]
            ok = not (set(real) & seen)
            if ok:
                seen |= set(real)
            want[(g, o)] = ok
    assert got == want


def test_keep_first_greedy_writes_three_rows_a_spec_at_most(spark, monkeypatch):
    written = []

    def counting(df, tag, with_count=False):
        out, n = materialize(df, tag, with_count=True)
        written.append(n)
        return (out, n) if with_count else out

    monkeypatch.setattr(symbols, "materialize", counting)
    specs = [("g", i, [f"c{i}", f"c{i + 1}"]) for i in range(24)]
    df = spark.createDataFrame(specs, "g string, o long, names array<string>")
    got = symbols.keep_first_greedy(df, ["g"], "o", "o", "names")
    assert {r.o: r.kept for r in got.collect()} == {i: i % 2 == 0 for i in range(24)}
    assert len(written) > 12 and sum(written) <= 3 * len(specs)
    assert symbols.keep_first_greedy(df.where("false"), ["g"], "o", "o", "names").count() == 0


def test_ordinal_prefix(spark):
    df = spark.range(1, 760).select(F.col("id"), S.ordinal_prefix("id").alias("p"))
    got = {r.id: r.p for r in df.collect()}
    assert got[1] == "a" and got[26] == "z" and got[27] == "aa" and got[28] == "ab"
    assert got[52] == "az" and got[53] == "ba" and got[702] == "zz" and got[703] == "aaa"
    assert len(set(got.values())) == len(got)


def test_ordinal_prefix_covers_bigint(spark):
    def letters(n):
        out = ""
        while n:
            n, d = divmod(n - 1, 26)
            out = chr(97 + d) + out
        return out
    ns = [1, 26 ** 7, 8_353_082_582, 8_353_082_583, 2 ** 53 + 1, 2 ** 62 + 12345, 2 ** 63 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r.p for r in df.select(S.ordinal_prefix("n").alias("p")).collect()] == [letters(n) for n in ns]


def test_symbol_and_position_keys(spark):
    df = spark.createDataFrame([("*T", "Read", "a.go", 3, 1), (None, "main", "a.go", 9, 1),
                                ("Stack[T]", "Push", "b.go", 10, 1), ("", "helper", "b.go", 2, 1)],
                               "recv string, name string, path string, line int, col int")
    out = df.select(S.symbol_key("recv", "name").alias("k"),
                    S.position_key(["path", "line", "col"], "name").alias("p")).collect()
    assert [r.k for r in out] == ["T.Read", "main", "Push", "helper"]
    assert [r.p for r in out] == ["a.go:3:1", "main", "b.go:10:1", "b.go:2:1"]


def test_table_scope_deletes_what_it_wrote(spark):
    with table_scope(spark):
        df = materialize(spark.range(5), "scoped")
        folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_complete_missing_takes_specs_and_whole_blocks(spark):
    """One provider a name; a constant brings its block and what the block mentions."""
    from corpusgraph.plans.closure import complete_missing
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = complete_missing(
        f([("main",), ("here",), (None,)], "name string"), f([("A",), ("here",), ("nowhere",)], "name string"),
        f([("A", 1, "func", "s1"), ("C", 7, "const", "b7"), ("D", 7, "const", "b7"), ("E", 3, "type", "s3"),
           ("F", 4, "func", "s4"), ("G", 5, "func", "s5"), ("here", 9, "func", "s9")],
          "name string, provider long, kind string, source string"),
        f([("s1", "C"), ("s1", "A"), ("b7", "E"), ("s3", "D"), ("s3", "H"), ("s9", "G"), ("s4", "G")], "source string, name string"),
        f([("b7", "C"), ("b7", "D"), ("b7", "H"), ("b7", "main")], "source string, name string"))
    assert {tuple(r) for r in out.collect()} == {
        ("main", None, None, 0, True), ("here", None, None, 0, True), ("A", 1, "func", 1, True),
        ("C", 7, "const", 2, True), ("D", 7, "const", 2, False), ("H", 7, "const", 2, False), ("E", 3, "type", 3, True)}


def test_fill_forward_matches_window(spark):
    """Groups over several range partitions, null groups, long gaps, nothing to carry."""
    from corpusgraph.functions.ordering import fill_forward
    r = random.Random(5)
    rows = [(None if k % 7 == 0 else f"g{k % 3}", k, f"v{k}" if r.random() < 0.02 else None) for k in range(4000)]
    rows += [("none", k, None) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, o long, v string").repartition(5)
    got = {(x.g, x.o): (x.ord, x.carried, x.from_ord) for x in fill_forward(df, ["g"], ["o"], "v").collect()}
    want, held, place = {}, {}, {}
    for g, o, v in sorted(rows, key=lambda x: x[1]):
        place[g] = place.get(g, 0) + 1
        if v is not None:
            held[g] = (v, place[g])
        want[g, o] = (place[g], *held.get(g, (None, None)))
    assert got == want
    assert fill_forward(df.where("false"), ["g"], ["o"], "v").count() == 0


def test_const_specs_carry_their_expression(spark):
    """Implied specs stand for the last expression of their own block, at their own ordinal."""
    from corpusgraph.operators import lex
    src = ("package p\n\nconst (\n\tA T = 1 << iota // first\n\tB\n\tC, D = \"x=y\", f(1,\n\t\t2)\n\tE, F\n)\n\n"
           "const Lone = 3\n\nconst (\n\tG = iota\n\tH\n)\n\nvar (\n\tv = 1\n\tw int\n)\n")
    files = spark.createDataFrame([("c", "", "p.go", src)], "corpus_id string, pkg_path string, path string, src string")
    specs, _ = lex.split_specs(lex.with_structure(lex.tokenize(files)))
    rows = lex.const_expressions(specs).orderBy("decl_no", "ordinal").collect()
    got = [(x.text.split()[0].rstrip(","), x.ordinal, x.explicit, " ".join(x.value.split()), x.from_ordinal) for x in rows]
    two = '= "x=y", f(1, 2)'
    assert got == [("A", 0, True, "T = 1 << iota", 0), ("B", 1, False, "T = 1 << iota", 0), ("C", 2, True, two, 2),
                   ("E", 3, False, two, 2), ("Lone", 0, True, "= 3", 0), ("G", 0, True, "= iota", 0), ("H", 1, False, "= iota", 0)]


def test_reachable_splits_a_hub_and_moves_no_edges(spark):
    """One node holds a third of the edges: the same closure, in parts, and no exchange of edges."""
    from corpusgraph.plans import closure as C
    r = random.Random(9)
    edges = [("g", "hub", f"n{k}") for k in range(300)] + [("g", f"n{r.randrange(300)}", f"m{k}") for k in range(600)]
    e = spark.createDataFrame(edges + edges[:50] + [("g", None, "x"), ("g", "hub", None)], "corpus_id string, src string, dst string")
    s = spark.createDataFrame([("g", "hub")], "corpus_id string, key string")
    whole = sorted(map(tuple, C.reachable(s, e).collect()))
    assert whole == sorted(map(tuple, C.reachable(s, e, hub_edges=20).collect())) and len(whole) == 901
    laid, hubs, name = C._laid_out(e, ["corpus_id"], "key", "src", "dst", False, 20)
    assert [(h._s, h._k) for h in hubs.collect()] == [("hub", 15)]
    most = laid.groupBy("_s", "_p").count().agg(F.max("count")).first()[0]
    assert laid.count() == 900 and most <= 60
    # Without a broadcast only the frontier is shuffled: no Exchange above the scan of the edges.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = C._to_parts(s.withColumnRenamed("key", "_s"), hubs, ["corpus_id"]).join(laid, ["corpus_id", "_s", "_p"])
        plan = step._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")
    # Depth first, so what stands between the join and the scan of the edges, less deep than the scan.
    indent = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    join = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
    scan = next(i for i, line in enumerate(plan) if name in line)
    right = max(i for i in range(join, scan + 1) if indent[i] == indent[join] + 3)
    path = "\n".join(plan[right:scan + 1])
    assert "Bucketed: true" in path and "Exchange" not in path, "\n".join(plan)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("corpusgraph_edges")]


def test_typed_closure_follows_all_three_rules(spark):
    """A mention, a type's methods, a block's members; a block named like a symbol is another node."""
    from corpusgraph.plans import closure as C
    e = lambda rows, cols: spark.createDataFrame(rows, cols)
    seeds = e([("p", "main"), ("q", "main")], "corpus_id string, key string")
    mentions = e([("p", "main", "T"), ("p", "T.Run", "C1"), ("p", "C2", "far"), ("q", "main", "U")],
                 "corpus_id string, src string, dst string")
    methods = e([("p", "T", "T.Run"), ("p", "U", "U.Run"), ("q", "T", "T.Run")], "corpus_id string, src string, dst string")
    blocks = e([("p", "unused", "C1"), ("p", "unused", "C2"), ("p", "b2", "C3"), ("q", "unused", "C1"), ("p", None, "T"), ("p", "unused", None)],
               "corpus_id string, block string, key string")
    got = sorted(map(tuple, C.typed_closure(seeds, mentions, methods, blocks).collect()))
    assert got == [("p", "C1", 3), ("p", "C2", 5), ("p", "T", 1), ("p", "T.Run", 2), ("p", "far", 6), ("p", "main", 0),
                   ("q", "U", 1), ("q", "main", 0)]


def test_tokens_do_not_carry_their_file(spark):
    """A row per token holds the token, never the source it came from (F1)."""
    from corpusgraph.operators import lex
    files = spark.createDataFrame([("c", "", "a.go", "// x\n\npackage main\nvar a = 1\n")],
                                  "corpus_id string, pkg_path string, path string, src string")
    tokens = lex.tokenize(files)
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    generate = [line for line in plan.splitlines() if "Generate" in line]
    assert generate and not any("src#" in line for line in generate)
    got = [(r.pos, r.tok, r.gap, r.lead_lines, r._lines) for r in tokens.orderBy("pos").collect()]
    assert got == [(0, "package", " ", 2, 0), (1, "main", "\n", 2, 1), (2, "var", " ", 2, 0), (3, "a", " ", 2, 0),
                   (4, "=", " ", 2, 0), (5, "1", "\n", 2, 1)]


ODD_LINES = ["", " ", "one", "two words", "İx y", "ΟΔΟΣ ΟΔΟΣ", "áb c", "1 2 a", "\ta\rb c", "The the THE thé", "a-b", "x\x00y",
             "a 1", "1a", "ß ſ", "𝒜𝒷 c", "same same Same"]


def test_heads_are_the_units_without_their_words(spark):
    """Names read from the start of a line equal those of the whole split, on odd lines too."""
    from corpusgraph.plans import adapters as A
    rows = [(k, None if k == 3 else f"s{k % 2}", "en", "\n".join(ODD_LINES[k:] + ODD_LINES[:k])) for k in range(len(ODD_LINES))]
    docs = spark.createDataFrame(rows + [(99, "s1", "en", None)], "doc_id long, source string, lang string, text string")
    cols = ["corpus_id", "doc_id", "ln", "line", "name"]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(map(tuple, A.doc_units(docs).select(*cols).collect()), key=key)
    assert want and sorted(map(tuple, A.doc_heads(docs).select(*cols).collect()), key=key) == want


def test_known_and_resolved_refs_equal_the_plain_joins(spark):
    """The dealt lookups give what distinct and plain joins give, with repeats, nulls and a hot word."""
    r = random.Random(3)
    word = lambda n: r.choice([None, *[f"w{k}" for k in range(n)]])
    refs = [(r.choice(["a", "b", "c", None]), word(40), r.choice(["w0", "w0", word(60)])) for _ in range(2000)]
    e = spark.createDataFrame(refs, "corpus_id string, src string, dst string")
    names = spark.createDataFrame([("a", f"w{k}") for k in range(0, 60, 2)] + [("b", f"w{k}") for k in range(0, 60, 3)]
                                  + [(None, "w0"), ("a", None)], "corpus_id string, dst string").distinct()
    key = lambda x: tuple(str(v) for v in x)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=key)
    on = ["corpus_id", "dst"]
    assert rows(symbols.distinct_known_refs(e, names, on, "src")) == rows(symbols.known_refs(e.distinct(), names, on))
    by_key = names.where("corpus_id IS NOT NULL AND dst IS NOT NULL").withColumn("t", F.col("corpus_id"))
    by_name = by_key.groupBy("dst").agg(F.min("t").alias("t"))
    assert rows(symbols.resolve_distinct_refs(e, by_key, by_name, on, ["dst"], "src", "t", "t")) == rows(
        symbols.resolve_key_or_name(e.distinct(), by_key, by_name, on, ["dst"], "t", "t"))


@pytest.mark.parametrize("name", ["j1_known_refs", "j2_key_else_name"])
def test_mentions_are_looked_up_without_a_sort(spark, name):
    """No lookup of mentions sorts them."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("hub_edges", [5, 10_000])
def test_a_round_moves_and_sorts_no_edges(spark, hub_edges):
    """With hubs and without, the frontier is all that is shuffled, and nothing is sorted."""
    edges = spark.createDataFrame([("g", f"n{k % 9}", f"n{k}") for k in range(200)], "corpus_id string, src string, dst string")
    seeds = spark.createDataFrame([("g", "n1")], "corpus_id string, key string")
    laid, hubs, name = C._laid_out(edges, ["corpus_id"], "key", "src", "dst", False, hub_edges)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = C._edges_of(seeds, laid, hubs, ["corpus_id"], "key")
        plan = step._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")
    assert (hubs is None) == (hub_edges == 10_000)
    join = next(i for i, line in enumerate(plan) if "ShuffledHashJoin" in line)
    scan = next(i for i, line in enumerate(plan) if name in line)
    indent = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    right = max(i for i in range(join, scan + 1) if indent[i] == indent[join] + 3)
    path = "\n".join(plan[right:scan + 1])
    assert "Bucketed: true" in path and "Exchange" not in path and "Sort" not in path, "\n".join(plan)


def test_words_of_a_document_are_counted_where_it_is(spark):
    """texts, not their words, are shuffled before the count; one exchange of words, by the lookup's key."""
    import __spark_entry__ as E
    plan = E.queries()["r2_rename_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [m for m in moves if "hashpartitioning(doc_id" in m and "word" in m], plan


def test_typed_closure_lays_out_a_rule_at_a_time(spark, monkeypatch):
    """Also with a hub (its edges are then written again), and nothing but the nodes stays."""
    from corpusgraph import session

    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    mentions = one([(f"o{i}.1", f"o{i}") for i in range(40)] * 2, "src string, dst string")
    methods = one([(f"o{i}", f"o{i}.1") for i in range(40)], "src string, dst string")
    blocks = one([("b", f"o{i}.1") for i in range(0, 40, 2)] + [(None, "o1.1")], "block string, key string")
    seeds = one([("o0",), ("o1",)], "key string")
    want = {("o0", 0), ("o1", 0), ("o0.1", 1), ("o1.1", 1)} | {(f"o{i}.1", 3) for i in range(2, 40, 2)} | {
        (f"o{i}", 4) for i in range(2, 40, 2)}
    for hub in (C.HUB_EDGES, 5):
        real = C.reachable
        monkeypatch.setattr(C, "reachable", lambda *a, **k: real(*a, **{**k, "hub_edges": hub}))
        before, written = len(session._tables), []
        bucketed = session.materialize_bucketed
        monkeypatch.setattr(C, "materialize_bucketed", lambda parts, cols, name: (
            written.append(len(parts)), bucketed(parts, cols, name))[1])
        out = C.typed_closure(seeds, mentions, methods, blocks, [])
        assert {(r.key, r.hop) for r in out.collect()} == want
        monkeypatch.undo()
        assert written == ([4] if hub > 5 else [4, 1])
        assert not [t for t in session._tables[before:] if "edges" in t]
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("corpusgraph_edges")]
