"""Queries over the DOC view of ``documents`` (corpus = source, unit = line,
name = first word, mentions = later long words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import group_ordinal
from ..session import materialize
from ..operators import assemble, links, rename, symbols
from ..sources import files as sources
from . import adapters as A
from . import closure as C
from . import sql as Q
from .registry import register

# The corpus whose names seed C4, and the qualifier word used as alias.
ROOT_CORPUS = "src0"
QUALIFIER = "the"
# Language ranks of the provider index (higher overrides lower), mirroring the
# reference's kind order var < type < func < const.
LANG_RANK = {"de": 0, "en": 1, "es": 2, "fr": 3}


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.doc_units(A.table(spark, sf_dir, "documents"))


def _narrow_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and mentions of all units, written once to the checkpoint storage:
    the text is split and scanned a single time and not written again."""
    return materialize(_units(spark, sf_dir).select("corpus_id", "doc_id", "ln", "name", "mentions"), "doc_names")


def _next_corpus(names: DataFrame) -> DataFrame:
    """``corpus_id, next_id``: each corpus and the one after it by name (the last
    has none), so that pairs of corpora stay linear in their number."""
    ranked = group_ordinal(names.select("corpus_id").distinct(), [], ["corpus_id"])
    return ranked.select("corpus_id", "ord").join(
        ranked.select(F.col("corpus_id").alias("next_id"), (F.col("ord") - 1).alias("ord")), "ord").drop("ord")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.doc_heads(A.table(spark, sf_dir, "documents"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over DOC: mentions that name a unit of the same corpus."""
    names = A.doc_names(_heads(spark, sf_dir)).withColumnRenamed("name", "dst")
    return symbols.distinct_known_refs(A.doc_pairs(_units(spark, sf_dir)), names, ["corpus_id", "dst"], "src").select(
        "corpus_id", "src", "dst")


def _reach_from_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_edges(spark, sf_dir), "doc_edges")
    seeds = C.min_seed(edges, ["corpus_id"], node="name")
    return C.reachable(seeds, edges, ["corpus_id"], node="name", written=True)


_PRE = "WITH RECURSIVE " + Q.doc_units() + ",\n"
_REACH_SQL = _PRE + """seeds AS (SELECT corpus_id, min(src) AS key FROM doc_edges GROUP BY corpus_id),
""" + Q.bfs("reach", "seeds", "doc_edges") + "\n"


# ------------------------------------------------------------------ C1 / U2 / C5

@register("c1_reachable_words", _REACH_SQL + "SELECT corpus_id, key AS name, hop FROM reach")
def c1_reachable_words(spark, sf_dir):
    """Names reachable per source from its smallest edge source, with min hop."""
    return _reach_from_min(spark, sf_dir)


@register("u2_prune", _REACH_SQL + """
SELECT u.corpus_id, u.doc_id, u.ln, u.name FROM doc_units u
WHERE EXISTS (SELECT 1 FROM reach r WHERE r.corpus_id = u.corpus_id AND r.key = u.name)""")
def u2_prune(spark, sf_dir):
    kept = C.prune(_heads(spark, sf_dir), _reach_from_min(spark, sf_dir), ["corpus_id", "name"])
    return kept.select("corpus_id", "doc_id", "ln", "name")


_BUNDLE_SQL = _REACH_SQL + """, kept AS (
  SELECT u.* FROM doc_units u
  WHERE EXISTS (SELECT 1 FROM reach r WHERE r.corpus_id = u.corpus_id AND r.key = u.name))
SELECT corpus_id, (ord - 1) // 1000 AS part, CAST(count(*) AS BIGINT) AS n_parts,
       CAST(strlen(string_agg(line, chr(10) ORDER BY ord)) AS BIGINT) AS n_bytes,
       string_agg(line, chr(10) ORDER BY ord) AS text
FROM (SELECT corpus_id, line, row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id, ln) AS ord FROM kept)
GROUP BY corpus_id, (ord - 1) // 1000"""


def bundle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 on DOC: closure from each source's root -> prune -> order -> text parts."""
    kept = C.prune(_heads(spark, sf_dir), _reach_from_min(spark, sf_dir), ["corpus_id", "name"])
    return assemble.assemble_text(kept, ["corpus_id"], ["doc_id", "ln"], text_col="line")


register("c5_bundle_documents", _BUNDLE_SQL)(bundle_documents)


# ------------------------------------------------------------------ P9 / J1 / J2

@register("p9_identifier_refs", _PRE + "x AS (SELECT 1) SELECT corpus_id, src, dst FROM doc_mentions")
def p9_identifier_refs(spark, sf_dir):
    units = _units(spark, sf_dir)
    return symbols.identifier_refs(units.withColumnRenamed("name", "src"), ["corpus_id", "src"],
                                   "mentions", ref="dst")


@register("j1_known_refs", _PRE + "x AS (SELECT 1) SELECT corpus_id, src, dst FROM doc_edges")
def j1_known_refs(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("j2_key_else_name", _PRE + """any_name AS (SELECT name, min(corpus_id) AS target FROM doc_names GROUP BY name)
SELECT m.corpus_id, m.src, m.dst,
       coalesce(own.corpus_id, a.target) AS target,
       CASE WHEN own.corpus_id IS NOT NULL THEN 'key' WHEN a.target IS NOT NULL THEN 'name'
            ELSE 'missing' END AS status
FROM doc_mentions m
LEFT JOIN doc_names own ON own.corpus_id = m.corpus_id AND own.name = m.dst
LEFT JOIN any_name a ON a.name = m.dst""")
def j2_key_else_name(spark, sf_dir):
    """Resolve each mention in its own source first, else in any source."""
    names = A.doc_names(_heads(spark, sf_dir))
    by_key = names.select("corpus_id", F.col("name").alias("dst"), F.col("corpus_id").alias("t"))
    by_name = names.groupBy(F.col("name").alias("dst")).agg(F.min("corpus_id").alias("t"))
    return symbols.resolve_distinct_refs(A.doc_pairs(_units(spark, sf_dir)), by_key, by_name, ["corpus_id", "dst"],
                                         ["dst"], "src", "t", "t").select("corpus_id", "src", "dst", "target", "status")


# ------------------------------------------------------------------ A1 / A2 / A5 / A7

@register("a1_keep_last", _PRE + """r AS (SELECT corpus_id, name, doc_id, ln,
  row_number() OVER (PARTITION BY corpus_id, name ORDER BY doc_id DESC, ln DESC) AS rn FROM doc_units)
SELECT corpus_id, name, doc_id, ln FROM r WHERE rn = 1""")
def a1_keep_last(spark, sf_dir):
    units = _units(spark, sf_dir).select("corpus_id", "name", "doc_id", "ln")
    return symbols.keep_last(units, ["corpus_id", "name"], ["doc_id", "ln"])


@register("a2_keep_first", _PRE + """r AS (SELECT corpus_id, name, doc_id, ln,
  row_number() OVER (PARTITION BY corpus_id, name ORDER BY doc_id, ln) AS rn FROM doc_units)
SELECT corpus_id, name, doc_id, ln FROM r WHERE rn = 1""")
def a2_keep_first(spark, sf_dir):
    units = _units(spark, sf_dir).select("corpus_id", "name", "doc_id", "ln")
    return symbols.keep_first(units, ["corpus_id", "name"], ["doc_id", "ln"])


@register("a2_greedy", _PRE + """units_n AS (
  SELECT corpus_id, doc_id, ln, list_distinct(words[1:2]) AS names,
         row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id, ln) AS rn FROM doc_units
), g(corpus_id, rn, seen, kept) AS (
  SELECT corpus_id, rn, names, true FROM units_n WHERE rn = 1
  UNION ALL
  SELECT u.corpus_id, u.rn,
         CASE WHEN list_has_any(g.seen, u.names) THEN g.seen ELSE list_concat(g.seen, u.names) END,
         NOT list_has_any(g.seen, u.names)
  FROM g JOIN units_n u ON u.corpus_id = g.corpus_id AND u.rn = g.rn + 1
)
SELECT u.corpus_id, u.doc_id, u.ln, g.kept FROM units_n u JOIN g ON g.corpus_id = u.corpus_id AND g.rn = u.rn""")
def a2_greedy(spark, sf_dir):
    """Greedy const policy: a unit (names = its first two words) is kept only
    if no earlier kept unit of the source registered one of its names."""
    units = _units(spark, sf_dir).select(
        "corpus_id", "doc_id", "ln", F.array_distinct(F.slice("words", 1, 2)).alias("names"),
        F.struct("doc_id", "ln").alias("_ord"))
    units = materialize(units, "greedy_units")
    out = symbols.keep_first_greedy(units, ["corpus_id"], "_ord", "_ord", "names")
    return out.select("corpus_id", "doc_id", "ln", "kept")


@register("a5_name_multimap", _PRE + """x AS (SELECT 1)
SELECT name, CAST(count(*) AS BIGINT) AS n_units, CAST(count(DISTINCT corpus_id) AS BIGINT) AS n_sources
FROM doc_units GROUP BY name HAVING count(*) > 1""")
def a5_name_multimap(spark, sf_dir):
    return symbols.name_multimap(_units(spark, sf_dir), "name", "corpus_id")


_NEXT_SQL = """next AS (SELECT corpus_id, lead(corpus_id) OVER (ORDER BY corpus_id) AS next_id
  FROM (SELECT DISTINCT corpus_id FROM doc_names))
"""


@register("a7_exists_by_name", _PRE + _NEXT_SQL + """
SELECT a.corpus_id, a.name,
       EXISTS (SELECT 1 FROM doc_names b WHERE b.corpus_id = next_id AND b.name = a.name) AS in_next
FROM doc_names a JOIN next USING (corpus_id) WHERE next_id IS NOT NULL""")
def a7_exists_by_name(spark, sf_dir):
    """For every name of every source: does the next source declare it too."""
    names = materialize(A.doc_names(_units(spark, sf_dir)), "names")
    pairs = _next_corpus(names)
    left = names.join(pairs, "corpus_id").select("corpus_id", "next_id", "name")
    out = symbols.exists_by_name(left, names.withColumnRenamed("corpus_id", "next_id"), ["next_id", "name"], out="in_next")
    return out.select("corpus_id", "name", "in_next")


# ------------------------------------------------------------------ J5 / J6 / J7

@register("j5_merge_if_absent", _PRE + _NEXT_SQL + """
SELECT n.corpus_id AS root, a.name, a.corpus_id AS origin
FROM next n JOIN doc_names a ON a.corpus_id = n.corpus_id WHERE next_id IS NOT NULL
UNION ALL
SELECT n.corpus_id, b.name, b.corpus_id FROM next n JOIN doc_names b ON b.corpus_id = n.next_id
WHERE NOT EXISTS (SELECT 1 FROM doc_names a WHERE a.corpus_id = n.corpus_id AND a.name = b.name)""")
def j5_merge_if_absent(spark, sf_dir):
    """Every source's names, and those of the next source that it lacks."""
    names = materialize(A.doc_names(_units(spark, sf_dir)), "names")
    pairs = _next_corpus(names)
    base = names.join(pairs, "corpus_id").select(F.col("corpus_id").alias("root"), "name", F.col("corpus_id").alias("origin"))
    extra = (names.withColumnRenamed("corpus_id", "next_id").join(pairs, "next_id")
             .select(F.col("corpus_id").alias("root"), "name", F.col("next_id").alias("origin")))
    return symbols.merge_if_absent(base, extra, ["root", "name"])


@register("j6_missing_symbols", _PRE + """offers AS (SELECT name, count(*) AS n FROM doc_names GROUP BY name)
SELECT m.corpus_id, m.dst AS name, CAST(o.n AS BIGINT) AS n_providers
FROM (SELECT DISTINCT corpus_id, dst FROM doc_mentions) m JOIN offers o ON o.name = m.dst
WHERE NOT EXISTS (SELECT 1 FROM doc_names d WHERE d.corpus_id = m.corpus_id AND d.name = m.dst)""")
def j6_missing_symbols(spark, sf_dir):
    """Per source: mentioned, not declared there, offered by other sources."""
    units = _narrow_once(spark, sf_dir)
    names = materialize(A.doc_names(units), "names")
    mentioned = A.doc_mentions(units).select("corpus_id", F.col("dst").alias("name"))
    offered = names.groupBy("name").agg(F.count(F.lit(1)).alias("n_providers"))
    missing = C.missing_symbols(mentioned, names, offered, ["corpus_id", "name"], ["name"])
    return missing.join(offered, "name").select("corpus_id", "name", "n_providers")


_RANK_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_RANK.items())


@register("j7_provider_index", "WITH " + Q.doc_units() + f""", r AS (
  SELECT corpus_id, name, doc_id, lang, row_number() OVER (PARTITION BY corpus_id, name
    ORDER BY CASE lang {_RANK_SQL} ELSE -1 END DESC, doc_id) AS rn FROM doc_units)
SELECT corpus_id, name, doc_id, lang FROM r WHERE rn = 1""")
def j7_provider_index(spark, sf_dir):
    """(source, name) -> first document of the language of highest rank, and that language."""
    units = _units(spark, sf_dir).select("corpus_id", "name", "doc_id", "lang")
    return symbols.provider_index(units, ["corpus_id", "name"], "lang", LANG_RANK, provider="doc_id")


# ------------------------------------------------------------------ C2 / C4

@register("c2_package_closure", _PRE + f"""pairs AS (
  SELECT corpus_id, words[i + 1] AS name
  FROM (SELECT corpus_id, words, unnest(generate_series(1, len(words) - 1)) AS i FROM doc_units)
  WHERE words[i] = '{QUALIFIER}'
), seeds AS (
  SELECT DISTINCT p.corpus_id, p.name AS key FROM pairs p
  JOIN doc_names n ON n.corpus_id = p.corpus_id AND n.name = p.name
), """ + Q.bfs("reach", "seeds", "doc_edges") + """
SELECT corpus_id, key AS name, hop FROM reach""")
def c2_package_closure(spark, sf_dir):
    """Seeds = declared names used right after the qualifier word (P10);
    closure over the mention edges."""
    pairs = links.qualified_pairs(_units(spark, sf_dir), "words", ["corpus_id"], qualifier_value=QUALIFIER)
    seeds = (pairs.select("corpus_id", "name").distinct()
             .join(A.doc_names(_heads(spark, sf_dir)), ["corpus_id", "name"], "left_semi"))
    edges = materialize(_edges(spark, sf_dir), "doc_edges")
    return C.reachable(seeds, edges, ["corpus_id"], node="name", written=True)


# Fixed value: the language whose units count as constants, a document of it as their block.
BLOCK_LANG = "fr"


@register("c4_complete_missing", "WITH RECURSIVE " + Q.doc_units() + f""",
offers AS (
  SELECT name, doc_id, lang, ln, mentions, row_number() OVER (PARTITION BY name
    ORDER BY CASE lang {_RANK_SQL} ELSE -1 END DESC, doc_id, ln) AS rn
  FROM doc_units WHERE corpus_id <> '{ROOT_CORPUS}'),
chosen AS (SELECT name, doc_id, lang, mentions FROM offers WHERE rn = 1),
blocks AS (SELECT doc_id, name, mentions FROM doc_units WHERE corpus_id <> '{ROOT_CORPUS}' AND lang = '{BLOCK_LANG}'),
asks AS (
  SELECT DISTINCT TRUE AS at_root, '' AS src, unnest(mentions) AS dst FROM doc_units WHERE corpus_id = '{ROOT_CORPUS}'
  UNION ALL SELECT FALSE, name, unnest(mentions) FROM chosen WHERE lang IS DISTINCT FROM '{BLOCK_LANG}'
  UNION ALL SELECT DISTINCT FALSE, c.name, unnest(b.mentions) FROM chosen c JOIN blocks b
    ON b.doc_id = c.doc_id AND c.lang = '{BLOCK_LANG}'),
adds AS (
  SELECT name AS req, name, doc_id, lang, TRUE AS asked FROM chosen
  UNION ALL SELECT DISTINCT c.name, b.name, c.doc_id, c.lang, FALSE FROM chosen c JOIN blocks b
    ON b.doc_id = c.doc_id AND c.lang = '{BLOCK_LANG}' AND b.name <> c.name),
found(name, provider, kind, hop, asked, src) USING KEY (name) AS (
  SELECT DISTINCT name, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), TRUE, ''
  FROM doc_units WHERE corpus_id = '{ROOT_CORPUS}'
  UNION
  SELECT a.name, arg_min(a.doc_id, {{'n': NOT a.asked, 'd': a.doc_id}}), arg_min(a.lang, {{'n': NOT a.asked, 'd': a.doc_id}}),
         max(r.hop) + 1, bool_or(a.asked), a.name
  FROM (SELECT DISTINCT hop, src, hop = 0 AS at_root FROM found WHERE asked) r
  JOIN asks e ON e.at_root = r.at_root AND e.src = r.src JOIN adds a ON a.req = e.dst
  WHERE NOT EXISTS (SELECT 1 FROM recurring.found x WHERE x.name = e.dst)
    AND NOT EXISTS (SELECT 1 FROM recurring.found x WHERE x.name = a.name)
  GROUP BY a.name)
SELECT name, provider, kind, hop FROM found""")
def c4_complete_missing(spark, sf_dir):
    """Start from what the root source declares and add, round by round, what is
    mentioned and missing: of all other sources' units of a name the one of the language
    of highest rank (then first) is added, and of constants the whole document."""
    units = materialize(_units(spark, sf_dir).select("corpus_id", "doc_id", "lang", "ln", "name", "mentions"), "doc_names")
    root = units.where(F.col("corpus_id") == ROOT_CORPUS)
    block = F.coalesce(F.col("lang") == BLOCK_LANG, F.lit(False))
    source = F.struct("doc_id", F.when(~block, F.col("ln")).alias("ln"))  # a block is a whole document
    others = units.where(F.col("corpus_id") != ROOT_CORPUS).select(
        "name", "lang", "mentions", F.struct("doc_id", "ln").alias("spec"), block.alias("block"), source.alias("source"))
    chosen = symbols.provider_index(others, ["name"], "lang", LANG_RANK, provider="spec").select(
        "name", F.col("spec.doc_id").alias("provider"), F.col("lang").alias("kind"),
        F.struct(F.col("spec.doc_id").alias("doc_id"), F.when(~block, F.col("spec.ln")).alias("ln")).alias("source"))

    def named(df: DataFrame) -> DataFrame:  # a source as one text, equal where both parts are
        return df.withColumn("source", F.concat_ws(":", F.col("source.doc_id").cast("string"), F.col("source.ln").cast("string")))

    chosen = materialize(named(chosen), "chosen")
    asked = chosen.select("source").distinct()
    given = materialize(named(others).join(asked, "source", "left_semi").select("source", "name", "block", "mentions"), "sources")
    return C.complete_missing(
        root, root.select(F.explode("mentions").alias("name")), chosen,
        given.select("source", F.explode("mentions").alias("name")).distinct(),
        given.where("block").select("source", "name").distinct()).drop("asked")


# ------------------------------------------------------------------ W1 / R5 / O1

_W1_SQL = "WITH " + Q.doc_units() + f""", w AS (
  SELECT corpus_id, name, CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY name) AS BIGINT) AS ord
  FROM doc_names)
SELECT corpus_id, name, ord, {Q.ordinal_prefix('ord')} AS prefix FROM w"""


@register("w1_assign_prefixes", _W1_SQL)
def w1_assign_prefixes(spark, sf_dir):
    """Distinct names of each source (all languages) in order -> a, b, ..., z, aa, ..."""
    units = _units(spark, sf_dir)
    return links.assign_prefixes(units, ["corpus_id"], "name")


@register("r5_prefix_roundtrip", "WITH " + Q.doc_units() + f""", w AS (
  SELECT corpus_id, name, CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY name) AS BIGINT) AS ord
  FROM doc_names), p AS (SELECT corpus_id, name, {Q.ordinal_prefix('ord')} AS prefix FROM w)
SELECT corpus_id, name, prefix || name AS new_name,
       substr(prefix || name, length(prefix) + 1) AS orig_name,
       substr(prefix || name, length(prefix) + 1) = name AS same
FROM p""")
def r5_prefix_roundtrip(spark, sf_dir):
    prefixes = links.assign_prefixes(_units(spark, sf_dir), ["corpus_id"], "name")
    renamed = rename.rename_map(prefixes, ["corpus_id"], "name", "prefix")
    return rename.original_names(renamed, "new_name", "prefix").select(
        "corpus_id", "name", "new_name", "orig_name", (F.col("orig_name") == F.col("name")).alias("same"))


@register("o1_bundle_order", _PRE + """u AS (
  SELECT corpus_id, doc_id, ln, CAST(doc_id AS VARCHAR) || ':' || CAST(ln AS VARCHAR) AS key FROM doc_units)
SELECT corpus_id, doc_id, ln, key,
  CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id, ln) AS BIGINT) AS ord_natural,
  CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY key) AS BIGINT) AS ord_lex FROM u""")
def o1_bundle_order(spark, sf_dir):
    """Both bundle orders of every source's units: natural (doc, line) and
    the reference's string order of ``doc:line`` (where 10 sorts before 2)."""
    units = (_units(spark, sf_dir)
             .select("corpus_id", "doc_id", "ln",
                     F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ln").cast("string")).alias("key")))
    nat = assemble.bundle_order(units, ["corpus_id"], ["doc_id", "ln"], out="ord_natural")
    both = assemble.bundle_order(nat, ["corpus_id"], ["key"], out="ord_lex")
    return both.select("corpus_id", "doc_id", "ln", "key", "ord_natural", "ord_lex")


# ------------------------------------------------------------------ P1 / P4 / P10 / R2 / R3

@register("p1_tokens", r"""
SELECT corpus_id, word, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT source AS corpus_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)
GROUP BY corpus_id, word""")
def p1_tokens(spark, sf_dir):
    """Occurrences of every word per source, all languages, whole texts."""
    docs = A.table(spark, sf_dir, "documents")
    from ..operators import lex
    toks = lex.word_tokens(docs, ["source"], "text")
    return (toks.groupBy(F.col("source").alias("corpus_id"), "word")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("p4_split_units", "WITH " + Q.doc_units() + """
SELECT corpus_id, doc_id, ln, name, CAST(len(words) AS BIGINT) AS n_words FROM doc_units""")
def p4_split_units(spark, sf_dir):
    units = _units(spark, sf_dir)
    return units.select("corpus_id", "doc_id", "ln", "name",
                        F.size("words").cast("bigint").alias("n_words"))


@register("p10_qualified_refs", _PRE + f"""pairs AS (
  SELECT corpus_id, words[i + 1] AS name
  FROM (SELECT corpus_id, words, unnest(generate_series(1, len(words) - 1)) AS i FROM doc_units)
  WHERE words[i] = '{QUALIFIER}')
SELECT corpus_id, name, CAST(count(*) AS BIGINT) AS n_uses FROM pairs GROUP BY corpus_id, name""")
def p10_qualified_refs(spark, sf_dir):
    pairs = links.qualified_pairs(_units(spark, sf_dir), "words", ["corpus_id"],
                                  qualifier_value=QUALIFIER)
    return pairs.groupBy("corpus_id", "name").agg(F.count(F.lit(1)).cast("bigint").alias("n_uses"))


@register("r2_rename_tokens", _PRE + """toks AS (
  SELECT doc_id, source AS corpus_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS tok FROM documents)
SELECT t.doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(r.name) AS BIGINT) AS n_changed,
       CAST(sum(length(t.tok) + CASE WHEN r.name IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS new_chars
FROM toks t LEFT JOIN doc_names r ON r.corpus_id = t.corpus_id AND r.name = t.tok GROUP BY t.doc_id""")
def r2_rename_tokens(spark, sf_dir):
    """Rename every word that its own source declares to ``x`` + word; per
    document: words, words changed, new length."""
    docs = A.table(spark, sf_dir, "documents").withColumnRenamed("source", "corpus_id")
    renames = (A.doc_names(_heads(spark, sf_dir)).withColumnRenamed("name", "old_name")
               .withColumn("new_name", F.concat(F.lit("x"), F.col("old_name"))))
    from ..operators import lex
    # A document's equal words are looked up once: the join moves distinct words
    # with their counts, so a frequent word is no hot key.  Whole texts move to their
    # partition before they become words, which then are counted where they are.
    docs = docs.select("doc_id", "corpus_id", "text").repartition("doc_id")
    toks = (lex.word_tokens(docs, ["doc_id", "corpus_id"], "text").groupBy("doc_id", "corpus_id", "word")
            .agg(F.count(F.lit(1)).alias("n")))
    out = rename.rename_tokens(toks, renames, ["corpus_id"], "word")
    return out.groupBy("doc_id").agg(
        F.sum("n").cast("bigint").alias("n_words"),
        F.sum(F.when(F.col("renamed"), F.col("n")).otherwise(0)).cast("bigint").alias("n_changed"),
        F.sum(F.length("word") * F.col("n")).cast("bigint").alias("new_chars"))


@register("r3_rewrite_qualified", _PRE + f"""x AS (SELECT 1)
SELECT corpus_id, doc_id, ln, n_rewrites, CAST(len(new_words) AS BIGINT) AS n_words,
       array_to_string(new_words, ' ') AS text
FROM (
  SELECT corpus_id, doc_id, ln,
    CAST(len([i FOR i IN generate_series(1, len(words) - 1)
              IF words[i] = '{QUALIFIER}' AND words[i + 1] <> '{QUALIFIER}']) AS BIGINT) AS n_rewrites,
    list_filter([CASE WHEN words[i] = '{QUALIFIER}' AND i < len(words) AND words[i + 1] <> '{QUALIFIER}'
                      THEN '{QUALIFIER}_' || words[i + 1]
                      WHEN i > 1 AND words[i - 1] = '{QUALIFIER}' AND words[i] <> '{QUALIFIER}' THEN NULL
                      ELSE words[i] END FOR i IN generate_series(1, len(words))],
                lambda w: w IS NOT NULL) AS new_words
  FROM doc_units)""")
def r3_rewrite_qualified(spark, sf_dir):
    """Rewrite every (qualifier, word) pair into one token ``qualifier_word``."""
    units = _units(spark, sf_dir)
    out = rename.rewrite_qualified_words(units, "words", QUALIFIER, joiner="_")
    return out.select("corpus_id", "doc_id", "ln", "n_rewrites",
                      F.size("new_words").cast("bigint").alias("n_words"),
                      F.array_join("new_words", " ").alias("text"))


# ------------------------------------------------------------------ S2 / S4 / S5 / S7

@register("s2_exclude_outputs", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def s2_exclude_outputs(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "source")
    return sources.exclude_outputs(docs, A.table(spark, sf_dir, "labels"), ["doc_id"])


@register("s4_first_directive", _PRE + """c AS (
  SELECT doc_id, ln, trim(substr(trim(line), 5)) AS value,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS rn
  FROM doc_units WHERE starts_with(trim(line), 'The '))
SELECT doc_id, ln, value FROM c WHERE rn = 1""")
def s4_first_directive(spark, sf_dir):
    """First unit line of each document that starts with ``The ``."""
    docs = A.table(spark, sf_dir, "documents")
    return sources.first_directive(docs, "text", "The ", ["doc_id"], min_words=2).select(
        "doc_id", "ln", "value")


@register("s5_empty_groups", """
SELECT e.source AS corpus_id, e.lang, CAST(count(d.doc_id) AS BIGINT) AS n_docs,
       CASE WHEN count(d.doc_id) = 0 THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT DISTINCT source, lang FROM documents) e
LEFT JOIN documents d ON d.source = e.source AND d.lang = e.lang AND d.n_chars > 5000
GROUP BY e.source, e.lang""")
def s5_empty_groups(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    expected = docs.select(F.col("source").alias("corpus_id"), "lang").distinct()
    found = docs.where(F.col("n_chars") > 5000).select(F.col("source").alias("corpus_id"), "lang", "doc_id")
    return sources.corpus_status(expected, found, ["corpus_id", "lang"], "doc_id")


@register("s7_bundle_report", """
SELECT source AS corpus_id, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(count(*) AS BIGINT) AS n_docs
FROM documents GROUP BY source""")
def s7_bundle_report(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("source").alias("corpus_id"), "text")
    return sources.bundle_report(docs, ["corpus_id"], "text")


# ------------------------------------------------------------------ C5 on code

@register("c5_bundle_code", _PRE + """first AS (
  SELECT corpus_id, name AS key FROM (
    SELECT corpus_id, name, row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id, ln) AS rn
    FROM doc_units) WHERE rn = 1),
""" + Q.bfs("reach", "first", "doc_edges") + """,
kept AS (
  SELECT corpus_id, CAST(doc_id AS VARCHAR) || '.go' AS path, ln,
         'func w_' || name || '() {' || chr(10) || array_to_string([chr(9) || 'w_' || w || '()' || chr(10) FOR w IN mentions], '')
         || '}' AS part FROM doc_units u
  WHERE EXISTS (SELECT 1 FROM reach r WHERE r.corpus_id = u.corpus_id AND r.key = u.name)
), pieces AS (
  SELECT corpus_id, 0 AS sec, path, ln, part FROM kept
  UNION ALL SELECT DISTINCT corpus_id, -1, '', 0, 'package main' FROM doc_units
  UNION ALL SELECT corpus_id, 1, 'main.go', 0, 'func main() {' || chr(10) || chr(9) || 'w_' || key || '()' || chr(10) || '}' FROM first
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY sec, path, ln) AS ord,
         count(*) OVER (PARTITION BY corpus_id) - 1 AS n_specs FROM pieces)
SELECT corpus_id, (ord - 1) // 1000 AS part, CAST(count(*) AS BIGINT) AS n_parts,
       CAST(strlen(string_agg(part, chr(10) || chr(10) ORDER BY ord)) AS BIGINT) AS n_bytes,
       string_agg(part, chr(10) || chr(10) ORDER BY ord) AS text, CAST(min(n_specs) AS BIGINT) AS n_specs, 'ok' AS status
FROM ranked GROUP BY corpus_id, (ord - 1) // 1000""")
def c5_bundle_code(spark, sf_dir):
    """The full code bundle (lex -> specs -> policies -> mention graph ->
    closure from main -> prune -> rename -> assembly) on the CODE view of all
    documents: one Go program per source.  The text in parts, with the number of
    kept specs and the status of its program."""
    from .code_bundle import bundle_corpora
    files, manifests = A.doc_programs(A.table(spark, sf_dir, "documents"))
    out = bundle_corpora(files, manifests)
    return out["parts"].join(out["bundles"].select("corpus_id", "n_specs", "status"), "corpus_id")
