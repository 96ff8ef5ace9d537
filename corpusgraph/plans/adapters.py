"""Views of the driver tables as corpora of named units (DOC) and as pages that
link to each other (PAGE).  Adapters only reshape rows into the schemas the
operators expect (``corpus_id``, ``path``, ``name``, ``mentions`` …); all graph,
join, dedup and assembly work happens in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_units(documents: DataFrame, min_mention: int = 1) -> DataFrame:
    """One row per line with at least two words.

    corpus_id=source, path=doc_id, ln (1-based), name=first word,
    mentions=later words that differ from the name (of at least
    ``min_mention`` letters; the default keeps all).
    """
    d = documents.select("doc_id", "source", "lang", "text")
    # Words are computed inside the generator so that later filters refer to
    # the generated column instead of re-running the regex.
    per_line = F.transform(S.lines("text"), lambda ln: F.struct(ln.alias("line"),
                                                                S.words(ln).alias("words")))
    ex = d.select(F.col("source").alias("corpus_id"), "doc_id", "lang",
                  F.posexplode(per_line).alias("pos", "u"))
    ex = ex.select("corpus_id", "doc_id", "lang", "pos", "u.line", "u.words").where(
        F.size("words") >= 2)
    name = F.col("words")[0]
    return ex.select(
        "corpus_id", "doc_id", "lang", (F.col("pos") + 1).cast("bigint").alias("ln"), "line",
        "words", name.alias("name"),
        F.filter(F.slice("words", 2, F.size("words")),
                 lambda w: (F.length(w) >= min_mention) & (w != name)).alias("mentions"))


#: A line with two words: its first one, and a letter of the second.
FIRST_OF_TWO = r"^\P{L}*(\p{L}++)\P{L}+\p{L}"


def doc_heads(documents: DataFrame) -> DataFrame:
    """The units of :func:`doc_units` without their words: ``corpus_id, doc_id, ln, line,
    name``.  A line is read up to its second word only, so who needs no mentions does not
    scan the text for them."""
    ex = documents.select(F.col("source").alias("corpus_id"), "doc_id", F.posexplode(S.lines("text")).alias("pos", "line"))
    ex = ex.withColumn("name", F.regexp_extract(F.lower("line"), FIRST_OF_TWO, 1)).where("name <> ''")
    return ex.select("corpus_id", "doc_id", (F.col("pos") + 1).cast("bigint").alias("ln"), "line", "name")


def doc_pairs(units: DataFrame) -> DataFrame:
    """Every mention of DOC as (corpus_id, src=name, dst=mentioned word), once a line."""
    return units.select("corpus_id", F.col("name").alias("src"), F.explode(F.array_distinct("mentions")).alias("dst"))


def doc_mentions(units: DataFrame) -> DataFrame:
    """P9 on DOC: distinct (corpus_id, src=name, dst=mentioned word)."""
    return doc_pairs(units).distinct()


def doc_names(units: DataFrame) -> DataFrame:
    return units.select("corpus_id", "name").distinct()


def page_nodes(pages: DataFrame) -> DataFrame:
    """PAGE: node per page with its title word, host, path and linked words."""
    return pages.select(
        "page_id", "url",
        F.lower(F.regexp_extract("html", r"<title>(\p{L}+)", 1)).alias("name"),
        S.url_host("url").alias("host"),
        S.url_path("url").alias("path"),
        F.transform(F.regexp_extract_all("html", F.lit(r'href="/(\p{L}+)"'), 1),
                    lambda w: F.lower(w)).alias("refs"))


def page_refs(nodes: DataFrame) -> DataFrame:
    return nodes.select("page_id", "host", F.explode("refs").alias("ref"))


def page_links(nodes: DataFrame, owner: str = "page_id") -> DataFrame:
    """The graph owner -> link word -> owner of a page with that title, with the
    words as nodes of their own (``w:``, owners ``o:``): two hops per link, and as
    many edges as there are links and titles, however often a word is a title."""
    own = F.concat(F.lit("o:"), F.col(owner).cast("string"))
    out = nodes.select(own.alias("src"), F.explode("refs").alias("ref")).select(
        "src", F.concat(F.lit("w:"), "ref").alias("dst"))
    back = nodes.where(F.col("name") != "").select(F.concat(F.lit("w:"), "name").alias("src"), own.alias("dst"))
    return out.unionByName(back).distinct()


# Fixed value: identifiers of the code view are words behind this prefix, so
# that no word can collide with a Go keyword.
CODE_IDENT_PREFIX = "w_"


def doc_programs(documents: DataFrame):
    """CODE view of DOC: every source becomes one Go program (module
    ``docs/<source>``, root package ``''``).  Each document is a file in which
    every unit is ``func w_<name>() { w_<mention>() ... }``; a ``main.go`` per
    source calls the function of the source's first unit (by doc, line).

    Returns ``(files, manifests)`` in the schema of ``code_bundle``.  Only
    text formatting happens here; lexing, declarations, the mention graph and
    pruning are the code bundle's job.
    """
    d = documents.select("doc_id", "source", "text")
    p = F.lit(CODE_IDENT_PREFIX)
    per_line = F.filter(F.transform(S.lines("text"), lambda ln: S.words(ln)), lambda w: F.size(w) >= 2)
    funcs = F.transform(per_line, lambda w: F.concat(
        F.lit("func "), p, w[0], F.lit("() {\n"),
        F.array_join(F.transform(
            F.filter(F.slice(w, 2, F.size(w)), lambda m: m != w[0]),
            lambda m: F.concat(F.lit("\t"), p, m, F.lit("()\n"))), ""),
        F.lit("}\n")))
    files = d.select(F.col("source").alias("corpus_id"),
                     F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"),
                     F.concat(F.lit("package main\n\n"), F.array_join(funcs, "\n")).alias("src"))
    first = (doc_heads(documents).groupBy("corpus_id")
             .agg(F.min_by("name", F.struct("doc_id", "ln")).alias("first")))
    mains = first.select("corpus_id", F.lit("main.go").alias("path"),
                         F.concat(F.lit("package main\n\nfunc main() {\n\t"), p, F.col("first"),
                                  F.lit("()\n}\n")).alias("src"))
    manifests = first.select("corpus_id", F.concat(F.lit("docs/"), F.col("corpus_id")).alias("module_name"),
                             F.lit("").alias("root_pkg"))
    return files.unionByName(mains), manifests
