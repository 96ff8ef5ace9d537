"""Queries over the PAGE view of ``pages`` (page = package, title word = its
name, ``href="/word"`` = an import of every page titled ``word``)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lex, links, symbols
from ..session import materialize
from ..sources import files as sources
from . import adapters as A
from . import closure as C
from . import sql as Q
from .registry import register

# The root page of the reachability query, the tags whose
# nesting is measured, and the file rules of the scan filter.
ROOT_PAGE = 0
NEST_TAGS = ("ul", "li", "div", "nav", "table")
FILE_SUFFIX = ".html"
EXCLUDED_HOST_PREFIX = "blog."
MIN_PAGES_PER_ROOT = 2

_PRE = "WITH RECURSIVE " + Q.page_nodes() + ",\n"


def _nodes(spark: SparkSession, sf_dir: str):
    return A.page_nodes(A.table(spark, sf_dir, "pages"))


# ------------------------------------------------------------------ S1 / S3

@register("s1_file_filter", f"""
SELECT page_id, url, regexp_extract(url, '^(?:[a-z]+://)?([^?#]*)', 1) AS path
FROM pages
WHERE ends_with(url, '{FILE_SUFFIX}')
  AND NOT starts_with(regexp_extract(url, 'https?://([^/?#]+)', 1), '{EXCLUDED_HOST_PREFIX}')""")
def s1_file_filter(spark, sf_dir):
    """URLs kept by the file rule: suffix ``.html``, host not starting ``blog.``."""
    pages = A.table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("_host", S.url_host("url"))
    kept = sources.filter_files(pages, "url", suffix=FILE_SUFFIX, exclude_suffix=None,
                                exclude_prefix=EXCLUDED_HOST_PREFIX, prefix_col="_host")
    return kept.select("page_id", "url", S.url_path("url").alias("path"))


@register("s3_nearest_root", _PRE + f"""dirs AS (
  SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, host FROM page_nodes
), roots AS (
  SELECT DISTINCT host AS root FROM page_nodes WHERE host <> ''
  UNION
  SELECT dir FROM dirs WHERE length(dir) - length(replace(dir, '/', '')) = 1
  GROUP BY dir HAVING count(*) >= {MIN_PAGES_PER_ROOT}
), anc0 AS (
  SELECT page_id, path, parts, unnest(generate_series(1, greatest(len(parts) - 1, 1))) AS k
  FROM (SELECT page_id, path, string_split(path, '/') AS parts FROM page_nodes)
), anc AS (
  SELECT page_id, path, array_to_string(parts[1:k], '/') AS a FROM anc0
), best AS (
  SELECT page_id, arg_max(a, length(a)) AS root FROM anc JOIN roots ON roots.root = anc.a GROUP BY page_id
)
SELECT n.page_id, n.path, best.root FROM page_nodes n LEFT JOIN best USING (page_id)""")
def s3_nearest_root(spark, sf_dir):
    """Longest ancestor directory that is a root: hosts and ``host/xx``
    directories holding at least two pages."""
    nodes = _nodes(spark, sf_dir).select("page_id", "path", "host")
    dirs = nodes.withColumn("dir", S.parent_dir("path"))
    sub_roots = (dirs.where(F.size(F.split("dir", "/")) == 2).groupBy(F.col("dir").alias("root"))
                 .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES_PER_ROOT)
                 .select("root"))
    roots = nodes.where(F.col("host") != "").select(F.col("host").alias("root")).unionByName(sub_roots)
    out = sources.nearest_root(nodes.select("page_id", "path"), roots)
    return out.select("page_id", "path", "root")


# ------------------------------------------------------------------ P2 / P3 / P8 / F1

@register("p2_strip_comments", """
SELECT page_id, CAST(length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS BIGINT) AS n_chars FROM pages""")
def p2_strip_comments(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.length(lex.strip_block_comments("html", "<!--", "-->"))
                        .cast("bigint").alias("n_chars"))


_TAG_RE = r"</?(?:" + "|".join(NEST_TAGS) + r")[\s>]"


@register("p3_nesting_depth", f"""WITH t AS (
  SELECT page_id, unnest(regexp_extract_all(html, '{_TAG_RE}')) AS tag,
         generate_subscripts(regexp_extract_all(html, '{_TAG_RE}'), 1) AS i FROM pages
), d AS (
  SELECT page_id, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END)
         OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth
  FROM t)
SELECT p.page_id, CAST(coalesce(max(greatest(d.depth, 0)), 0) AS BIGINT) AS max_depth
FROM pages p LEFT JOIN d USING (page_id) GROUP BY p.page_id""")
def p3_nesting_depth(spark, sf_dir):
    """Deepest nesting of a few block tags per page (running +1/-1 sum in
    order of occurrence, computed inside the page's row)."""
    pages = A.table(spark, sf_dir, "pages")
    tags = F.regexp_extract_all("html", F.lit(_TAG_RE), 0)
    deltas = F.transform(tags, lambda t: F.when(t.startswith("</"), F.lit(-1)).otherwise(F.lit(1)))
    return pages.select("page_id", lex.max_running_depth(deltas).cast("bigint").alias("max_depth"))


@register("p8_classify_links", """WITH n AS (
  SELECT page_id, regexp_extract(url, '^(?:[a-z]+://)?([^?#]*)', 1) AS import_path,
         regexp_replace(regexp_extract(url, 'https?://([^/?#]+)', 1), '^(www|m|blog)[.]', '') AS module FROM pages)
SELECT page_id, import_path, module, import_path = module OR starts_with(import_path, module || '/') AS is_local,
       split_part(import_path, '/', -1) AS alias, split_part(import_path, '/', -1) = '_' AS is_blank
FROM n""")
def p8_classify_links(spark, sf_dir):
    """URL path as the import path, the host without its front label (www, m, blog)
    as the module: pages of a front host are not module-local; alias = last segment."""
    pages = A.table(spark, sf_dir, "pages").select(
        "page_id", S.url_path("url").alias("path"),
        F.regexp_replace(S.url_host("url"), r"^(www|m|blog)[.]", "").alias("module"))
    out = links.classify_imports(pages, "path", "module")
    return out.select("page_id", "import_path", "module", "is_local", "alias", "is_blank")


@register("f1_string_scalars", """
SELECT page_id,
  ends_with(url, '.html') AS is_html,
  starts_with(url, 'https://') AS is_https,
  split_part(regexp_extract(url, '^(?:[a-z]+://)?([^?#]*)', 1), '/', -1) AS base,
  split_part(regexp_extract(url, 'https?://([^/?#]+)', 1), '.', 1) AS host_head,
  regexp_extract(regexp_extract(url, 'https?://([^/?#]+)', 1), '^[^.]*[.](.*)$', 1) AS host_rest,
  trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
  concat_ws(':', CAST(page_id AS VARCHAR), regexp_extract(url, 'https?://([^/?#]+)', 1)) AS pos_key
FROM pages""")
def f1_string_scalars(spark, sf_dir):
    """Suffix/prefix tests, base name, split on first dot, trim, position key."""
    pages = A.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = S.url_host("url")
    return pages.select(
        "page_id",
        F.col("url").endswith(".html").alias("is_html"),
        F.col("url").startswith("https://").alias("is_https"),
        S.base_name(S.url_path("url")).alias("base"),
        S.before_first_dot(host).alias("host_head"),
        S.after_first_dot(host).alias("host_rest"),
        F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"),
        F.concat_ws(":", F.col("page_id").cast("string"), host).alias("pos_key"))


# ------------------------------------------------------------------ A3 / J3 / J4

@register("a3_distinct_imports", _PRE + """x AS (SELECT 1)
SELECT DISTINCT host, ref FROM page_refs""")
def a3_distinct_imports(spark, sf_dir):
    return symbols.distinct_on(A.page_refs(_nodes(spark, sf_dir)), ["host", "ref"]).select("host", "ref")


@register("j3_resolve_links", _PRE + """targets AS (SELECT name, min(page_id) AS target FROM page_nodes
  WHERE name <> '' GROUP BY name)
SELECT DISTINCT r.page_id AS src, r.ref, t.target,
       CASE WHEN t.target IS NULL THEN 'missing' ELSE 'resolved' END AS status
FROM page_refs r LEFT JOIN targets t ON t.name = r.ref""")
def j3_resolve_links(spark, sf_dir):
    """Every link word resolved to the (first) page with that title, or missing."""
    nodes = _nodes(spark, sf_dir)
    refs = A.page_refs(nodes).select(F.col("page_id").alias("src"), "ref").distinct()
    packages = (nodes.where(F.col("name") != "").groupBy("name")
                .agg(F.min("page_id").alias("page_id")))
    return links.resolve_imports(refs, packages, "ref", "name", "page_id").select(
        "src", "ref", "target", "status")


@register("j4_exclude_siblings", _PRE + f"""two AS (
  SELECT DISTINCT a.src, b.dst FROM page_edges a JOIN page_edges b ON b.src = a.dst
  WHERE a.src = {ROOT_PAGE} AND a.src <> b.dst)
SELECT src, dst FROM two t
WHERE NOT EXISTS (SELECT 1 FROM page_edges e WHERE e.src = t.src AND e.dst = t.dst)""")
def j4_exclude_siblings(spark, sf_dir):
    """What the pages linked by the root page link to, without the root page's own
    links (the reference compares one root's imports with its sub-imports)."""
    nodes = _nodes(spark, sf_dir)
    return foreign_sub_imports(nodes, nodes.where(F.col("page_id") == ROOT_PAGE))


def foreign_sub_imports(nodes, roots):
    """``src, dst`` of any root pages: what their links link to, each without its own
    links and itself."""
    roots = roots.select(F.col("page_id").alias("src")).distinct()
    refs = A.page_refs(nodes).select(F.col("page_id").alias("src"), "ref").distinct()
    named = nodes.where(F.col("name") != "").select(F.col("name").alias("ref"), F.col("page_id").alias("dst"))
    direct = (roots.join(refs, "src").join(named, "ref").select("src", "dst").distinct())
    sub = links.sub_imports(roots, refs, named).where(F.col("src") != F.col("dst"))
    return links.exclude_siblings(sub, direct, ["src", "dst"])


# ------------------------------------------------------------------ C1 / C3

def _owners(reach, col: str, kind: str):
    """The owners among the nodes of a page graph; a link is two hops."""
    return reach.where(F.col("key").startswith("o:")).select(
        F.substring("key", 3, 1 << 20).cast(kind).alias(col), F.floor(F.col("hop") / 2).cast("bigint").alias("hop"))


@register("c1_reachable_pages", _PRE + f"""seeds AS (SELECT {ROOT_PAGE} AS key),
""" + Q.bfs("reach", "seeds", "page_edges", group=None) + """
SELECT key AS page_id, hop FROM reach""")
def c1_reachable_pages(spark, sf_dir):
    """Pages reachable from the root page, with min hop."""
    nodes = _nodes(spark, sf_dir)
    seeds = nodes.where(F.col("page_id") == ROOT_PAGE).select(
        F.concat(F.lit("o:"), F.col("page_id").cast("string")).alias("key"))
    return _owners(C.reachable(seeds, A.page_links(nodes), []), "page_id", "bigint")


@register("c3_transitive_packages", _PRE + """host_of AS (SELECT page_id, host FROM page_nodes),
host_edges AS (
  SELECT DISTINCT a.host AS src, b.host AS dst FROM page_edges e
  JOIN host_of a ON a.page_id = e.src JOIN host_of b ON b.page_id = e.dst WHERE a.host <> b.host),
seeds AS (SELECT min(host) AS key FROM page_nodes),
""" + Q.bfs("reach", "seeds", "host_edges", group=None) + """
SELECT key AS host, hop FROM reach""")
def c3_transitive_packages(spark, sf_dir):
    """Host graph (host imports host when one of its pages links to the
    other's): hosts reached from the smallest host with min hop."""
    nodes = _nodes(spark, sf_dir)
    seeds = nodes.agg(F.min("host").alias("host")).select(F.concat(F.lit("o:"), "host").alias("key"))
    return _owners(C.reachable(seeds, A.page_links(nodes, "host"), []), "host", "string")


@register("c3_flatten_packages", _PRE + """host_of AS (SELECT page_id, host FROM page_nodes),
host_edges AS (
  SELECT DISTINCT a.host AS src, b.host AS dst FROM page_edges e
  JOIN host_of a ON a.page_id = e.src JOIN host_of b ON b.page_id = e.dst WHERE a.host <> b.host),
root AS (SELECT min(host) AS host FROM page_nodes),
direct AS (SELECT DISTINCT dst AS host FROM host_edges WHERE src = (SELECT host FROM root)),
inner_edges AS (SELECT * FROM host_edges WHERE dst NOT IN (SELECT host FROM direct) AND dst <> (SELECT host FROM root)),
seeds AS (SELECT host AS owner, host AS key FROM direct),
members(owner, key, hop) USING KEY (owner, key) AS (
  SELECT owner, key, CAST(0 AS BIGINT) FROM seeds
  UNION
  SELECT r.owner, e.dst, min(r.hop + 1) FROM members r JOIN inner_edges e ON e.src = r.key
  WHERE NOT EXISTS (SELECT 1 FROM recurring.members x WHERE x.owner = r.owner AND x.key = e.dst)
  GROUP BY r.owner, e.dst),
names AS (
  SELECT m.owner, n.name, m.key, row_number() OVER (PARTITION BY m.owner, n.name ORDER BY m.hop, m.key) AS rn
  FROM members m JOIN (SELECT DISTINCT host, name FROM page_nodes WHERE name <> '') n ON n.host = m.key)
SELECT owner, name, max(CASE WHEN rn = 1 THEN key END) AS winner, CAST(count(*) - 1 AS BIGINT) AS n_lost
FROM names GROUP BY owner, name""")
def c3_flatten_packages(spark, sf_dir):
    """Hosts as packages: the titles that each host the root host links to gets when the
    hosts private to it become part of it, whose page wins, and how many lose."""
    nodes = materialize(_nodes(spark, sf_dir).select("host", "name", "refs"), "hosts")
    links_of = A.page_links(nodes, "host")
    own = lambda c: F.substr(F.col(c), F.lit(3))
    # Word nodes stay in between, so that a title of many hosts costs no pairs of them.
    root = nodes.agg(F.min("host").alias("host")).select(F.concat(F.lit("o:"), "host").alias("key"))
    words = links_of.join(root.withColumnRenamed("key", "src"), "src").select(F.col("dst").alias("src"))
    direct = links_of.join(words, "src").select(F.col("dst").alias("key")).join(root, "key", "left_anti").distinct()
    named = direct.unionByName(root).withColumnRenamed("key", "dst")
    members = C.reachable(direct.withColumn("owner", F.col("key")), links_of.join(named, "dst", "left_anti"), [],
                          carry=["owner"]).where(F.col("key").startswith("o:"))
    members = members.select(own("owner").alias("owner"), own("key").alias("key"), "hop")
    found = C.flattened_names(members, nodes.where("name <> ''").select(F.col("host").alias("key"), "name"), [])
    return found.groupBy("owner", "name").agg(F.min("winner").alias("winner"), F.count_if("lost").alias("n_lost"))
