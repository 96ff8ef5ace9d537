"""Shared SQL fragments for the DuckDB oracles.

The oracles are independent formulations of each query in plain SQL (DuckDB
dialect, run on the same parquet tables).  They are only used to check the
Spark operators; nothing in the library executes them.
"""

from __future__ import annotations


def ordinal_prefix(n: str) -> str:
    """1 -> a, 26 -> z, 27 -> aa as SQL: the place among the words of its length,
    written in base 26 with that many digits (all of BIGINT)."""
    least = [sum(26 ** j for j in range(1, k)) + 1 for k in range(1, 16)]  # first ordinal of k letters
    size = " ".join(f"WHEN {n} < {least[k]} THEN {k}" for k in range(1, 14)) + " ELSE 14"
    first = f"[{', '.join(str(x) for x in least[:14])}]::HUGEINT[]"
    power = f"[{', '.join(str(26 ** k) for k in range(14))}]::HUGEINT[]"
    k = f"(CASE {size} END)"
    return (f"array_to_string(list_transform(generate_series({k}, 1, -1), "
            f"lambda d: chr(CAST(97 + (({n} - ({first})[{k}]) // ({power})[d]) % 26 AS INTEGER))), '')")


def doc_units() -> str:
    """CTEs ``doc_units`` (and helpers) mirroring adapters.doc_units."""
    return """doc_lines AS (
  SELECT source AS corpus_id, doc_id, lang, unnest(arr) AS line, generate_subscripts(arr, 1) AS ln
  FROM (SELECT source, doc_id, lang, string_split(text, chr(10)) AS arr FROM documents)
), doc_w AS (
  SELECT *, regexp_extract_all(lower(line), '\\p{L}+') AS words FROM doc_lines
), doc_units AS (
  SELECT corpus_id, doc_id, lang, CAST(ln AS BIGINT) AS ln, line, words, words[1] AS name,
         [w FOR w IN words[2:] IF w <> words[1]] AS mentions
  FROM doc_w WHERE len(words) >= 2
), doc_names AS (
  SELECT DISTINCT corpus_id, name FROM doc_units
), doc_mentions AS (
  SELECT DISTINCT corpus_id, src, dst FROM (
    SELECT corpus_id, name AS src, unnest(mentions) AS dst FROM doc_units)
), doc_edges AS (
  SELECT m.* FROM doc_mentions m
  WHERE EXISTS (SELECT 1 FROM doc_names n WHERE n.corpus_id = m.corpus_id AND n.name = m.dst)
)"""


def bfs(name: str, seeds: str, edges: str, group: str | None = "corpus_id") -> str:
    """Exact breadth-first closure with min hop: a recursive CTE keyed on the
    node (``USING KEY``), extending only with nodes not seen before."""
    if group:
        g_sel, g_join, g_key = f"e.{group}, ", f"e.{group} = r.{group} AND ", f"{group}, "
        g_x = f"x.{group} = e.{group} AND "
    else:
        g_sel = g_join = g_key = g_x = ""
    return f"""{name}({g_key}key, hop) USING KEY ({g_key}key) AS (
  SELECT {g_key}key, CAST(0 AS BIGINT) FROM {seeds}
  UNION
  SELECT {g_sel}e.dst, min(r.hop + 1) FROM {name} r JOIN {edges} e ON {g_join}e.src = r.key
  WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} x WHERE {g_x}x.key = e.dst)
  GROUP BY {g_sel}e.dst
)"""


def page_nodes() -> str:
    return r"""page_nodes AS (
  SELECT page_id, url,
         lower(regexp_extract(html, '<title>(\p{L}+)', 1)) AS name,
         regexp_extract(url, 'https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^(?:[a-z]+://)?([^?#]*)', 1) AS path,
         [lower(x) FOR x IN regexp_extract_all(html, 'href="/(\p{L}+)"', 1)] AS refs
  FROM pages
), page_refs AS (
  SELECT page_id, host, unnest(refs) AS ref FROM page_nodes
), page_edges AS (
  SELECT DISTINCT r.page_id AS src, n.page_id AS dst
  FROM (SELECT DISTINCT page_id, ref FROM page_refs) r
  JOIN page_nodes n ON n.name = r.ref AND n.name <> ''
  WHERE r.page_id <> n.page_id
)"""
