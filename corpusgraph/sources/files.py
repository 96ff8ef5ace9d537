"""Sources and sinks (S1-S7): files as rows, manifests, status and bundle output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize


def read_source_files(spark: SparkSession, path: str, include: str = "*.go",
                      exclude_suffix: str | None = "_test.go", recursive: bool = True,
                      corpus_id: str | None = None) -> DataFrame:
    """Every matching file under ``path`` as one row (whole text).

    Returns ``corpus_id, pkg_path, path, file_name, src``.  ``pkg_path`` is the
    directory of the file relative to ``path``.  Listing and reading are file
    scan tasks; the glob filter is applied during listing.
    """
    reader = spark.read.option("pathGlobFilter", include)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    # ``text()`` has its own wholetext argument; the reader option alone is overridden.
    df = reader.text(path, wholetext=True).select(F.col("value").alias("src"),
                                  F.col("_metadata.file_path").alias("_abs"))
    # Paths as the file system names them (with scheme and host), then decoded:
    # the metadata column is URL-encoded and always full.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(hadoop).toUri().getPath().rstrip("/")
    plain = F.url_decode(F.replace(F.regexp_replace("_abs", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    rel = F.regexp_replace(plain, "^" + _regex_quote(root) + "/?", "")
    df = df.select(
        F.lit(corpus_id or root).alias("corpus_id"),
        S.parent_dir(rel).alias("pkg_path"),
        rel.alias("path"),
        S.base_name(rel).alias("file_name"),
        "src")
    if exclude_suffix:
        df = df.where(~F.col("file_name").endswith(exclude_suffix))
    return df


def _regex_quote(s: str) -> str:
    import re
    return re.escape(s)


def filter_files(files: DataFrame, name_col: str, suffix: str | None = ".go",
                 exclude_suffix: str | None = "_test.go", exclude_prefix: str | None = None,
                 prefix_col: str | None = None) -> DataFrame:
    """S1 on an existing table of names: keep ``suffix``, drop ``exclude_suffix``
    and (optionally) names whose ``prefix_col`` starts with ``exclude_prefix``."""
    cond = F.lit(True)
    if suffix:
        cond = cond & F.col(name_col).endswith(suffix)
    if exclude_suffix:
        cond = cond & ~F.col(name_col).endswith(exclude_suffix)
    if exclude_prefix:
        cond = cond & ~F.col(prefix_col or name_col).startswith(exclude_prefix)
    return files.where(cond)


def exclude_outputs(files: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Do not re-read earlier outputs (``left_anti`` on the full key)."""
    return files.join(outputs.select(*on).distinct(), list(on), "left_anti")


def nearest_root(paths: DataFrame, roots: DataFrame, path_col: str = "path",
                 root_col: str = "root") -> DataFrame:
    """S3: for every path, its longest ancestor directory that is a root.

    Ancestors are exploded inside the row (bounded by path depth) and
    equi-joined with the roots; ``max_by(root, length)`` picks the longest,
    aggregated map-side.  Paths without a root get NULL.
    """
    anc = paths.select(path_col, F.explode(S.ancestors(path_col)).alias(root_col))
    hits = anc.join(roots.select(root_col).distinct(), root_col)
    best = hits.groupBy(path_col).agg(F.max_by(root_col, F.length(root_col)).alias(root_col))
    return paths.join(best, path_col, "left")


def first_directive(files: DataFrame, text_col: str, prefix: str, key_cols: Sequence[str],
                    min_words: int = 0, strict: bool = False) -> DataFrame:
    """First line whose trimmed text starts with ``prefix``; the rest,
    trimmed, is the value (e.g. the ``module`` line of a manifest).

    Scans the lines of each file inside its row (no shuffle).  Files without
    such a line are dropped, or raise with ``strict=True``.
    """
    lines = S.lines(text_col)
    cands = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(lines)),
                    lambda i: F.struct(i.cast("bigint").alias("ln"), F.get(lines, i - 1).alias("line"))),
        lambda s: F.trim(s["line"]).startswith(prefix) & (F.size(S.words(s["line"])) >= min_words))
    first = F.get(cands, 0)
    out = files.select(*key_cols, first.alias("_f"))
    if strict:
        out = out.withColumn("_f", F.coalesce(F.col("_f"), F.raise_error(
            F.lit(f"no line starting with {prefix!r}"))))
    out = out.where(F.col("_f").isNotNull())
    return out.select(*key_cols, F.col("_f.ln").alias("ln"),
                      F.trim(F.substr(F.trim(F.col("_f.line")), F.lit(len(prefix) + 1))).alias("value"))


def corpus_status(expected: DataFrame, found: DataFrame, group_cols: Sequence[str],
                  count_col: str, strict: bool = False) -> DataFrame:
    """Every expected group with its number of found rows and a status
    (``empty`` when zero).  ``strict=True`` fails the job on an empty group,
    naming it, as the reference does for a directory without files."""
    counts = found.groupBy(*group_cols).agg(F.count(count_col).alias("_n"))
    out = (expected.select(*group_cols).distinct().join(counts, list(group_cols), "left")
           .select(*group_cols, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_docs")))
    status = F.when(F.col("n_docs") == 0, F.lit("empty")).otherwise(F.lit("ok"))
    if strict:
        status = F.when(F.col("n_docs") == 0, F.raise_error(
            F.concat(F.lit("no files found in "), F.concat_ws("/", *group_cols)))).otherwise(F.lit("ok"))
    return out.withColumn("status", status)


def bundle_report(bundles: DataFrame, group_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and number of texts per group."""
    return bundles.groupBy(*group_cols).agg(
        F.sum(F.octet_length(text_col)).cast("bigint").alias("n_bytes"),
        F.count(F.lit(1)).cast("bigint").alias("n_docs"))


def write_bundles(parts: DataFrame, path: str, group_col: str = "corpus_id",
                  order_cols: Sequence[str] = ("ord",), text_col: str = "text",
                  fmt: str = "text") -> None:
    """Write bundles, one directory per corpus, overwriting earlier output of
    the same corpora (others stay).

    Writes ordered *parts* (not one giant string): rows are range-partitioned
    on (corpus, order) and sorted inside each partition, so the files of a
    corpus directory, read in part-number order, give the bundle in order.
    """
    keys = [group_col, *order_cols]
    ordered = parts.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    writer = (ordered.select(group_col, text_col).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy(group_col))
    if fmt == "text":
        writer.text(path)
    else:
        writer.format(fmt).save(path)


def _folder(spark: SparkSession, path: str):
    """File system and Hadoop path of ``path``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str, committed: bool = True) -> list[int]:
    """Numbers of the versions below ``path``; ``committed``: those whose write ended."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    if committed:
        success = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [p for p in found if fs.exists(success(p, "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in found)


def commit_bundles(parts: DataFrame, path: str, group_col: str = "corpus_id",
                   order_cols: Sequence[str] = ("ord",), text_col: str = "text",
                   replace: bool = True) -> int:
    """S6 with a commit: readers see all bundles of a run or none; returns its version.

    The parts go to ``path/data/v=N`` (one folder per corpus), then a manifest of the live
    corpora (``group_col, v, n_parts, n_bytes``) to ``path/manifest/v=N``.  A manifest
    counts once its ``_SUCCESS`` marker, a single file, is there; until then readers keep
    to the one before, so a run that ended halfway has no effect and can be repeated: it
    takes the same number and overwrites what was left.  With ``replace`` corpora that
    are not in ``parts`` vanish; otherwise the manifest names their earlier version.  One
    writer at a time.  An empty run with ``replace`` leaves no bundles.
    """
    spark, base = parts.sparkSession, path.rstrip("/")
    done = _versions(spark, f"{base}/manifest")
    version = done[-1] + 1 if done else 1
    keys = [group_col, *order_cols]
    (parts.select(*keys, text_col).repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
     .write.mode("overwrite").partitionBy(group_col).parquet(f"{base}/data/v={version}"))
    schema = parts.select(*order_cols, text_col, group_col).schema
    # The manifest tells what was written, not what ``parts`` would give if computed again.
    written = spark.read.schema(schema).parquet(f"{base}/data/v={version}")
    live = written.groupBy(group_col).agg(
        F.lit(version).cast("bigint").alias("v"), F.count(F.lit(1)).alias("n_parts"),
        F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"))
    if done and not replace:
        before = spark.read.parquet(f"{base}/manifest/v={done[-1]}")
        mine = live.select(F.col(group_col).alias("_mine"))
        live = live.unionByName(before.join(mine, F.col(group_col).eqNullSafe(F.col("_mine")), "left_anti"))
    live.write.mode("overwrite").parquet(f"{base}/manifest/v={version}")
    return version


def bundle_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed manifest, or None before the first commit."""
    done = _versions(spark, f"{path.rstrip('/')}/manifest")
    return spark.read.parquet(f"{path.rstrip('/')}/manifest/v={done[-1]}") if done else None


def read_bundles(spark: SparkSession, path: str, schema: str = "ord int, text string",
                 group_col: str = "corpus_id") -> DataFrame:
    """The committed parts: ``group_col`` and the columns of ``schema`` (order and text).

    Only folders that the manifest names are read (partition pruning by the join), so
    leftovers of a run that ended halfway are never seen.
    """
    base, live = path.rstrip("/"), bundle_manifest(spark, path)
    columns = f"{schema}, v bigint, {group_col} string"
    if live is None:
        return spark.createDataFrame([], columns).drop("v")
    data = spark.read.schema(columns).parquet(f"{base}/data")
    named = live.select(F.col(group_col).cast("string").alias("_live"), F.col("v").alias("_v"))
    return data.join(named, data["v"].eqNullSafe(named["_v"]) & data[group_col].eqNullSafe(named["_live"]),
                     "left_semi").drop("v")


def vacuum_bundles(spark: SparkSession, path: str) -> list[int]:
    """Delete data versions that the newest manifest does not name and older manifests;
    returns the data versions deleted.  Not while a run writes or old versions are read."""
    base, live = path.rstrip("/"), bundle_manifest(spark, path)
    if live is None:
        return []
    named = {r.v for r in live.select("v").distinct().collect()}  # one row a version
    newest = _versions(spark, f"{base}/manifest")[-1]
    gone = [v for v in _versions(spark, f"{base}/data", committed=False) if v not in named]
    old = [v for v in _versions(spark, f"{base}/manifest", committed=False) if v != newest]
    for folder in [f"{base}/data/v={v}" for v in gone] + [f"{base}/manifest/v={v}" for v in old]:
        fs, p = _folder(spark, folder)
        fs.delete(p, True)
    return gone


def read_corpora(spark: SparkSession, path: str, include: str = "*.go", manifest: str = "go.mod",
                 module_directive: str = "module ", package_directive: str = "package ",
                 root_package: str = "main", exclude_suffix: str | None = "_test.go") -> dict[str, DataFrame]:
    """S1, S3 and S4 over a whole tree: every program below ``path``, in one call.

    A folder with a ``manifest`` is the root of a module; a file belongs to the innermost
    root above it.  Every package named ``root_package`` makes a corpus of the files of its
    module (``corpus_id``: the package's folder below ``path``, ``.`` for ``path`` itself).
    Returns ``files`` (corpus_id, path below the module's root, src) and ``manifests``
    (corpus_id, module_name, root_pkg), which ``bundle_corpora`` takes as they are,
    ``modules`` (root, module_name, n_programs; 0: nothing to bundle) and ``orphans``
    (path of the files below no root).  A manifest without the directive is no root.
    """
    every = read_source_files(spark, path, include=f"{{{include},{manifest}}}", exclude_suffix=exclude_suffix)
    # "./" makes ``path`` itself an ancestor of every file.
    every = every.select(F.concat(F.lit("./"), "path").alias("path"), "file_name", "src")
    sources = every.where(F.col("file_name") != manifest)
    roots = first_directive(every.where(F.col("file_name") == manifest).select(S.parent_dir("path").alias("root"), "src"),
                            "src", module_directive, ["root"])
    roots = materialize(roots.select("root", F.regexp_extract("value", r'^"?([^"\s]+)', 1).alias("module_name")), "roots")
    heads = first_directive(sources.select("path", "src"), "src", package_directive, ["path"])
    heads = heads.select("path", F.regexp_extract("value", r"^(\w+)", 1).alias("package"))
    # Only paths and names are placed; the texts are joined once, at the end.
    places = nearest_root(sources.select("path"), roots).join(heads, "path", "left")
    places = materialize(places.withColumn("rel", F.expr("substring(path, length(root) + 2)")), "places")
    mains = (places.where(F.col("root").isNotNull() & (F.col("package") == root_package))
             .select("root", S.parent_dir("rel").alias("root_pkg")).distinct())
    folder = F.regexp_replace(F.concat_ws("/", "root", F.when(F.col("root_pkg") != "", F.col("root_pkg"))), r"^\./", "")
    programs = materialize(mains.join(roots, "root").select("root", folder.alias("corpus_id"), "module_name", "root_pkg"),
                           "programs")
    members = places.where(F.col("root").isNotNull()).join(programs, "root").select("corpus_id", "path", "rel")
    counts = programs.groupBy("root").agg(F.count(F.lit(1)).alias("n_programs"))
    bare = F.expr("substring(path, 3)").alias("path")
    return {
        "files": sources.join(members, "path").select("corpus_id", F.col("rel").alias("path"), "src"),
        "manifests": programs.select("corpus_id", "module_name", "root_pkg"),
        "modules": roots.join(counts, "root", "left").select(
            F.regexp_replace("root", r"^\./", "").alias("root"), "module_name",
            F.coalesce("n_programs", F.lit(0)).cast("bigint").alias("n_programs")),
        "orphans": places.where(F.col("root").isNull()).select(bare),
    }
