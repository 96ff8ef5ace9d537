"""S1/S6 on real files: read a program from a directory, bundle it, write the
bundle and read it back."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusgraph.plans.code_bundle import bundle_corpora
from corpusgraph.sources.files import (bundle_manifest, commit_bundles, read_bundles, read_corpora, read_source_files,
                                       vacuum_bundles, write_bundles)
from tests.code_fixtures import FLAT, NESTED


def test_read_bundle_write_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="corpusgraph-src-")
    tree = dict(NESTED)
    tree["money/money_test.go"] = "package money\n\nfunc TestIt() {}\n"
    tree["money/notes.txt"] = "not go\n"
    for rel, text in tree.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            fh.write(text)
    files = read_source_files(spark, root, corpus_id="nested")
    got = {r.path for r in files.collect()}
    assert got == {p for p in NESTED if p.endswith(".go")}
    assert {r.pkg_path for r in files.collect()} == {"app", "inventory", "money", "report", "internal/tbl"}
    manifests = spark.createDataFrame([("nested", "shopdemo", "app")],
                                      "corpus_id string, module_name string, root_pkg string")
    out = bundle_corpora(files.select("corpus_id", "path", "src"), manifests)
    assert out["bundles"].collect()[0].status == "ok"
    text = out["parts"].collect()[0].text
    assert "func aLoad(" in text and "TestIt" not in text

    dest = os.path.join(tempfile.mkdtemp(prefix="corpusgraph-out-"), "bundles")
    parts = spark.createDataFrame([("nested", 1, "package main"), ("nested", 2, "func main() {}"),
                                   ("other", 1, "package main")], "corpus_id string, ord int, text string")
    write_bundles(parts, dest)
    back = spark.read.text(os.path.join(dest, "corpus_id=nested")).collect()
    assert [r.value for r in back] == ["package main", "func main() {}"]
    assert spark.read.text(dest).where(F.col("corpus_id") == "other").count() == 1
    # a later run writes only its own corpora anew, and a bundle's parts can be written as they are
    write_bundles(out["parts"], dest, order_cols=["part"])
    assert spark.read.text(dest).where(F.col("corpus_id") == "other").count() == 1
    lines = [r.value for r in spark.read.text(os.path.join(dest, "corpus_id=nested")).collect()]
    assert "\n".join(lines) == text


def _bundles(spark, dest):
    return sorted((r.corpus_id or "", r.ord, r.text) for r in read_bundles(spark, dest).collect())


def test_commit_shows_whole_runs_only(spark):
    dest = os.path.join(tempfile.mkdtemp(prefix="corpusgraph-commit-"), "bundles")
    types = "corpus_id string, ord int, text string"
    first = [("007", 1, "package a"), ("007", 2, "func main() {}"), ("b", 1, "package b"), (None, 1, "é")]
    assert _bundles(spark, dest) == [] and vacuum_bundles(spark, dest) == []
    assert commit_bundles(spark.createDataFrame(first, types), dest) == 1
    want = sorted((c or "", o, t) for c, o, t in first)
    assert _bundles(spark, dest) == want
    sizes = {r.corpus_id: (r.v, r.n_parts, r.n_bytes) for r in bundle_manifest(spark, dest).collect()}
    assert sizes == {"007": (1, 2, 23), "b": (1, 1, 9), None: (1, 1, 2)}

    # a run that fails in its data: one corpus raises while the others are written
    second = spark.createDataFrame([("007", 1, "package a2"), ("c", 1, "package c")], types)
    bad = second.withColumn("text", F.when(F.col("corpus_id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        commit_bundles(bad, dest)
    assert _bundles(spark, dest) == want
    # a run that ends between data and manifest, and one within its manifest
    second.write.mode("overwrite").partitionBy("corpus_id").parquet(f"{dest}/data/v=2")
    assert _bundles(spark, dest) == want
    spark.createDataFrame([("c", 2, 1, 9)], "corpus_id string, v long, n_parts long, n_bytes long").write.parquet(
        f"{dest}/manifest/v=2")
    os.remove(f"{dest}/manifest/v=2/_SUCCESS")
    assert _bundles(spark, dest) == want

    # repeated, it takes the same number; others stay or vanish
    assert commit_bundles(second, dest, replace=False) == 2
    assert _bundles(spark, dest) == sorted([("", 1, "é"), ("007", 1, "package a2"), ("b", 1, "package b"), ("c", 1, "package c")])
    assert vacuum_bundles(spark, dest) == []
    assert commit_bundles(second, dest) == 3
    after = [("007", 1, "package a2"), ("c", 1, "package c")]
    assert _bundles(spark, dest) == after
    assert vacuum_bundles(spark, dest) == [1, 2]
    assert _bundles(spark, dest) == after and sorted(os.listdir(f"{dest}/data")) == ["v=3"]


def test_commit_of_an_empty_run(spark):
    dest = os.path.join(tempfile.mkdtemp(prefix="corpusgraph-commit-"), "bundles")
    parts = spark.createDataFrame([("a", 1, "x")], "corpus_id string, ord int, text string")
    commit_bundles(parts, dest)
    commit_bundles(parts.where("false"), dest, replace=False)
    assert _bundles(spark, dest) == [("a", 1, "x")]
    commit_bundles(parts.where("false"), dest)
    assert _bundles(spark, dest) == []


def test_a_tree_of_many_programs_in_one_call(spark):
    base = tempfile.mkdtemp(prefix="corpusgraph-tree-")
    tree = {f"shop/{k}": v for k, v in NESTED.items()} | {f"x y/flat/{k}": v for k, v in FLAT.items()}
    tree["shop/internal/lib/go.mod"] = "// a library inside\nmodule \"lib.example/inner\" // quoted\n"
    tree["shop/internal/lib/lib.go"] = "package lib\n"
    tree["shop/tool/main.go"] = "// package tool\npackage main\n\nfunc main() {}\n"
    tree["shop/tool/main_test.go"] = "package main\n"
    tree["shopping/loose.go"] = "package main\n"  # its folder's name only begins like a root's
    tree["empty/go.mod"] = "go 1.21\n"
    for rel, text in tree.items():
        full = os.path.join(base, rel)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as fh:
            fh.write(text)
    got = read_corpora(spark, base)
    programs = {tuple(r) for r in got["manifests"].collect()}
    assert programs == {("shop/app", "shopdemo", "app"), ("shop/tool", "shopdemo", "tool"), ("x y/flat", "flatdemo", "")}
    assert {tuple(r) for r in got["modules"].collect()} == {
        ("shop", "shopdemo", 2), ("x y/flat", "flatdemo", 1), ("shop/internal/lib", "lib.example/inner", 0)}
    assert [r.path for r in got["orphans"].collect()] == ["shopping/loose.go"]
    shop = {(k, v) for k, v in NESTED.items() if k.endswith(".go")} | {("tool/main.go", tree["shop/tool/main.go"])}
    files = {}
    for r in got["files"].collect():
        files.setdefault(r.corpus_id, set()).add((r.path, r.src))
    assert files == {"shop/app": shop, "shop/tool": shop, "x y/flat": {
        (k, v) for k, v in FLAT.items() if k.endswith(".go") and not k.endswith("_test.go")}}
    out = bundle_corpora(got["files"], got["manifests"])
    assert {r.corpus_id: r.status for r in out["bundles"].collect()} == {c: "ok" for c in files}
    dest = os.path.join(base, "out")
    commit_bundles(out["parts"], dest, order_cols=["part"])
    assert {r.corpus_id for r in read_bundles(spark, dest, "part bigint, text string").collect()} == set(files)
