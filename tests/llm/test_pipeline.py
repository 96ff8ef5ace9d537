"""The pipeline on a small table, each stage against its brute-force version."""

import re
from fractions import Fraction

import corpus_pipeline
import __spark_entry__ as entry
from corpusgraph.llm import packing
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import brute as near_groups

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = sorted(r.doc_id for r in out.collect())
        if name == "language_id":
            want = [k for k, t in rows if t and any(c.isalpha() for c in t)]
        elif name == "exact_dedup":
            first = {}
            for k, t in rows:
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), k)
            want = sorted(first.values())
        elif name == "near_dedup":
            _, label = near_groups(rows, 5, Fraction(4, 5))
            want = [rows[k][0] for k in sorted(set(label))]
        else:
            want = sorted(k for k, _, hit, _ in contaminated(rows, bench) if not hit)
        assert got == want, name
        docs = out
    pieces = packing.packing_stage(spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(want)


def test_run_is_registered(spark):
    out = entry.queries()["pipeline"](spark, SF)
    assert "sequence_id" in out.columns and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
