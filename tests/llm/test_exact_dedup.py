import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import exact_dedup as D


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in enumerate(norm):
        ids = [rows[k][0] for k in groups[t] if rows[k][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a b"), (3, "a \t\n b"), (9, "a b"), (None, "a b"), (1, None), (2, ""), (4, " "), (7, "a b "),
        (8, "été\x0b\x0cx"), (10, "été x"), (11, "é" * 50_000), (12, "é" * 50_000), (13, "unique"),
        (6, "dup"), (6, "dup"), (None, "only null"), (None, "only null"), (14, "a b")]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("files", [20_000, 1])
def test_groups_equal_brute_force(spark, weak, files):
    """Also with a digest that collides, and over several micro-batches."""
    docs = spark.createDataFrame([(a, b, "x", 1, True) for a, b in ROWS],
                                 "doc_id long, text string, digest string, rid int, kept boolean").repartition(3)
    digest = (lambda c: F.pmod(F.crc32(c), F.lit(3)).cast("string")) if weak else D.sha256_digest
    out = D.exact_dedup(docs, digest=digest, files_per_batch=files).collect()
    body = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.row.text or "")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, hashlib.sha256(body(r).encode()).hexdigest()) for r in out),
                 key=str)
    assert got == brute(ROWS)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({body(r) for r in out})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_stage_keeps_columns_and_one_row_of_each_group(spark):
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in ROWS], "doc_id long, text string, rid string, n int")
    out = D.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, more string")
    assert D.exact_dedup(docs).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = D.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unique_ids_write_no_rows(spark):
    """Only numbers and digests are written; the kept rows come from the input itself."""
    from corpusgraph import session

    docs = spark.createDataFrame([(i, "ab"[i % 2] * 2000 + str(i // 4)) for i in range(40)], "doc_id long, text string")
    before = len(session._tables)
    kept = D.dedup_stage(spark, docs, "")
    for path in session._tables[before:]:
        assert "row" not in spark.read.parquet(path).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(4 * i + j for i in range(10) for j in (0, 1))


def test_without_moves_only_what_the_sieve_cannot_tell(spark):
    from pyspark.sql import functions as F

    from corpusgraph.llm.common import sieved, without

    rows = spark.range(2000).select(F.col("id").alias("rid"), F.repeat(F.lit("x"), 3).alias("text"))
    dropped = spark.range(0, 2000, 50).withColumnRenamed("id", "rid")
    assert sorted(r.rid for r in without(rows, dropped).collect()) == [i for i in range(2000) if i % 50]
    assert sieved(rows, dropped).count() < 60
    assert "LeftAnti" not in without(rows, dropped)._jdf.queryExecution().optimizedPlan().toString()
