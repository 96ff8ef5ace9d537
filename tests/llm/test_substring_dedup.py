import random
import re

import pytest

from corpusgraph.llm import substring_dedup as S
from corpusgraph.llm.common import keyed


def brute(rows, window):
    """rows in order; -> [(n_words, n_removed, kept)]"""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    seen, out = set(), []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            if x in seen:
                gone |= set(range(i, i + window))
            seen.add(x)
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" if k % 3 else f"é{k}" for k in range(40)]
    passages = [[r.choice(vocab) for _ in range(r.randint(5, 40))] for _ in range(6)]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(1, 25))]
        rows.append(r.choice([" ", "\n", " \t"]).join(w))
    return rows + [None, "", "a " * 300, "a " * 19, "a a a b " * 30, rows[3], rows[3], " ".join(vocab * 50)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [100_000, 1])
def test_equal_to_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(rows)],
                                 "doc_id long, text string, gram string, rid int").repartition(3)
    out = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode())
           for r in S.substring_dedup(keyed(docs), hot=hot).collect()}
    assert [out[k] for k in range(len(rows))] == brute(rows, 20)


def test_other_window_and_seed(spark):
    rows = corpus(9)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode())
           for r in S.substring_dedup(keyed(docs), 7, 3).collect()}
    assert [out[k] for k in range(len(rows))] == brute(rows, 7)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (5, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_removed) for r in S.substring_dedup(keyed(docs)).collect()), key=str)
    assert out == [(4, 0), (4, 30), (5, 0), (None, 30)]


def test_empty_table(spark):
    assert S.substring_dedup(keyed(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
