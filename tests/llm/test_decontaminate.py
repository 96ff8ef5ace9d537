import hashlib
import random
import re

import numpy as np
import pytest

from corpusgraph.llm import decontaminate as D

RE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return RE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, window=10):
    out = []
    for doc_id, t in docs:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            p = words(b)
            for i in range(max(1, len(p) - window + 1) if p else 0):
                x = p[i:i + window]
                for j in range(len(w) - len(x) + 1):
                    if w[j:j + len(x)] == x:
                        hit |= set(range(j, j + len(x)))
                        items.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def random_case(seed):
    r = random.Random(seed)
    vocab = ["a", "B", "é", "c9", "Zz", "d"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    bench = [(k, text(r.randint(0, 14))) for k in range(4)] + [(None, "d d d"), (9, None), (7, "!!")]
    docs = [(k, text(r.randint(0, 60))) for k in range(6)] + [(None, None), (8, ""), (8, bench[0][1])]
    docs += [(20 + k, " q ".join([text(3), bench[k][1], bench[k][1]])) for k in range(4)]
    return docs, bench


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [1, 1_000_000])
def test_hits_equal_brute_force(spark, seed, block):
    docs, bench = random_case(seed)
    d = spark.createDataFrame([(i, *x, "s") for i, x in enumerate(docs)], "rid long, doc_id long, text string, spans string")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, spans int").coalesce(1)
    got = sorted(((r.doc_id, r.n_words, sum(s[1] for s in r.spans), r["items"])
                  for r in D.contamination(d, b, phrase_words=block).collect()), key=str)
    assert got == brute(docs, bench)


@pytest.mark.parametrize("seed", range(20))
def test_index_search_and_locate(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 4, 300)
    if seed % 2:
        x = np.tile(x[:30], 10)
    index = D.FMIndex(x.astype(np.int64), 4)
    phrases = r.integers(1, 4, (40, 5)).astype(np.int32)
    lengths = r.integers(1, 6, 40)
    which, lo, hi = index.search(phrases, lengths)
    for k in range(40):
        p = phrases[k, :lengths[k]]
        want = [i for i in range(len(x) - len(p) + 1) if (x[i:i + len(p)] == p).all()]
        at = np.flatnonzero(which == k)
        got = sorted(index.locate(np.arange(lo[at[0]], hi[at[0]])).tolist()) if len(at) else []
        assert got == want


def test_span_bytes_cover_the_words():
    import pyarrow as pa
    data, off = D.text_buffers(pa.array(["Ein a b c, d!", None, "x a-b c d y a b c d"]))
    p = D.phrases_of([("1", "A b C d")])
    first, last, doc, hit, pairs = D.shard_hits(data, off, p)
    assert [bytes(data[first[i]:last[i]]).decode() for i in np.flatnonzero(hit)] == list("abcd" * 3)
    assert pairs.tolist() == [[0, 0], [2, 0]]


def test_stage_drops_contaminated_and_keeps_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "x one two three four y", "k"), (2, "one two", "k"), (None, None, None)],
                                 "doc_id long, text string, row string")
    out = D.decontaminate_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, None]


def test_query_keeps_repeated_rows_and_null_ids_over_several_blocks(spark, tmp_path, monkeypatch):
    bench = [(1, "one two three"), (2, "red green blue")]
    docs = [(None, "x one two three y"), (None, "a red green blue b"), (None, "p q r s t"), (5, "one two three red green blue"),
            (5, "one two three red green blue"), (5, "u v w x y z"), (6, None), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    blocks = D.phrase_blocks
    monkeypatch.setattr(D, "phrase_blocks", lambda b, window, limit: blocks(b, window, 1))
    assert len(list(D.phrase_blocks(D.benchmark_table(spark, str(tmp_path)), 10, 0))) == 2
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256)
                  for r in D.op8_fm_decontaminate(spark, str(tmp_path)).collect()), key=str)
    want = [(k, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest())
            for k, n, hit, items in brute(docs, bench)]
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "rid long, doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, b).count() == 0
    one = spark.createDataFrame([(0, 1, "a b")], "rid long, doc_id long, text string")
    assert D.contamination(one, b).collect()[0].spans == []
