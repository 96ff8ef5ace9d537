import random

import numpy as np
import pytest

from corpusgraph.llm import suffix_dedup as S
from corpusgraph.llm.common import keyed


def brute(rows, window):
    data = [(t or "").encode() for t in rows]
    count = {}
    for t in data:
        for i in range(len(t) - window + 1):
            count[t[i:i + window]] = count.get(t[i:i + window], 0) + 1
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def corpus(seed, n=50, unit=30):
    r = random.Random(seed)
    letters = "ab é\n\x00" if seed % 2 else "abcdefgh"
    chunk = lambda k: "".join(r.choice(letters) for _ in range(k))
    passages = [chunk(r.randint(unit // 2, unit * 4)) for _ in range(6)]
    rows = []
    for _ in range(n):
        rows.append("".join(r.choice(passages) if r.random() < 0.5 else chunk(r.randint(1, unit))
                            for _ in range(r.randint(0, 6))))
    return rows + [None, "", "a" * unit * 6, "ab" * unit * 2, "x", rows[3], rows[3]]


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_equals_sorting(seed):
    r = random.Random(seed)
    n, sigma = r.randint(0, 80), r.choice([1, 2, 3, 10])
    text = [r.randint(1, sigma) for _ in range(n)]
    if seed % 3 == 0:
        text = text[:5] * 12
    assert S.suffix_array([*text, 0]) == naive([*text, 0])


def test_suffix_array_is_about_linear():
    import time
    took = []
    for n in (20_000, 80_000):
        text = [1, 2, 3, 1, 2] * (n // 5) + [0]
        t = time.process_time()
        S.suffix_array(text)
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 1


def test_sorted_rows():
    r = np.random.default_rng(2)
    lengths = r.integers(0, 41, 300)
    rows = r.integers(0, 2, (300, 40)).astype(np.uint8)
    rows[:150] = rows[0]
    rows[np.arange(40)[None, :] >= lengths[:, None]] = 0
    order, common = S.sorted_rows(rows, lengths)
    strings = [bytes(rows[k, :lengths[k]]) for k in order]
    assert strings == sorted(strings)
    for a, b, c in zip(strings, strings[1:], common[1:]):
        assert a[:c] == b[:c] and (c == min(len(a), len(b)) or a[c] != b[c])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [100_000, 1])
def test_equal_to_brute_force_with_a_small_window(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)],
                                 "doc_id long, text string, reach string").repartition(3)
    out = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept))
           for r in S.suffix_dedup(keyed(docs), 40, 9, hot).collect()}
    assert [out[k] for k in range(len(rows))] == brute(rows, 40)


def test_equal_to_brute_force_with_the_real_window(spark):
    rows = corpus(4, 30, 300)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in S.suffix_dedup(keyed(docs)).collect()}
    assert [out[k] for k in range(len(rows))] == brute(rows, 400)


def test_null_and_repeated_ids_and_empty_table(spark):
    t = "".join(chr(97 + k * k % 23) for k in range(500))
    docs = spark.createDataFrame([(None, t), (4, t), (4, None), (5, "x")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in S.suffix_dedup(keyed(docs)).collect()), key=str)
    assert out == [(4, 0, b""), (4, 500, b""), (5, 1, b"x"), (None, 500, b"")]
    assert S.suffix_dedup(keyed(docs.where("false"))).count() == 0
