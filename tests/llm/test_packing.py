import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusgraph.llm import packing as P


def unpack(plan):
    """Every (length, rank) -> (sequence, offset) of a plan."""
    at = {}
    for length, rank, n, per, seq, base in plan.records:
        for k in range(n):
            assert (length, rank + k) not in at
            at[length, rank + k] = (seq + k // per, base + k % per * length)
    return at


def check(counts, capacity):
    p = P.plan(counts, capacity)
    at = unpack(p)
    assert len(at) == sum(counts.values())
    bins = {}
    for (length, _), (s, o) in at.items():
        bins.setdefault(s, []).append((o, length))
    for items in bins.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert set(bins) == set(range(p.sequences))
    return p.sequences


def best_fit_decreasing(counts, capacity):
    bins = []
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_valid_and_as_tight_as_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    counts = {x: r.randint(1, 9) for x in r.sample(range(1, capacity + 1), r.randint(1, 10))}
    n = check(counts, capacity)
    assert n >= -(-sum(x * c for x, c in counts.items()) // capacity)
    assert n <= best_fit_decreasing(counts, capacity) + 1


def test_plan_size_does_not_depend_on_the_corpus():
    small = {x: 3 for x in range(1, 65)}
    assert len(P.plan({x: c * 10**9 for x, c in small.items()}, 64).records) < 64 * 64


def test_chunked_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(P.tokenizer_path())
    texts = ["Hello  world\n\nfoo's <|endoftext|> x", None, "", " ́a é 　x\ty\x1cz", "ΑΣ ΟΔΟΣ", "123 a1b2",
             "naïve café don't I'LL " * 30]
    got = [np.frombuffer(b, "<u4").tolist() for b in P.Encoder(P.tokenizer_path()).encode(texts)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_random_chunks_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_CACHE", 500)
    monkeypatch.setattr(P, "WORD_CACHE", 500)
    r = random.Random(1)
    t, e = Tokenizer.from_file(P.tokenizer_path()), P.Encoder(P.tokenizer_path())
    signs = "abcXYZéÉßÇñ.,'!*&%$#<|>019-_ \n\té\u0301\u00a0\u2028Ωжy̆"
    for _ in range(40):
        texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(10)]
        got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_missing_words_go_to_the_tokenizer_together(monkeypatch):
    r = random.Random(2)
    words = ["".join(r.choice("abcdeéßÇÿ") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", "***", "-b", "\t"])
             for _ in range(3000)] + [".", "</w>", "<|endoftext|>", "<|", "'s", "x's", "\u00d7a", "a\u0301,"]
    texts = [None, "", " \n ", *(" ".join(r.choices(words, k=r.randint(1, 400))) for _ in range(30))]
    t, e, calls = Tokenizer.from_file(P.tokenizer_path()), P.Encoder(P.tokenizer_path()), []
    tokens = e._tokens
    monkeypatch.setattr(e, "_tokens", lambda x: calls.append(len(x)) or tokens(x))
    monkeypatch.setattr(P, "PLACED", 7)
    some = pa.array([*texts, "left out"], pa.string()).slice(1, len(texts) - 1)
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(some)] == [
        t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    assert len(calls) < 20
    assert [*e.encode(texts)] == [b"", *e.encode(some)]


def test_whole_query_on_edge_rows(spark):
    rows = [(1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, "x " * 9000), (1, "a b c"), (5, "dog " * 2000)]
    docs = spark.createDataFrame([(a, b, "z", 7) for a, b in rows], "doc_id long, text string, part string, rank int")
    out = P.packing_stage(spark, docs, "").collect()
    t = Tokenizer.from_file(P.tokenizer_path())
    want = []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            x = ids[s:s + 4096]
            want.append((d, k, s, len(x), zlib.crc32(x.tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 4096


def test_empty_table(spark):
    assert P.packing_stage(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
