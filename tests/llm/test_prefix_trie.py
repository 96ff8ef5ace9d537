import binascii
import hashlib
import random
import re

import pytest

from corpusgraph.llm import prefix_trie as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The definition itself: explicit prefixes, members and subtrees."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = binascii.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        built[c] = own.get(base, [])[:h] + t[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        words = len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 5, "x", None) for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, a string, w long")
    out = T.prefix_trie(df.repartition(parts))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def drawn(seed, convs, turns, vocabulary, first=0):
    rng = random.Random(seed)
    rows = []
    for c in range(first, first + convs):
        if rng.random() < 0.9:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(vocabulary)) for t in range(rng.randrange(turns))]
    rng.shuffle(rows)
    return rows


def test_small_vocabulary_equals_brute_force(spark):
    rows = drawn(1, 150, 9, ["a", "b b", ""])
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_odd_ids(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x y"), (1, 0, "user", "x y"), (1, 0, "user", "b"),
            (1, 0, None, "é"), (1, -3, "z", " \t"), (2, 0, "", ""), (2, 0, "user", "x y"), (-5, 1, "u", "t"),
            (-5, 2, "u", "t"), (-21, 1, "u", "t"), (None, 1, "u", "t"), (None, None, None, None), (0, 3, "u", "t t"),
            (0, 1, "v", "s"), (41, 1, "only", "one"), (10**15, 1, "u", "long " * 50_000), (10**15, 2, "u", "end")]
    assert run(spark, rows) == brute(rows)


def test_deep_copies_and_branches(spark):
    """Long conversations that share all, part late, or end inside one another."""
    line = [(t, "user", f"turn {t}") for t in range(300)]
    rows = [(c, *x) for c in (0, 7, 33) for x in line]
    rows += [(20, *x) for x in line[:250]] + [(40, *x) for x in line[:200] + [(999, "user", "other")]]
    rows += [(60 + k, *x) for k in range(6) for x in line[:20 * k]]
    assert run(spark, rows) == brute(rows)


def test_hot_conversation_and_hot_copies(spark):
    """A third of all rows in one conversation, many copies of one, one common first turn."""
    rows = [(5000, t, "user", f"t{t % 3}") for t in range(600)]
    rows += [(100 + c, t, "user", ["hello there", "same"][t]) for c in range(300) for t in range(2)]
    rows += [(1000 + c, t, "user", "hello there" if not t else f"{c}") for c in range(300) for t in range(2)]
    assert run(spark, rows, 8) == brute(rows)


def test_given_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    got = T.op11_prefix_trie(spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes) == {c: "bigint" if c != "ends_sha256" else "string" for c in COLUMNS}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "t")]])
def test_no_conversations(spark, rows):
    assert run(spark, rows) == []
