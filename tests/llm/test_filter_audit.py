import re
from itertools import permutations

import duckdb
import pytest

from corpusgraph.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """The definition itself, document by document and order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, lang in docs:
        body = text or ""
        words = WORD.findall(body)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", body)) > 10 * len(body):
            bad.add("C")
        if re.search(r"[#$%&*|]", body):
            bad.add("D")
        if doc_id is not None and any((t or "") == body and i is not None and i < doc_id for i, t, _ in docs):
            bad.add("E")
        rows.append((lang or "", bad, doc_id in good, doc_id in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_at = {}
        for order in permutations("ABCDE"):
            alive = list(mine)
            for f in order:
                removed_at[order, f] = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
        for order in permutations("ABCDE"):
            left = len(mine)
            for step, f in enumerate(order, 1):
                gone = removed_at[order, f]
                left -= len(gone)
                out.append((part, "".join(order), step, left, len(gone),
                            sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                            sum(r[2] for r in gone), sum(r[3] for r in gone),
                            sum(len(removed_at[o, f]) for o in permutations("ABCDE"))))
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
           "toxic_lost", "shapley"]
LONG = " ".join(f"w{i}x" for i in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, LONG.upper(), "en"), (5, LONG + " 5%", "en"),
    (6, "same " * 130, "en"), (7, "same " * 130, None), (8, None, "en"), (9, "", "en"), (10, " \t\n", "en"),
    (11, "AB cd", "en"), (12, "ABCDEFGHIJ" + "é" * 90, "fr"), (13, "ABCDEFGHIJK" + "é" * 89, "fr"),
    (14, LONG + " ", "en"), (None, LONG, "en"), (None, "null id", "en"), (15, "null id", "en"),
    (16, "twice", "en"), (16, "twice", "en"), (17, "twice", ""), (0, "  ", "en"),
    (18, "w " * 200_000 + "|", "de"), (19, " ".join(f"{i}" for i in range(80)) + " 1" * 20, "de"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 0)]


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 7, "h", 1) for r in docs],
                              "doc_id long, text string, lang string, mask int, hash string, n int").repartition(3)
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    return A.audit(A.combinations(d, lab))


def test_equals_brute_force(spark):
    out = run(spark, DOCS, LABELS)
    assert out.columns == COLUMNS
    assert sorted(tuple(r) for r in out.collect()) == brute(DOCS, LABELS)


def test_registered_sql_equals_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", DOCS)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert sorted(con.execute(A.ORACLE).fetchall()) == brute(DOCS, LABELS)


@pytest.mark.parametrize("labels", [[], LABELS])
def test_empty_tables(spark, labels):
    assert run(spark, [], labels).count() == 0
    one = run(spark, [(1, None, None)], labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_hot_text(spark):
    """A third of all rows share one text: one row of it passes E."""
    docs = [(i, LONG if i % 3 == 0 else f"{LONG} {i}", "en") for i in range(600)]
    out = run(spark, docs, []).where("filter_order = 'EABCD' AND step = 1").first()
    assert (out.kept, out.removed, out.unique_fails, out.shapley) == (401, 199, 199, 199 * 120)
