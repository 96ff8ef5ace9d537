import hashlib
import math
import random
import re

from corpusgraph.llm import pii as P
from corpusgraph.llm.common import keyed

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(RULES):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def make_luhn(r, n):
    d = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts(seed, n=250):
    r = random.Random(seed)
    parts = [lambda: r.choice(["a@b.c_d@e.f", "x.y@z-q.org", "@", "a@@b.c", "q@w.e.r.", "+a%b@c.d", "é@x.y"]),
             lambda: ".".join(str(r.choice([0, 7, 255, 256, 1234, "007", "0000"])) for _ in range(r.randint(3, 9))),
             lambda: r.choice(["", "x", "-", " "]).join([make_luhn(r, r.randint(12, 21))]),
             lambda: re.sub(r"(\d{4})", r.choice([r"\1 ", r"\1-", r"\1--"]), make_luhn(r, r.randint(14, 19))),
             lambda: "+" + "".join(r.choice("0123456789 ().-") for _ in range(r.randint(1, 22))),
             lambda: "".join(r.choice("ab1.@+- 9(é𝄞\n") for _ in range(r.randint(0, 20)))]
    return ["".join(r.choice(parts)() + r.choice(["", " ", ".", "-", "ß "]) for _ in range(r.randint(0, 8))) for _ in range(n)]


def test_base_spans_equal_the_patterns(spark):
    rows = texts(1) + texts(2) + [None, "", "1" * 2000, "4 " * 1000, "a." * 1000 + "@b.c", "+1" + " " * 2000 + "2",
                                  "x@y.z " * 500]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(rows)], "doc_id long, text string, kind int").repartition(4)
    out = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind < 4]
           for r in P.find_spans(keyed(docs)).collect()}
    for k, t in enumerate(rows):
        assert out[k] == brute(t), (k, (t or "")[:200])


def test_very_long_runs_take_linear_time(spark):
    """Texts on which the patterns as written would take quadratic time."""
    rows = [(0, "1" * 200_000), (1, "4 " * 100_000), (2, "a." * 100_000 + "@b.c"), (3, "+1" + " " * 200_000 + "2")]
    docs = spark.createDataFrame(rows, "rid long, text string").repartition(4)
    assert [(r.rid, r.start, r.end) for r in P.base_spans(docs).collect()] == [(2, 0, 200_004)]


def test_telling_terms_and_clean_documents(spark):
    rows = [(k, f"Write to Zaphod here at zb{k % 2}@x.org about the ship, please.") for k in range(6)]
    rows += [(100 + k, "Nothing about the ship, write here please at noon.") for k in range(60)]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = P.find_spans(docs)
    got = {r.doc_id: r.spans for r in found.collect()}
    assert all(not got[100 + k] for k in range(60))
    text = dict(rows)
    for k in range(6):
        marked = {text[k][s.start:s.end]: P.KINDS[s.kind] for s in got[k]}
        assert marked[f"zb{k % 2}@x.org"] == "email"
        assert marked["Zaphod"] in ("generalise", "remove")
        assert "ship" not in marked and "please" not in marked
    clean = {r.doc_id: r.text for r in P.sanitised(docs, found).collect()}
    assert clean[100] == text[100]
    assert "zb" not in clean[0] and "Zaphod" not in clean[0] and "<EMAIL>" in clean[0] and clean[0].endswith("please.")


def test_telling_terms_equal_brute_force_over_whole_texts(spark):
    """Terms anywhere in a document count, and every occurrence of a telling one is flagged."""
    r = random.Random(5)
    common, rare = ["ship", "write", "noon", "Please", "Ärger"], ["Zaphod", "Trillian", "Marvin", "Ford", "arthur"]
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(k, f"{rare[k % 5]} {fill(40)} m{k % 5}@x.org {fill(40)} {rare[k % 5].upper()} {r.choice(rare)}.") for k in range(25)]
    rows += [(100 + k, f"{fill(20)} {r.choice(rare) if k % 9 == 0 else ''}") for k in range(150)]
    held, entities = {}, {}
    for k, t in rows:
        held[k] = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
        entities[k] = set(re.findall(r"m\d@x.org", t))
    df = lambda of, x: sum(x in v for v in of.values())
    want = {}
    for k, t in rows:
        share = {}
        for e in entities[k]:
            for w in held[k]:
                both = sum(w in held[j] and e in entities[j] for j in held)
                n, a, b = len(rows), df(held, w), df(entities, e)
                s = math.log2(both * n / (a * b)) / math.log2(n / b)
                if both >= P.SUPPORT and s >= P.GENERALISE:
                    share[w] = max(s, share.get(w, 0))
        mail = [m.span() for m in re.finditer(r"m\d@x.org", t)]
        want[k] = [(m.start(), 5 if share[m[0].lower()] >= P.REMOVE else 4, m.end())
                   for m in re.finditer(r"[^\W\d_]{3,}", t)
                   if m[0].lower() in share and not any(a < m.end() and m.start() < b for a, b in mail)]
    assert sum(map(len, want.values())) >= 50  # both ends of the texts, far from the address
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.spans if s.kind > 3] for x in P.find_spans(docs).collect()}
    assert got == want


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (1, None), (2, "1.2.3.4"), (2, "1.2.3.4")], "doc_id long, text string")
    out = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans]) for r in P.find_spans(keyed(docs)).collect()), key=str)
    assert out == [(1, []), (2, [(0, 1, 7)]), (2, [(0, 1, 7)]), (None, [(0, 0, 5)])]
    assert P.find_spans(keyed(docs.where("false"))).count() == 0


def test_query_digest(spark, tmp_path):
    t = "call +1 (499) 555-6503 or a@b.cd, 10.0.0.1"
    spark.createDataFrame([(5, t)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = P.op1_information_pii(spark, str(tmp_path)).collect()[0]
    want = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in brute(t))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = P.find_spans(keyed(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
