import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from corpusgraph.llm import language_id as L
from corpusgraph.llm.common import text_buffers

WORDS = {"xx": ["kala", "vesi", "puu", "talo", "yksi"], "yy": ["brün", "größe", "schnee", "über", "straße"]}


def text(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    net = L.Network.init(["a", "b", "c"], 3, 1, np.float64)
    x = rng.integers(0, 256, (5, 4)).astype(np.uint8)
    live = np.ones((5, 4), bool)
    live[3:, 1] = False
    x[~live] = 0
    label, weight = np.array([0, 2, 1, 0]), live * 1.0
    args = (x, live[:, :, None].astype(np.float64), weight, label)
    _, grad = net.loss_and_gradients(*args)
    for name, p in net.parameters().items():
        flat = p.reshape(-1)
        used = int(x[0, 0]) * p.shape[1] if name.endswith(".w") else 0
        for k in range(used, used + min(4, p.size)):
            old = flat[k]
            flat[k] = old + 1e-6
            up, _ = net.loss_and_gradients(*args)
            flat[k] = old - 1e-6
            down, _ = net.loss_and_gradients(*args)
            flat[k] = old
            assert abs((up - down) / 2e-6 - grad[name].reshape(-1)[k]) < 1e-6, name


def test_prediction_does_not_depend_on_neighbours_or_blocks(monkeypatch):
    net = L.Network.init(["a", "b"], 4, 3)
    texts = ["", "abc def " * 40, "é", "zz" * 100, "1 2 3"]
    whole = L.predict(net, *text_buffers(pa.array(texts)))
    monkeypatch.setattr(L, "BLOCK", 2)
    for k, t in enumerate(texts):
        assert np.allclose(L.predict(net, *text_buffers(pa.array([t])))[0], whole[k], atol=1e-5)


def test_letters_are_of_category_l():
    texts = ["½ ² ①", "Ⅷ 12", "ª", "ελλ", "語", "", "1 _ !", "½x"]
    want = [any(unicodedata.category(c).startswith("L") for c in t) for t in texts]
    assert L.has_letter(*text_buffers(pa.array(texts))).tolist() == want == [False, False, True, True, True, False, False, True]


def rows():
    r = random.Random(5)
    out = [(k, text(("xx", "yy")[k % 2], r.randint(5, 40), r), ("xx", "yy")[k % 2]) for k in range(200)]
    return out + [(500, None, "xx"), (501, "", None), (502, "12 34 !!", "yy"), (None, text("xx", 9, r), "xx"),
                  (503, "ελλ", None), (1, out[1][1], "yy"), (504, text("yy", 30_000, r), None)]


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.createDataFrame([(*x, "s", 1.0) for x in rows()],
                                 "doc_id long, text string, lang string, lang_pred string, score double")
    net = L.train(L.training_segments(docs), epochs=12)
    out = L.identify(docs.selectExpr("0L AS rid", "doc_id", "text"), net).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows())
    truth = {a: c for a, b, c in rows() if c and a is not None and a < 500}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(held) > 40
    assert sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.95
    assert [got[k].lang_pred for k in (500, 501, 502, 504)] == ["und", "und", "und", "yy"]
    assert got[503].lang_pred in ("xx", "yy")
    assert all(0 <= r.score <= 1 for r in out)
    kept = L.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 3


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "xx") for k in range(60)], "doc_id long, text string, lang string")
    learned = {s.decode() for s, _ in L.training_segments(docs)}
    assert learned == {f"text {k}" for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net = L.train(L.training_segments(docs))
    r = L.identify(docs.selectExpr("0L AS rid", "doc_id", "text"), net).collect()[0]
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert L.identify(docs.where("false").selectExpr("0L AS rid", "doc_id", "text"), net).count() == 0
