import binascii

import numpy as np
import pytest
import zstandard

from corpusgraph.llm import quality as Q

SF = "/root/testdata/sf0.01"


def area(score, label):
    """Share of (bad, good) pairs that the score puts in order."""
    good, bad = score[label == 1], score[label == 0]
    return np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])


def test_held_out_labels(spark):
    """On labels that were not learned from; also the contract's columns and fold."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.op12_compression_quality(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (binascii.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    score, label = map(np.array, zip(*held))
    assert area(score, label) > 0.93
    assert ((score >= 0.7) == label).mean() > 0.9
    assert abs(score.mean() - label.mean()) < 0.08


def test_score_is_the_defined_difference(spark):
    """Brute force: both sizes of every block, and the curve."""
    model = Q.Model((b"bad words " * 40, b"good prose " * 40), 9.0, 0.5)
    texts = ["good prose here", "bad words there", "é" * 3000, "", None, "x" * 1024, "y" * 1025]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in Q.scored(docs, model, "doc_id").collect()}
    for i, t in enumerate(texts):
        raw, d = (t or "").encode(), 0
        for content, sign in zip(model.dictionaries, (1, -1)):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content),
                                         write_content_size=False, write_dict_id=False)
            d += sign * sum(len(c.compress(raw[s:s + 1024])) for s in range(0, len(raw), 1024))
        want = 1 / (1 + np.exp(-(9.0 * d / max(len(raw), 1) + 0.5)))
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_logistic_finds_the_curve():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.02, 20_000)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(80 * x + 1)))).astype(float)
    slope, intercept = Q.logistic(x, y, np.ones(len(x)))
    assert slope == pytest.approx(80, rel=0.08) and intercept == pytest.approx(1, abs=0.08)


def test_labels_and_other_columns_are_no_inputs(spark):
    """Equal texts score alike whatever their id, label or fold; null ids, repeated rows,
    very long texts and clashing columns do no harm."""
    prose = "Is and the ouen retition of a nterti, thorreou. "
    docs = [(i, prose * (1 + i % 5) if i % 2 else f"{i % 7} | {i % 3} |" * (3 + i % 4), "en", 1.0, 0) for i in range(400)]
    docs += [(None, "same", "x", 0.0, 1), (7, "same", None, 0.0, 1), (8, "same", None, 0.0, 1)] * 2
    docs += [(900, prose * 20_000, None, 0.0, 0), (901, None, None, None, None), (902, "", None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, label int").repartition(3)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(3, 0, 0), (5, None, 1), (None, 1, 1), (9, 7, 1)],
                                "doc_id long, quality int, toxic int")
    rows = Q.quality(d, lab).collect()
    assert len(rows) == len(docs)
    by_text = {}
    texts = {}
    for i, t, *_ in docs:
        texts.setdefault(i, set()).add(t)
    for r in rows:
        if len(texts[r.doc_id]) == 1:
            by_text.setdefault(next(iter(texts[r.doc_id])) or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    low, high = by_text[docs[0][1]].pop(), by_text[docs[1][1]].pop()
    assert low < 0.3 and high > 0.7
    assert not next(r for r in rows if r.doc_id is None).held_out


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 1), (2, 0)], 0.5)])
def test_few_labels(spark, labels, score):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.quality(d, lab).collect()] == pytest.approx([score] * 3, abs=1e-4)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
