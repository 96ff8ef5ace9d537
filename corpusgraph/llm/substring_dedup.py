"""Substring dedup by seed and extend over words (operator 6).

Windows of 20 words that also start earlier (smaller row, or the same document and
an earlier start) are repeats.  Seeds are winnowed anchors of five words (see
``anchors``).  Documents meet on a seed; the hashes of the windows around it are
compared, and what goes is the union of the equal windows: the maximal repeat over
the length threshold.  Words are not compared one by one outwards from a seed.

Defined results: a null text has no words; texts shorter than a window lose
nothing; repeated rows are copies (the first by ``doc_id``, then by row number,
keeps its words); a null ``doc_id`` sorts last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from .common import documents, keyed
from .registry import register
from .words import words_of

WINDOW, SEED = 20, 5


def word_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, doc = words_of(data, off)
    return h, np.searchsorted(doc, np.arange(len(off)))


def repeated_words(docs: DataFrame, texts: DataFrame, window: int = WINDOW, seed: int = SEED,
                   hot: int = A.HOT) -> DataFrame:
    """``(rid, first, last)`` ranges of words covered by windows that start earlier too."""
    reaches = window - seed + 1

    def payload(seq: A.Sequence, data, p, left, right) -> list[bytes]:
        out = np.zeros((len(p), reaches), np.int64)
        for back in range(reaches):
            ok = (left >= back) & (right >= window - back)
            out[ok, back] = seq.window_hashes(p[ok], back)
        return [r.tobytes() for r in out]

    def compare(place, left, right, payloads):
        hashes = np.frombuffer(b"".join(payloads), np.int64).reshape(-1, reaches)
        lo, hi = np.full(len(place), -1), np.full(len(place), -1)
        for back in range(reaches):
            k = np.flatnonzero((left >= back) & (right >= window - back))
            later = np.ones(len(k), bool)
            later[np.unique(hashes[k, back], return_index=True)[1]] = False  # rows are in order: the first one stays
            k = k[later]
            lo[k] = np.where(lo[k] < 0, back, lo[k])
            hi[k] = back
        return lo, hi

    return A.repeated_ranges(docs, texts, word_symbols, window, seed, payload, compare, True, hot)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = A.HOT) -> DataFrame:
    """``rid, doc_id, n_words, n_removed, kept`` (the remaining words, one space
    between them) of every row of ``docs`` (``rid, doc_id, text``)."""
    texts = A.packed(docs)
    joined = A.per_document(texts, repeated_words(docs, texts, window, seed, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                n, removed, kept = [], [], []
                for text, ranges in zip(A.unpacked(b.column(2)), b.column(3)):
                    data = np.frombuffer(text, np.uint8)
                    first, last, _, _ = words_of(data, np.array([0, len(data)]))
                    out = np.zeros(len(first), bool)
                    if ranges.is_valid:
                        f, e = (ranges.values.field(k).to_numpy() for k in (0, 1))
                        out = A.covered(len(first), f, e)
                    n.append(len(first))
                    removed.append(int(out.sum()))
                    kept.append(b" ".join([text[i:j] for i, j in zip(first[~out].tolist(), last[~out].tolist())]))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                       pa.array(kept, pa.binary())], names=["rid", "doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "rid bigint, doc_id bigint, n_words bigint, n_removed bigint, kept binary")


@register("op6_seed_extend")
def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` outside windows of 20 words that start earlier too."""
    out = substring_dedup(keyed(documents(spark, sf_dir)))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
