"""Quality by compression (operator 12): zstandard dictionaries of good and bad text.

1. *Sample*: of the labelled rows that may be learned from, about ``ROWS`` a label
   are drawn by a hash of id and text, one half for the dictionaries, one for the
   calibration.  Counts and draw are Spark's; only the sample reaches the driver.
2. *Dictionaries*: one of the good and one of the bad half, trained by zstandard on
   pieces drawn from whole texts.
3. *Difference*: a text is cut into blocks of ``BLOCK`` bytes, so that the dictionary
   counts throughout a long text and not only at its start; every block is compressed
   with either dictionary, and the difference of the summed sizes is divided by the
   text's bytes.  A text that repeats itself needs few bytes either way and so comes
   out low.
4. *Calibration*: a logistic curve over that one number, fitted on the other half,
   each label weighted as often as it stands in the table.

Defined results: a null or empty text has difference 0 and the score of that; a null
id is not held out and has no label; rows that repeat an id are scored each for
itself, and repeated rows are drawn once; an id with both labels, or with none of 0
and 1, is not learned from; with no label, or one label only, to learn from, the score
is the share of label 1 (0.5 without any); very long texts are compressed whole, a
block at a time; an empty table gives no rows; further columns, whatever their names,
are not read.  Ties do not arise: a score depends on its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_buffers
from .registry import register

#: Labelled rows that the fit draws per label (half for dictionaries, half to calibrate).
ROWS = 2000
#: Bytes of a training piece, and pieces drawn of one text.
PIECE, PIECES = 2048, 8
#: Bytes of a dictionary, compression level, bytes of a scored block.
DICTIONARY, LEVEL, BLOCK = 32 << 10, 3, 1024
#: Rows whose id has this remainder of crc32 modulo FOLDS are not learned from.
FOLDS, HELD_OUT = 4, 2
#: A score from here on predicts label 1.
CUT = 0.7


@dataclass
class Model:
    """Dictionaries (bad, good; none without both labels) and the logistic curve."""

    dictionaries: tuple[bytes, bytes] | None
    slope: float
    intercept: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.intercept, -500, 500)))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the pieces themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-size:]


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    found = zstandard.ZstdCompressionDict(content)  # trained ones are told by their magic number
    found.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=found, write_content_size=False, write_dict_id=False)


def differences(data: np.ndarray, off: np.ndarray, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor,
                block: int = BLOCK) -> np.ndarray:
    """Per text: (bytes with the bad dictionary - bytes with the good one) / bytes."""
    out = np.zeros(len(off) - 1)
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        total = 0
        for s in range(a, b, block):
            part = data[s:min(s + block, b)].tobytes()
            total += len(bad.compress(part)) - len(good.compress(part))
        out[k] = total / max(b - a, 1)
    return out


def scored(docs: DataFrame, model: Model, *keep: str, score: bool = True) -> DataFrame:
    """``keep`` columns of every row and ``score`` (or the bare difference) of its ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [compressor(d) for d in model.dictionaries or ()]
        for b in slices(batches, "text"):
            data, off = text_buffers(b.column(b.schema.get_field_index("text")))
            x = differences(data, off, *pair) if pair else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(model.score(x) if score else x)],
                names=[*keep, "score"])

    rows = docs.select(*keep, "text")
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{types}, score double")


def pieces_of(docs: DataFrame) -> DataFrame:
    """``label, piece``: at most ``PIECES`` pieces, drawn from the whole of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, off = text_buffers(b.column(1))
            out = []
            for k, label in enumerate(b.column(0).to_pylist()):
                a, e = int(off[k]), int(off[k + 1])
                n = -(-(e - a) // PIECE)
                pick = np.random.default_rng(e - a).choice(n, min(n, PIECES), replace=False) if n else ()
                out += [(label, data[a + s * PIECE:min(a + (s + 1) * PIECE, e)].tobytes()) for s in sorted(pick)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()),
                                              pa.array([p for _, p in out], pa.binary())], names=["label", "piece"])

    return docs.select("label", "text").mapInArrow(run, "label int, piece binary")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve (Newton steps, lightly damped)."""
    scale = float(x.std()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    theta, ridge = np.zeros(2), np.diag([1e-3, 1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - ridge @ theta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(2), grad)
        theta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learn from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``)."""
    known = (labels.where(remainder(F.col("doc_id").cast("bigint")) != HELD_OUT)
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
             .where("label = other AND label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    counts = {r["label"]: r["n"] for r in ids.join(known, "doc_id").groupBy("label")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(None, 0.0, float(np.log(share / (1 - share))))
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.pmod(F.xxhash64("doc_id", text, F.lit(12)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), draw.alias("draw"))
             .where(F.col("draw") < rows / min(n0, n1)).join(known, "doc_id")
             .where(F.col("draw") < F.when(F.col("label") == 0, rows / n0).otherwise(rows / n1))
             .groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text")))
    half = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2))
    pieces = pieces_of(drawn.where(half == 0)).collect()
    by_label = [[bytes(r["piece"]) for r in pieces if r["label"] == k] for k in (0, 1)]
    if not all(by_label):
        return Model(None, 0.0, float(np.log(n1 / n0)))
    model = Model((dictionary(by_label[0]), dictionary(by_label[1])), 0.0, float(np.log(n1 / n0)))
    seen = scored(drawn.where(half == 1), model, "label", score=False).collect()
    y = np.array([r["label"] for r in seen], float)
    if not 0 < y.sum() < len(y):
        return model
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    model.slope, model.intercept = logistic(np.array([r["score"] for r in seen]), y, weight * len(y) / (n0 + n1))
    return model


def quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    model = fit(docs, labels, rows)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return scored(ids, model, "doc_id").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


@register("op12_compression_quality")
def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of ``documents``."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality(documents(spark, sf_dir), labels)
