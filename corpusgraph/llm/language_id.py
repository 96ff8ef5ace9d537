"""Language identification by a bidirectional gated recurrent network over bytes
(operator 9).

Training: a bounded sample of labelled documents (``DOCS_PER_LANGUAGE`` expected
per language, chosen by a hash of doc_id among rows whose crc32 remainder is not
``HELD_OUT``), a few segments of each, is fitted on the driver in numpy with
backpropagation through time; every letter position carries its document's label.

Prediction reads every byte of every text: texts are cut into segments, the two
GRUs run over them from zero state, every letter position gets probabilities,
and a document's probability is their mean over the document.  Only the text is
an input.  Nothing is shuffled, and segments of one long text go in blocks.

Defined results: a null text or one without a letter is ``und`` with score 0, as
is everything when no labelled row can be learned from; repeated rows get equal
rows; null ids count as held out = false and are not learned from; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_rows, slices, text_buffers
from .registry import register

UND = "und"
FOLDS, HELD_OUT = 3, 1
#: Bound of the training sample: documents per language (expected number) and
#: segments taken from each.
DOCS_PER_LANGUAGE, SEGMENTS_PER_DOC = 500, 6
SEGMENT, HIDDEN, EPOCHS, BATCH, RATE = 64, 8, 6, 384, 0.02
#: Segments that go through the network at once.
BLOCK = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTER = _ASCII_LETTER | (np.arange(256) >= 128)
#: Letters and number signs that are no digits; ``isalpha`` tells letters (category L).
_MAY_BE_LETTER = re.compile(r"[^\W\d_]")


def sigmoid(a: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


class GRU:
    """One direction: ``w`` [symbols, 3H] (reset, update, candidate), ``u`` [H, 2H], ``v`` [H, H]."""

    @staticmethod
    def init(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
        s = 1 / np.sqrt(hidden)
        return {"w": rng.normal(0, 0.3, (256, 3 * hidden)), "u": rng.normal(0, s, (hidden, 2 * hidden)),
                "v": rng.normal(0, s, (hidden, hidden))}

    @staticmethod
    def run(p: dict, x: np.ndarray, live: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
        """States [T, B, H] for symbols ``x`` [T, B]; the state is 0 where not ``live``."""
        steps, n = x.shape
        hidden = p["v"].shape[0]
        out = np.empty((steps, n, hidden), p["v"].dtype)
        h = np.zeros((n, hidden), p["v"].dtype)
        for t in (range(steps - 1, -1, -1) if back else range(steps)):
            g = p["w"][x[t]]
            a = h @ p["u"]
            a += g[:, :2 * hidden]
            sigmoid(a)
            r, z = a[:, :hidden], a[:, hidden:]
            c = (r * h) @ p["v"]
            c += g[:, 2 * hidden:]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((t, h, r, z, c))
            h = h + z * (c - h)
            h *= live[t]
            out[t] = h
        return out

    @staticmethod
    def gradients(p: dict, x: np.ndarray, live: np.ndarray, trace: list, d_out: np.ndarray) -> dict:
        """Backpropagation through time for the loss gradient ``d_out`` of the states."""
        hidden = p["v"].shape[0]
        grad = {"u": np.zeros_like(p["u"]), "v": np.zeros_like(p["v"])}
        d_in = np.empty((*x.shape, 3 * hidden), p["v"].dtype)
        dh = np.zeros(d_out.shape[1:], p["v"].dtype)
        for t, h, r, z, c in reversed(trace):
            dh = (dh + d_out[t]) * live[t]
            da_c = dh * z * (1 - c * c)
            d_rh = da_c @ p["v"].T
            grad["v"] += (r * h).T @ da_c
            gates = np.concatenate((d_rh * h * r * (1 - r), dh * (c - h) * z * (1 - z)), 1)
            grad["u"] += h.T @ gates
            d_in[t, :, :2 * hidden], d_in[t, :, 2 * hidden:] = gates, da_c
            dh = dh * (1 - z) + d_rh * r + gates @ p["u"].T
        flat, cols = x.ravel(), d_in.reshape(-1, 3 * hidden)
        grad["w"] = np.stack([np.bincount(flat, cols[:, j], 256) for j in range(3 * hidden)], 1).astype(p["w"].dtype)
        return grad


@dataclass
class Network:
    languages: list[str]
    forward: dict
    backward: dict
    out: np.ndarray   # [2H, K]
    bias: np.ndarray  # [K]

    @classmethod
    def init(cls, languages: list[str], hidden: int, seed: int, dtype=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(languages, GRU.init(rng, hidden), GRU.init(rng, hidden),
                  rng.normal(0, 0.3, (2 * hidden, len(languages))), np.zeros(len(languages)))
        net.forward = {k: v.astype(dtype) for k, v in net.forward.items()}
        net.backward = {k: v.astype(dtype) for k, v in net.backward.items()}
        net.out, net.bias = net.out.astype(dtype), net.bias.astype(dtype)
        return net

    def parameters(self) -> dict[str, np.ndarray]:
        return ({f"f.{k}": v for k, v in self.forward.items()} | {f"b.{k}": v for k, v in self.backward.items()}
                | {"out": self.out, "bias": self.bias})

    def probabilities(self, x: np.ndarray, live: np.ndarray, traces: tuple[list, list] | None = None):
        """Class probabilities [T, B, K] of every position, and the states."""
        f, b = traces or (None, None)
        states = np.concatenate((GRU.run(self.forward, x, live, False, f), GRU.run(self.backward, x, live, True, b)), 2)
        y = states @ self.out
        y += self.bias
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y, states

    def loss_and_gradients(self, x: np.ndarray, live: np.ndarray, weight: np.ndarray, label: np.ndarray):
        """Mean cross entropy over positions weighted by ``weight`` [T, B]; ``label`` [B]."""
        traces: tuple[list, list] = ([], [])
        y, states = self.probabilities(x, live, traces)
        total = max(1.0, float(weight.sum()))
        column = np.arange(x.shape[1])
        loss = -float((np.log(y[:, column, label] + 1e-12) * weight).sum()) / total
        y[:, column, label] -= 1
        y *= (weight / total)[:, :, None].astype(y.dtype)
        hidden = self.forward["v"].shape[0]
        flat = y.reshape(-1, y.shape[2])
        grad = {"out": states.reshape(-1, 2 * hidden).T @ flat, "bias": flat.sum(0)}
        d_states = y @ self.out.T
        for tag, p, trace, part in (("f", self.forward, traces[0], d_states[:, :, :hidden]),
                                    ("b", self.backward, traces[1], d_states[:, :, hidden:])):
            grad |= {f"{tag}.{k}": v for k, v in GRU.gradients(p, x, live, trace, part).items()}
        return loss, grad


def segment_matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Symbols [T, B] of byte ranges, and where they are live [T, B, 1]."""
    at = starts[None, :] + np.arange(length)[:, None]
    live = at < ends[None, :]
    x = _LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(live, x, 0).astype(np.uint8), live


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH,
          rate: float = RATE, length: int = SEGMENT, seed: int = 7) -> Network | None:
    """Fit on labelled segments with Adam; None without samples."""
    if not samples:
        return None
    languages = sorted({lang for _, lang in samples})
    samples = sorted(samples)
    data = np.frombuffer(b"".join(s for s, _ in samples), np.uint8)
    size = np.array([len(s) for s, _ in samples])
    ends = np.cumsum(size)
    label = np.array([languages.index(lang) for _, lang in samples])
    net = Network.init(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    share = np.bincount(label, minlength=len(languages))
    balance = (len(label) / (len(languages) * share))[label]
    m = {k: np.zeros_like(v) for k, v in net.parameters().items()}
    v = {k: np.zeros_like(p) for k, p in m.items()}
    total, step = epochs * -(-len(label) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            x, live = segment_matrix(data, ends[pick] - size[pick], ends[pick], length)
            weight = (_LETTER[x] & live) * balance[pick][None, :]
            _, grad = net.loss_and_gradients(x, live[:, :, None].astype(np.float32), weight, label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            clip, step = min(1.0, 1.0 / (norm + 1e-9)), step + 1
            now = rate * (1 - step / (total + 1))
            for k, p in net.parameters().items():
                g = (grad[k] * clip).astype(p.dtype)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(p.dtype)
    return net


def predict(net: Network, data: np.ndarray, off: np.ndarray, length: int = SEGMENT) -> np.ndarray:
    """Mean probabilities [texts, K] over each text's letter positions."""
    size = np.diff(off)
    count = -(-size // length)
    doc = np.repeat(np.arange(len(size)), count)
    starts = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
    ends = np.minimum(starts + length, off[1:][doc])
    total, letters = np.zeros((len(size), len(net.languages))), np.zeros(len(size))
    for i in range(0, len(doc), BLOCK):
        j = slice(i, i + BLOCK)
        x, live = segment_matrix(data, starts[j], ends[j], length)
        y, _ = net.probabilities(x, live[:, :, None].astype(np.float32))
        mask = _LETTER[x] & live
        pooled = np.einsum("tbk,tb->bk", y, mask.astype(np.float32))
        np.add.at(total, doc[j], pooled)
        np.add.at(letters, doc[j], mask.sum(0))
    return total / np.maximum(letters, 1)[:, None]


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    letter = np.zeros(len(off) - 1, bool)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        letter[full] = np.add.reduceat(_ASCII_LETTER[data], off[:-1][full], dtype=np.int64) > 0
        for k in full[~letter[full]].tolist():  # few: without an ASCII letter
            text = data[off[k]:off[k + 1]].tobytes().decode("utf-8", "replace")
            letter[k] = any(m[0].isalpha() for m in _MAY_BE_LETTER.finditer(text))
    return letter


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_segments(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE,
                      per_doc: int = SEGMENTS_PER_DOC, length: int = SEGMENT) -> list[tuple[bytes, str]]:
    """Segments of a hash sample of the labelled rows that may be learned from."""
    learn = docs.select("doc_id", "text", "lang").where(
        (remainder(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.coalesce(*[F.when(F.col("lang") == F.lit(k), F.lit(docs_per_language / n)) for k, n in counts.items()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = text_buffers(b.column(1))
            out = []
            for k, (doc_id, lang) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                n = int(off[k + 1] - off[k])
                blocks = -(-n // length)
                pick = np.random.default_rng(abs(doc_id)).permutation(blocks)[:per_doc]
                for s in sorted(pick.tolist()):
                    a = int(off[k]) + s * length
                    out.append((data[a:min(a + length, int(off[k + 1]))].tobytes(), lang))
            yield pa.record_batch([pa.array([s for s, _ in out], pa.binary()),
                                   pa.array([x for _, x in out], pa.string())], names=["segment", "lang"])

    rows = learn.where(draw < limit).mapInArrow(cut, "segment binary, lang string").collect()
    return [(bytes(r["segment"]), r["lang"]) for r in rows]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``rid, doc_id, lang_pred, score`` of every row of ``docs`` (``rid, doc_id, text``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = text_buffers(b.column(2))
            letter = has_letter(data, off)
            if net is None:
                best, score = [UND] * b.num_rows, np.zeros(b.num_rows)
            else:
                p = predict(net, data, off)
                k = p.argmax(1)
                best = [net.languages[i] if has else UND for i, has in zip(k.tolist(), letter.tolist())]
                score = np.where(letter, np.clip(p.max(1), 0.0, 1.0), 0.0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(score)],
                                  names=["rid", "doc_id", "lang_pred", "score"])

    return docs.select("rid", "doc_id", "text").mapInArrow(
        run, "rid bigint, doc_id bigint, lang_pred string, score double")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which no language can be told (``und``) go."""
    net = train(training_segments(docs))

    def decider():
        # A text with a letter gets one of the learned languages; `und` is left.
        return lambda data, off: (has_letter(data, off) & (predict(net, data, off).max(1) > 0)
                                  if net else np.zeros(len(off) - 1, bool))

    return keep_rows(docs, decider)


@register("op9_gru_language")
def op9_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every whole text of ``documents``."""
    docs = documents(spark, sf_dir)
    net = train(training_segments(docs))
    found = identify(docs.select(F.lit(0).cast("bigint").alias("rid"), "doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")
