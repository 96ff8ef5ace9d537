"""Repeats of a fixed window length over a corpus, found from winnowed anchors.

Used by suffix-array dedup (symbols are bytes) and substring dedup (words).

* *Anchors.*  Of the ``window - gram + 1`` grams of every window the one with the
  least hash (leftmost on ties) is an anchor.  Equal windows choose the same one,
  so two places that share a window share an anchor at the same offset in it.
* *Classes.*  An anchor's context is all that its windows can reach.  Anchors are
  laid out by range over (gram, context, row, place): members of one context stand
  together and settle each other, a gram without company goes, and a hot gram or
  context spreads over partitions.
* *Extension.*  One representative of each context whose gram occurs in another
  context too is compared with those others, in both directions, by the operator's
  own ``compare``.  Grams with more than ``hot`` contexts are settled by counting
  their windows' digests in Spark instead, which needs no group in one place.

Contexts and windows are told apart by 64-bit hashes next to a 64-bit gram hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BASE1, U64, Rolling, mix, slices, text_buffers

#: Text bytes whose symbols are hashed at once.
SLICE = 1 << 19
#: Representatives that one comparison takes at least; it ends with a gram.
BATCH = 20_000
#: Contexts of one gram beyond which its windows are counted in Spark.
HOT = 100_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


@dataclass
class Sequence:
    """Symbols of several texts in a row, with hashes of their ranges."""

    symbols: np.ndarray  # uint64
    off: np.ndarray
    window: int
    gram: int

    def __post_init__(self):
        self.rolling = Rolling(self.symbols, BASE1)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Place, text, left and right reach, gram hash and context hash of each anchor."""
        n, w, g = len(self.symbols), self.window, self.gram
        none = np.zeros(0, np.int64)
        if n < w:
            return none, none, none, none, none, none
        at = np.arange(n - g + 1)
        h = mix(self.rolling.of(at, at + g))
        least = sliding_min((h & U64(0xFFFFFFFF00000000)) | at.astype(U64), w - g + 1)
        start = np.arange(len(least))
        size = np.diff(self.off)
        whole = np.zeros(n + 1, np.int32)  # windows that lie in one text
        long = size >= w
        np.add.at(whole, self.off[:-1][long], 1)
        np.add.at(whole, self.off[1:][long] - w + 1, -1)
        ok = np.cumsum(whole)[start] > 0
        chosen = np.zeros(n, bool)
        chosen[(least[ok] & U64(0xFFFFFFFF)).astype(np.int64)] = True
        p = np.flatnonzero(chosen)
        text = np.searchsorted(self.off, p, "right") - 1
        left = np.minimum(p - self.off[text], w - g)
        right = np.minimum(self.off[text + 1] - p, w)
        context = mix(self.rolling.of(p - left, p + right) ^ (left * 4096 + right).astype(U64))
        return p, text, left, right, h[p].view(np.int64), context.view(np.int64)

    def window_hashes(self, p: np.ndarray, back: int) -> np.ndarray:
        """Hashes of the windows that start ``back`` before each place."""
        return mix(self.rolling.of(p - back, p - back + self.window)).view(np.int64)


#: Turns (bytes, offsets) of texts into symbols and their offsets.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def find_anchors(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            x, off = symbols(*text_buffers(b.column(1)))
            p, text, left, right, h, c = Sequence(x, off, window, gram).anchors()
            yield pa.record_batch([pa.array(h), pa.array(c), b.column(0).take(pa.array(text)),
                                   pa.array(p - off[text] if len(p) else p), pa.array(left * 4096 + right)],
                                  names=["gram", "context", "rid", "place", "reach"])

    return docs.select("rid", "text").mapInArrow(
        run, "gram bigint, context bigint, rid bigint, place bigint, reach bigint")


def settle(anchors: DataFrame, keep_first: bool) -> DataFrame:
    """``(kind, gram, rid, place, reach)``: kind 0, all windows of this anchor are
    repeats; 1, a representative to compare; 2, one that only serves as a partner.

    With ``keep_first`` the first member of a context (by row and place) is not a
    repeat of the others; else all members of a context of two or more are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None                      # first row of the context that is still open
        many, company, edge = False, False, True
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy() for c in b.columns], 1)
            k = 0 if head is None else 1
            x = x if head is None else np.concatenate((head, x))
            first = np.concatenate(([True], (x[1:, :2] != x[:-1, :2]).any(1)))
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, len(x)))
            several = size > 1
            several[0] |= many
            gram = x[starts, 0]
            near = np.zeros(len(starts), bool)
            near[1:] = gram[1:] == gram[:-1]
            near[:-1] |= near[1:]
            near[0] |= company | edge
            later = np.flatnonzero(~first)
            yield rows(x[later], 0)
            # All contexts but the last are complete.
            done, s = starts[:-1], several[:-1]
            if not keep_first:
                yield rows(x[done[s]], 0)
            yield rows(x[done[near[:-1] & ~(s & (not keep_first))]], 1)
            if not keep_first:
                yield rows(x[done[near[:-1] & s]], 2)
            head, many = x[starts[-1]:starts[-1] + 1], bool(several[-1])
            company = bool(near[-1]) if len(starts) > 1 else company
            edge = edge and len(starts) == 1
        if head is not None:  # the next partition may go on with this gram
            if not keep_first and many:
                yield rows(head, 0)
                yield rows(head, 2)
            else:
                yield rows(head, 1)

    def rows(x: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), *(pa.array(x[:, k]) for k in (0, 2, 3, 4))],
                               names=["kind", "gram", "rid", "place", "reach"])

    order = ["gram", "context", "rid", "place"]
    return (anchors.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(run, "kind int, gram bigint, rid bigint, place bigint, reach bigint"))


def packed(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, z)``: texts compressed for their way through a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            data, off = text_buffers(b.column(2))
            z = [c.compress(data[i:j].tobytes()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["rid", "doc_id", "z"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid bigint, doc_id bigint, z binary")


def unpacked(column) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(z) for z in column.to_pylist()]


def bytes_and_offsets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return np.frombuffer(b"".join(texts), np.uint8), off


#: payload(sequence, data, places, lefts, rights) -> one bytes value per anchor.
Payload = Callable[[Sequence, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[bytes]]
#: compare(places, lefts, rights, payloads) -> least and largest reach to the left
#: of a repeated window of each, -1 where there is none.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]


def _fetch(reps: DataFrame, texts: DataFrame, symbols: Symbols, window: int, gram: int, payload: Payload) -> DataFrame:
    """Each representative with its payload, and for hot grams with its windows."""
    per_doc = reps.groupBy("rid").agg(F.collect_list(F.struct("place", "reach", "gram", "kind", "hot")).alias("reps"))
    joined = texts.join(per_doc, "rid").select("rid", "z", "reps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                data, boff = bytes_and_offsets(unpacked(b.column(1)))
                x, off = symbols(data, boff)
                seq = Sequence(x, off, window, gram)
                lists = b.column(2)
                flat = lists.flatten()
                doc = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(lists).to_numpy())
                place, reach, gr, kind = (flat.field(k).to_numpy() for k in range(4))
                hot = flat.field(4).to_numpy(zero_copy_only=False)
                rid = b.column(0).to_numpy()[doc]
                p, left, right = off[doc] + place, reach // 4096, reach % 4096
                cold = np.flatnonzero(~hot)
                yield table(gr[cold], rid[cold], place[cold], reach[cold], kind[cold],
                            payload(seq, data, p[cold], left[cold], right[cold]), np.full(len(cold), -1))
                warm = np.flatnonzero(hot)
                for back in range(window - gram + 1) if len(warm) else ():
                    ok = warm[(left[warm] >= back) & (right[warm] >= window - back)]
                    yield table(seq.window_hashes(p[ok], back), rid[ok], place[ok], reach[ok], kind[ok],
                                [None] * len(ok), np.full(len(ok), back))

    def table(key, rid, place, reach, kind, payloads, back) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key), pa.array(rid), pa.array(place), pa.array(reach), pa.array(kind),
                                pa.array(payloads, pa.binary()), pa.array(back.astype(np.int32))],
                               names=["key", "rid", "place", "reach", "kind", "payload", "back"])

    return joined.mapInArrow(run, "key bigint, rid bigint, place bigint, reach bigint, kind int, "
                                  "payload binary, back int")


def _compare(rows: DataFrame, window: int, compare: Compare) -> DataFrame:
    """``(rid, first, last)`` symbol ranges found by comparing the contexts of each gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BATCH:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last gram may go on
                if cut:
                    yield from work(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rid, place, reach, kind = (t.column(k).to_numpy() for k in (1, 2, 3, 4))
        lo, hi = compare(place, reach // 4096, reach % 4096, t.column(5).to_pylist())
        k = np.flatnonzero((lo >= 0) & (kind == 1))
        yield pa.record_batch([pa.array(rid[k]), pa.array(place[k] - hi[k]), pa.array(place[k] - lo[k] + window)],
                              names=["rid", "first", "last"])

    return (rows.repartition("key").sortWithinPartitions("key", "rid", "place")
            .mapInArrow(run, "rid bigint, first bigint, last bigint"))


def _count_windows(rows: DataFrame, window: int, keep_first: bool) -> DataFrame:
    """The same for hot grams, by the digests of their windows."""
    order = F.struct("rid", "place")
    seen = rows.groupBy("key", "back").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least")).where("n > 1")
    found = rows.where("kind = 1").join(seen, ["key", "back"])
    if keep_first:
        found = found.where(order > F.col("least"))
    return found.select("rid", (F.col("place") - F.col("back")).alias("first"),
                        (F.col("place") - F.col("back") + window).alias("last"))


def repeated_ranges(docs: DataFrame, texts: DataFrame, symbols: Symbols, window: int, gram: int, payload: Payload,
                    compare: Compare, keep_first: bool, hot: int = HOT) -> DataFrame:
    """``(rid, first, last)``: ranges of symbols covered by repeated windows; they
    may overlap.  ``docs`` has ``rid, text``; ``texts`` is :func:`packed` of it."""
    found = materialize(settle(find_anchors(docs, symbols, window, gram), keep_first), "anchors")
    whole = found.where("kind = 0").select(
        "rid", (F.col("place") - F.floor(F.col("reach") / 4096)).alias("first"),
        (F.col("place") + F.col("reach") % 4096).alias("last"))
    reps = found.where("kind > 0")
    contexts = reps.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reps = reps.join(contexts, "gram").select("gram", "rid", "place", "reach", "kind", (F.col("n") > hot).alias("hot"))
    fetched = _fetch(reps, texts, symbols, window, gram, payload)
    fetched = materialize(fetched, "contexts")
    near = _compare(fetched.where("back < 0").drop("back"), window, compare)
    counted = _count_windows(fetched.where("back >= 0"), window, keep_first)
    return whole.unionByName(near).unionByName(counted)


def per_document(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(rid, doc_id, z, ranges)`` of every document."""
    grouped = ranges.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return texts.join(grouped, "rid", "left").select("rid", "doc_id", "z", "ranges")


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of the symbols inside any of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, first, 1)
    np.add.at(d, last, -1)
    return np.cumsum(d[:-1]) > 0
