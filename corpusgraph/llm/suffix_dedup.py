"""Suffix-array dedup of bytes (operator 5).

A byte goes if some 400-byte string over it starts anywhere else too.  Winnowed
anchors of 48 bytes bring together the places that can share such a string (see
``anchors``); what follows an anchor is a suffix, what precedes it, read backwards,
is another.  Per task the suffixes of many anchors are sorted by suffix arrays:

* each suffix is cut into pieces of 16 bytes, named once by their order;
* :func:`suffix_array` sorts the string of names by *linear grouping*: suffixes are
  grouped by their Lyndon prefixes, groups are processed in descending order along
  previous-smaller pointers, and then each group's order is emitted in one scan, with
  no recursive renaming;
* in the two orders, neighbours' common prefixes say which anchors agree on l bytes
  before and 400 - l bytes after them, for every l.

Defined results: a null text is empty; texts shorter than 400 bytes lose nothing;
repeated rows are copies of each other; null ids stay null; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from .common import U64, documents, keyed, mix
from .registry import register

WINDOW, GRAM = 400, 48
PIECE = 16

_CODE = mix(np.arange(1, 257, dtype=U64))


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of non-negative integers that end with a unique smallest one,
    by linear grouping.

    A group is a run of ``order``, named by its start; ``group[i]`` names the group
    of suffix i and ``size`` has the length of each group.  From the last group to
    the first, each suffix of the group finds the nearest one before it that is in a
    lower group; those found are moved behind their old groups, the more often found
    the higher, which extends their Lyndon prefixes by the group's.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, size, start = [0] * n, [0] * n, 0
    for k in range(n):
        if k and text[order[k]] != text[order[k - 1]]:
            start = k
        group[order[k]] = start
        size[start] += 1
    where = [0] * n
    for k, i in enumerate(order):
        where[i] = k
    before = [-1] * n   # previous smaller suffix of a processed suffix
    skip = [-1] * n     # shortcut along `before`

    end = n
    while end > 1:
        own = group[order[end - 1]]
        members = order[own:end]
        if len(members) == 1:
            times = None
        else:
            members.sort()
            times = {}
        for i in members:
            p, passed = i - 1, []
            while p >= 0 and group[p] >= own:
                passed.append(p)
                p = skip[p]
            for q in passed:
                skip[q] = p
            before[i] = skip[i] = p
            if times is not None and p >= 0:
                times[p] = times.get(p, 0) + 1
        if times is None:
            found = [[before[members[0]]]] if before[members[0]] >= 0 else []
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in times.items():
                by_count.setdefault(c, []).append(p)
            found = [by_count[c] for c in sorted(by_count, reverse=True)]
        for ps in found:
            # Move each to the end of its group, then cut the moved ones off.
            moved: dict[int, int] = {}
            for p in ps:
                g = group[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                k, last = where[p], g + size[g] - m
                other = order[last]
                order[k], order[last] = other, p
                where[other], where[p] = k, last
            for g, m in moved.items():
                if m < size[g]:
                    new = g + size[g] - m
                    size[g] -= m
                    size[new] = m
                    for k in range(new, new + m):
                        group[order[k]] = new
        end = own

    # Emission: the suffix before the one just placed, and those before it along
    # the pointers, are the next of their groups.
    out, placed, free = [-1] * n, [False] * n, list(range(n))
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


def sorted_rows(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (rows of a zero-padded matrix) and the common prefix
    of each with the one before it in that order."""
    n, width = rows.shape
    cut = -(-width // PIECE)
    padded = np.zeros((n, cut * PIECE), np.uint8)
    padded[:, :width] = rows
    halves = padded.reshape(n * cut, 2, PIECE // 2).copy().view(">u8").reshape(n * cut, 2).astype(U64)
    filled = np.clip(lengths[:, None] - np.arange(cut) * PIECE, 0, PIECE).reshape(-1)
    by = np.lexsort((filled, halves[:, 1], halves[:, 0]))
    new = np.ones(len(by), bool)
    new[1:] = (halves[by[1:]] != halves[by[:-1]]).any(1) | (filled[by[1:]] != filled[by[:-1]])
    names = np.empty(len(by), np.int64)
    names[by] = np.cumsum(new) + 1
    used = -(-lengths // PIECE)
    keep = np.arange(cut)[None, :] <= used[:, None] - 1
    # Each string's names and a separator (1) behind them; 0 ends the whole.
    text = np.concatenate((np.where(keep, names.reshape(n, cut), 0), np.ones((n, 1), np.int64)), 1)
    flat = text[np.concatenate((keep, np.ones((n, 1), bool)), 1)]
    starts = np.cumsum(used + 1) - (used + 1)
    row = np.full(len(flat) + 1, -1)
    row[starts] = np.arange(n)
    order = row[np.array(suffix_array([*flat.tolist(), 0]), np.int64)]
    order = order[order >= 0]
    a, b = order[1:], order[:-1]
    differ = rows[a] != rows[b]
    first = np.where(differ.any(1), differ.argmax(1), width)
    common = np.zeros(n, np.int64)
    common[1:] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    return order, common


def byte_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _CODE[data], off


def contexts(seq: A.Sequence, data: np.ndarray, p, left, right) -> list[bytes]:
    return [data[i - a:i + b].tobytes() for i, a, b in zip(p.tolist(), left.tolist(), right.tolist())]


def comparer(window: int, gram: int):
    reach = window - gram

    def compare(place, left, right, payloads) -> tuple[np.ndarray, np.ndarray]:
        n = len(place)
        lo, hi = np.full(n, -1), np.full(n, -1)
        after, back = np.zeros((n, window), np.uint8), np.zeros((n, reach), np.uint8)
        for k, (a, b, s) in enumerate(zip(left.tolist(), right.tolist(), payloads)):
            x = np.frombuffer(s, np.uint8)
            after[k, :b] = x[a:]
            back[k, :a] = x[:a][::-1]
        order, common = sorted_rows(after, right)
        order_back, common_back = sorted_rows(back, left)
        place_back = np.empty(n, np.int64)
        place_back[order_back] = np.arange(n)
        left_of, right_of = left[order], right[order]
        for a in range(reach + 1):
            more = window - a
            joined = common >= more
            near = joined.copy()
            near[:-1] |= joined[1:]
            k = np.flatnonzero(near & (left_of >= a) & (right_of >= more))
            if len(k) < 2:
                continue
            ahead = np.cumsum(~joined)[k]                        # agree on the bytes after
            behind = np.cumsum(common_back < a)[place_back[order[k]]]  # and on those before
            key = ahead * (n + 1) + behind
            s = np.argsort(key, kind="stable")
            same = key[s][1:] == key[s][:-1]
            alike = np.zeros(len(k), bool)
            alike[s[1:][same]] = alike[s[:-1][same]] = True
            i = order[k[alike]]
            lo[i] = np.where(lo[i] < 0, a, lo[i])
            hi[i] = a
        return lo, hi

    return compare


def repeated_bytes(docs: DataFrame, texts: DataFrame, window: int = WINDOW, gram: int = GRAM,
                   hot: int = A.HOT) -> DataFrame:
    """``(rid, first, last)`` ranges of bytes covered by strings that start elsewhere too."""
    return A.repeated_ranges(docs, texts, byte_symbols, window, gram, contexts, comparer(window, gram), False, hot)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = A.HOT) -> DataFrame:
    """``rid, doc_id, n_bytes, spans`` (removed runs of bytes) ``, kept`` (the rest)
    of every row of ``docs`` (``rid, doc_id, text``)."""
    texts = A.packed(docs)
    joined = A.per_document(texts, repeated_bytes(docs, texts, window, gram, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                n, spans, kept = [], [], []
                for text, ranges in zip(A.unpacked(b.column(2)), b.column(3)):
                    out, found = text, []
                    if ranges.is_valid:
                        gone = A.covered(len(text), *(ranges.values.field(k).to_numpy() for k in (0, 1)))
                        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                        found = edge.reshape(-1, 2).tolist()
                        out = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    n.append(len(text))
                    spans.append(found)
                    kept.append(out)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()),
                                       pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                                      names=["rid", "doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "rid bigint, doc_id bigint, n_bytes bigint, spans array<array<bigint>>, kept binary")


@register("op5_suffix_array")
def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` outside 400-byte strings that occur more than once."""
    out = suffix_dedup(keyed(documents(spark, sf_dir)))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
