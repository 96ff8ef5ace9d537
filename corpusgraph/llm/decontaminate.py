"""Benchmark decontamination with an FM-index per training shard (operator 8).

The test phrases are all windows of ten words of the benchmark items (a shorter
item is one window).  Each task takes its documents shard by shard and

1. maps every word to its number in the phrases' vocabulary (0: not in it) and
   folds stretches that cannot hold a phrase - words outside the vocabulary and
   runs shorter than the shortest phrase - to one separator, losing no match;
2. sorts the suffixes of that sequence, keeps its Burrows-Wheeler transform as a
   wavelet matrix and every eighth suffix position;
3. finds all phrases at once by backward search, locates their occurrences by
   walking to sampled positions, and merges the covered words to spans.

Shards are independent, so nothing is shuffled.  Phrases travel to the tasks in
blocks of bounded size, a pass each, and spans of several blocks are merged.  The
benchmark is read through the driver and all blocks are shipped for one job, so
their sum grows with the benchmark.

Defined results: a null text has no words; repeated rows each get a row; null
``doc_id`` stays null; an item with a null id reads as the empty string; an empty
benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep_rows, keyed, slices, text_buffers
from .registry import register
from .words import words_of

WINDOW = 10
#: Words of test phrases shipped to the tasks at once.
PHRASE_WORDS = 2_000_000
#: Text bytes per shard (a longer text is a shard of its own).
SHARD_BYTES = 1 << 20
#: Every so many suffix positions are kept.
SAMPLE = 8

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def phrase_words(data: np.ndarray, off: np.ndarray):
    """Words of letters, digits and signs beyond ASCII, lower-cased."""
    return words_of(data, off, _IS_WORD, lower=True)


@dataclass
class Phrases:
    """Distinct phrases as rows of word numbers (1-based, padded by 0), with the
    items that each comes from."""

    vocabulary: np.ndarray  # sorted word hashes
    rows: np.ndarray        # int32 [phrases, WINDOW]
    lengths: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    texts = pa.array([t or "" for _, t in items], pa.string())
    data, off = text_buffers(texts)
    _, _, h, doc = phrase_words(data, off)
    vocabulary = np.unique(h)
    ids = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
    at = np.searchsorted(doc, np.arange(len(items) + 1))
    found: dict[tuple, set[str]] = {}
    for k, (item, _) in enumerate(items):
        w = ids[at[k]:at[k + 1]].tolist()
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i:i + window]), set()).add(item)
    rows = np.zeros((len(found), window), np.int32)
    for k, p in enumerate(found):
        rows[k, :len(p)] = p
    return Phrases(vocabulary, rows, np.array([len(p) for p in found], np.int64),
                   [sorted(x) for x in found.values()])


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (``x`` ends with a unique smallest symbol)."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and locate over a sequence of non-negative symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        x = np.append(symbols + 1, 0)  # 0 ends the text
        order = suffix_order(x)
        bwt = x[order - 1]
        self.n, self.levels = len(x), max(1, int(sigma + 1).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=sigma + 2))))
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before row i of the transform."""
        start = np.zeros_like(i)
        for k, ones in enumerate(self.ones):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            a, b = ones[start], ones[i]
            start = np.where(bit, self.zeros[k] + a, start - a)
            i = np.where(bit, self.zeros[k] + b, i - b)
        return i - start

    def step(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one position earlier in the text."""
        symbol, i, start = np.zeros_like(row), row, np.zeros_like(row)
        for k, ones in enumerate(self.ones):
            a, b = ones[start], ones[i]
            bit = ones[i + 1] - b
            start = np.where(bit, self.zeros[k] + a, start - a)
            i = np.where(bit, self.zeros[k] + b, i - b)
            symbol = symbol * 2 + bit
        return self.first[symbol] + i - start

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their first and last + 1 row."""
        active = np.arange(len(rows))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n)
        for back in range(1, rows.shape[1] + 1):
            go = active[lengths[active] >= back]
            symbol = rows[go, lengths[go] - back].astype(np.int64) + 1
            lo[go] = self.first[symbol] + self.rank(symbol, lo[go])
            hi[go] = self.first[symbol] + self.rank(symbol, hi[go])
            active = active[lo[active] < hi[active]]
        return active, lo[active], hi[active]

    def locate(self, row: np.ndarray) -> np.ndarray:
        at, steps, todo = np.zeros_like(row), 0, np.arange(len(row))
        row = row.copy()
        while len(todo):
            done = self.sampled[row[todo]]
            hit = todo[done]
            at[hit] = self.samples[self.sample_rank[row[hit]]] + steps
            todo, steps = todo[~done], steps + 1
            row[todo] = self.step(row[todo])
        return at


def fold(word_ids: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence to index and the word number of each of its symbols: runs of
    vocabulary words of one document that are long enough, 0 between them."""
    n = len(word_ids)
    known = word_ids > 0
    starts = np.flatnonzero(known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1]))))
    ends = np.flatnonzero(known & np.concatenate((~known[1:] | (doc[1:] != doc[:-1]), [True]))) + 1
    keep = ends - starts >= shortest
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1  # the run and a separator
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    word = np.repeat(starts - begin, sizes) + np.arange(total)
    out = word_ids[np.minimum(word, n - 1)].astype(np.int64) if n else np.zeros(0, np.int64)
    out[begin + sizes - 1] = 0
    return out, word


def shard_hits(data: np.ndarray, off: np.ndarray, phrases: Phrases):
    """Per word: text number and whether a phrase covers it; word bounds; and
    the distinct (text number, phrase) pairs of one shard."""
    first, last, h, doc = phrase_words(data, off)
    n, v = len(h), phrases.vocabulary
    covered = np.zeros(n + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    if n and len(v):
        k = np.minimum(np.searchsorted(v, h), len(v) - 1)
        ids = np.where(v[k] == h, k + 1, 0)
        sequence, word = fold(ids, doc, int(phrases.lengths.min()))
        if len(sequence):
            index = FMIndex(sequence, len(v))
            which, lo, hi = index.search(phrases.rows, phrases.lengths)
            if len(which):
                many = hi - lo
                rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                phrase = np.repeat(which, many)
                at = word[index.locate(rows)]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + phrases.lengths[phrase], -1)
                pairs = np.unique(np.stack((doc[at], phrase), 1), axis=0)
    return first, last, doc, np.cumsum(covered[:-1]) > 0, pairs


_OUT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _pass(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """``rid, doc_id, n_words, spans`` (word number, words, byte start, byte end of
    each maximal covered run) and ``items`` against one block of phrases."""
    shipped = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        for b in slices(batches, limit=SHARD_BYTES):
            data, off = text_buffers(b.column(2))
            first, last, doc, hit, pairs = shard_hits(data, off, p)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            edge = np.diff(hit.astype(np.int8), prepend=0) != 0
            edge[at[:-1][at[:-1] < len(hit)]] |= hit[at[:-1][at[:-1] < len(hit)]]
            run_no = np.cumsum(edge & hit)
            starts = np.flatnonzero(edge & hit)
            ends = starts + np.bincount(run_no[hit], minlength=len(starts) + 1)[1:] if len(starts) else starts
            spans: list[list] = [[] for _ in range(b.num_rows)]
            for s, e in zip(starts.tolist(), ends.tolist()):
                d = int(doc[s])
                spans[d].append([s - int(at[d]), e - s, int(first[s] - off[d]), int(last[e - 1] - off[d])])
            items: list[set] = [set() for _ in range(b.num_rows)]
            for d, k in pairs.tolist():
                items[d].update(p.items[k])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(at)), pa.array(spans, _OUT.types[3]),
                                   pa.array([sorted(x) for x in items], _OUT.types[4])], schema=_OUT)

    return docs.select("rid", "doc_id", "text").mapInArrow(
        run, "rid bigint, doc_id bigint, n_words bigint, spans array<array<bigint>>, items array<string>")


def phrase_blocks(benchmark: DataFrame, window: int, limit: int,
                  id_col: str = "item_id", text_col: str = "text") -> Iterator[Phrases]:
    """The benchmark's phrases, read partition by partition, in blocks."""
    block, size = [], 0
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    for item, text in items.toLocalIterator():
        n = window * (1 + len(text or "") // 2)
        if block and size + n > limit * 8:
            yield phrases_of(block, window)
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield phrases_of(block, window)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for w, n, a, b in sorted(spans):
        if out and w <= out[-1][0] + out[-1][1]:
            end = max(out[-1][0] + out[-1][1], w + n)
            out[-1] = [out[-1][0], end - out[-1][0], out[-1][2], max(out[-1][3], b)]
        else:
            out.append([w, n, a, b])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """``rid, doc_id, n_words, spans, items`` of every row of ``docs`` (which has
    ``rid, doc_id, text``, ``rid`` unique); spans are [word, words, first byte, last byte + 1]."""
    passes = [_pass(docs, p) for p in phrase_blocks(benchmark, window, phrase_words)]
    if not passes:
        passes = [_pass(docs, phrases_of([], window))]
    if len(passes) == 1:
        return passes[0]
    union = F.udf(merged, "array<array<bigint>>")
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    return every.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        union(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, all others stay as they are."""
    for phrases in phrase_blocks(benchmark_table(spark, sf_dir), WINDOW, PHRASE_WORDS):
        shipped = spark.sparkContext.broadcast(phrases)

        def decider(shipped=shipped):
            def clean(data: np.ndarray, off: np.ndarray) -> np.ndarray:
                _, _, doc, hit, _ = shard_hits(data, off, shipped.value)
                return np.bincount(doc[hit], minlength=len(off) - 1) == 0
            return clean

        docs = keep_rows(docs, decider, limit=SHARD_BYTES)
    return docs


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@register("op8_fm_decontaminate", f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS p FROM (
    SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS n FROM phrase),
place AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS p FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM place JOIN phrase USING (p)),
words_hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (
    SELECT doc_id, i, unnest(generate_series(0, n - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op8_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside ten-word windows of ``benchmark`` items."""
    found = contamination(keyed(documents(spark, sf_dir)), benchmark_table(spark, sf_dir))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
