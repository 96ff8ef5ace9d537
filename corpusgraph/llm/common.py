"""Shared helpers of the operators: row keys, Arrow text buffers, hashing.

Row keys.  ``doc_id`` may be null or repeated, so operators that come back to a
row use ``rid``: a non-null unique long whose order is the order of ``doc_id``
(nulls last).  See :func:`keyed`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Text bytes handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, and bytes from which on it takes no further row.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def bounded_batches(spark) -> None:
    """Let at most ``BATCH_ROWS`` rows or about ``BATCH_BYTES`` at once go from Spark to a
    Python worker: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rows: bool = False) -> DataFrame:
    """``(rid, doc_id, text)`` of every row, and with ``rows`` the whole input
    row as struct ``row`` (so that its column names cannot clash).

    Ids that are unique and not null serve as ``rid`` themselves.  Otherwise
    the rows are range-partitioned by id and numbered once, in a table in the
    shared folder, so that every later scan sees the same numbers.
    """
    cols = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")]
    if rows:
        cols.append(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = docs.select(*cols)
    n, ids, distinct = out.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return out.select(F.col("doc_id").alias("rid"), *out.columns)
    ranged = out.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last())
    return materialize(ranged.select(F.monotonically_increasing_id().alias("rid"), *out.columns), "keyed")


#: Bits of the set that tells which rows may be among some keys (2 MB).
SIEVE_BITS = 1 << 24


def sieved(rows: DataFrame, ids: DataFrame, hit: bool = True) -> DataFrame:
    """``rows`` without most that are not among ``ids`` (both by ``rid``), or with ``hit``
    false only rows that are surely not: a hashed bit set, at most ``SIEVE_BITS / 64`` rows
    whatever the size of ``ids``, goes to every task.  A full one counts all rows as hits."""
    bit = F.pmod(F.xxhash64("rid"), F.lit(SIEVE_BITS))
    word, mask = F.shiftrightunsigned(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rid), {SIEVE_BITS}) & 63 AS int))")
    sieve = ids.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    joined = rows.join(F.broadcast(sieve), word == F.col("_word"), "inner" if hit else "left")
    found = F.col("_bits").bitwiseAND(mask) != 0
    return joined.where(found if hit else ~F.coalesce(found, F.lit(False))).select(*rows.columns)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` whose ``rid`` is not among ``dropped``.  Only those that share a bit of the
    sieve with a dropped one move to be looked up; the others stay where they are read."""
    # No anti-join: Spark would push it below the sieve, to all rows.
    gone = dropped.select("rid").distinct().withColumn("_gone", F.lit(True))
    asked = sieved(rows, dropped).join(gone, "rid", "left").where("_gone IS NULL").select(*rows.columns)
    return sieved(rows, dropped, hit=False).unionByName(asked)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its texts
    (null counts as empty); no copy unless there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def rest() -> None:
    """Give back what a task has freed.  Workers wait for a minute after a task, beside
    those that run, and their allocators keep freed memory until told not to."""
    Rolling.tables.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_remembered: dict[str, dict] = {}


def worker_memory(owner: str) -> dict:
    """What ``owner``'s tasks remember in this worker process.  Workers outlive tasks, so
    the memory of other owners goes when a task of this one begins."""
    for other in [k for k in _remembered if k != owner]:
        del _remembered[other]
    return _remembered.setdefault(owner, {})


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text",
           limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about ``limit`` text bytes."""
    worker_memory(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column) if isinstance(column, str) else column
        _, off = text_buffers(batch.column(at))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    rest()


def keep_rows(docs: DataFrame, decider: Callable[[], Callable], text_col: str = "text",
              limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text is kept.  Each task
    calls ``decider()`` once; what it returns maps (bytes, offsets) to a mask."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for b in slices(batches, at, limit):
            yield b.filter(pa.array(decide(*text_buffers(b.column(at)))))

    return docs.mapInArrow(run, docs.schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h *= _MIX1
    h ^= h >> U64(27)
    h *= _MIX2
    h ^= h >> U64(31)
    return h


class Rolling:
    """Polynomial hashes modulo 2**64 of ranges of a sequence of 64-bit symbols:
    prefix sums of ``x[i] * base**i`` and the inverse powers.  Equal ranges have
    equal hashes wherever they stand."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, x: np.ndarray, base: int):
        power, self.inverse = self._table(base, len(x) + 1)
        self.sums = np.zeros(len(x) + 1, U64)
        np.cumsum(x * power[:len(x)], out=self.sums[1:])

    @classmethod
    def _table(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.tables.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(10, n - 1).bit_length()
            power, inverse = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
            power[0] = inverse[0] = 1
            have = (np.cumprod(power), np.cumprod(inverse))
            if size <= 2 * SLICE_BYTES:  # those of longer texts are made for them alone
                cls.tables[base] = have
        return have[0][:n], have[1][:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


#: Odd bases of the two independent polynomial hashes.
BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


