"""Best-fit packing with large-item matching (operator 10).

1. Tokenise every whole text once; cut only documents longer than a sequence.
   Each task numbers its pieces per length; the pieces are written down.
2. The histogram piece length -> count has at most ``capacity`` rows however
   large the corpus is.  :func:`plan` packs it: pieces above a third of the
   capacity go at most two to a sequence (largest first, each with the largest
   partner that fits), then smaller ones, largest first, go where they leave the
   least room.  Equal lengths move together as (sequence range, items per
   sequence), so the plan's size depends on the capacity, not on the corpus.
3. Each piece finds its place from its rank among the pieces of its length: the
   rank within its task plus the counts of earlier tasks.  No task holds all
   pieces of a length, so a length that a third of all documents share is split.

Defined results: a null or empty text is the single id ``end_id``; repeated rows
are packed each for themselves; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import os
import string
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, slices, worker_memory
from .registry import register

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Bounds of what a worker remembers of other chunks and of words, in bytes of memory.
CHUNK_CACHE, WORD_CACHE = 10 << 20, 40 << 20
#: Bytes of a dictionary's slot, kept partly empty, beside key and value.
SLOT = 72
#: Text bytes encoded together, so that a string is looked up once for all its places in them.
TEXT_BYTES = 4 << 20
#: Words of one text given to the tokenizer, such texts of one call, and parts placed at once.
JOINED, CALL, PLACED = 100, 100, 1 << 18

PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "part int, part_rank bigint")
_PIECE_FIELDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                           ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()),
                           ("part_rank", pa.int64())])


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class Remembered(dict):
    """Ids by string, made by ``find`` for all that are missing; starts anew past its bound."""

    def __init__(self, find: Callable[[list[str]], Iterator[bytes]], bound: int):
        super().__init__()
        self.find, self.bound, self.held = find, bound, 0

    def of(self, keys: list[str]) -> list[bytes]:
        found = [self.get(k) for k in keys]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self.find([keys[i] for i in missing])):
            found[i] = self[keys[i]] = ids
            self.held += sys.getsizeof(keys[i]) + sys.getsizeof(ids) + SLOT
        if self.held > self.bound:
            self.clear()
            self.held = 0
        return found


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The vocabulary drops white space and no token crosses it, so a text's ids
    are those of its chunks between white space.  It also splits letters from
    other signs and knows no capitals, so a chunk of Latin letters and signs
    behind them is its lower-cased word and its signs.  Arrow finds the distinct
    chunks, words and signs of some texts; their ids are remembered within
    bounds, and those that are missing go to the tokenizer together.  Any other
    chunk is encoded as it stands.
    """

    #: Letters (no combining marks, so normal forms are the same) and signs.
    LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    SIGNS = string.punctuation.replace("'", "")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.words = Remembered(self._words, WORD_CACHE)
        self.chunks = Remembered(self._each, CHUNK_CACHE)

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One per worker process: later tasks find what earlier ones remembered."""
        held = worker_memory("packing")
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _tokens(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), CALL):
            yield from (np.array(ids, "<u4").tobytes() for ids in self._tokens(texts[k:k + CALL]))

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Of words and signs that the vocabulary does not split: many in one text, cut
        behind each token that ends a word."""
        for k in range(0, len(words), JOINED * CALL):
            some = words[k:k + JOINED * CALL]
            joined = self._tokens([" ".join(some[j:j + JOINED]) for j in range(0, len(some), JOINED)])
            ids = np.fromiter(itertools.chain.from_iterable(joined), "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == sum(map(bool, some)):
                raw, ends = ids.tobytes(), iter(ends)
                at = 0
                for word in some:
                    start, at = at, next(ends) if word else at
                    yield raw[start:at]
            else:
                yield from self._each(some)

    def _parts(self, chunks: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Two parts of every chunk, as places in the list of ids returned: its word and
        its signs, or itself and nothing."""
        word = pc.utf8_rtrim(chunks, characters=self.SIGNS)
        plain = pc.match_substring_regex(word, f"^[{self.LETTERS}]*$")
        word, signs = word.filter(plain), pc.utf8_ltrim(chunks.filter(plain), characters=self.LETTERS)
        units = pa.concat_arrays([pc.utf8_lower(word), signs]).dictionary_encode()
        ids = self.words.of(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        parts, plain = np.full((len(chunks), 2), len(ids)), plain.to_numpy(zero_copy_only=False)
        parts[plain] = units.indices.to_numpy().reshape(2, -1).T
        ids.append(b"")
        parts[~plain, 0] = len(ids) + np.arange(len(chunks) - len(word))
        return parts, ids + self.chunks.of(chunks.filter(pa.array(~plain)).to_pylist())

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        chunks = split.flatten().dictionary_encode()
        parts, ids = self._parts(chunks.dictionary)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        codes = chunks.indices.to_numpy()
        for a, b in itertools.pairwise((split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()):
            found = []
            for k in range(a, b, PLACED):
                part = parts[codes[k:min(b, k + PLACED)]].ravel()
                n = sizes[part]
                end = np.cumsum(n)
                found.append(pool[np.repeat(starts[part] - end + n, n) + np.arange(end[-1])].tobytes())
            yield b"".join(found)


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                     path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and its
    number among the pieces of its length in its task (``part, part_rank``)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder, seen, end = Encoder.shared(path), np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, limit=TEXT_BYTES, owner="packing"):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids += end
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]),
                                part, int(seen[length])))
                    seen[length] += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _PIECE_FIELDS.types)],
                                  schema=_PIECE_FIELDS)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
                       ).mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Placement of every (length, rank): record i says that ``n`` pieces of
    ``length`` from rank ``rank`` on go ``per`` to a sequence, from sequence
    ``seq`` on, behind offset ``base``."""

    capacity: int
    sequences: int = 0
    records: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def put(self, length: int, rank: int, n: int, per: int, seq: int, base: int) -> None:
        self.records.append((length, rank, n, per, seq, base))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Large-item matching, then best fit, over a histogram of lengths."""
    out, rank = Plan(capacity), dict.fromkeys(counts, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []                        # its keys, ascending

    def leave(left: int, seq: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            room[left].append((seq, n))

    def place(length: int, n: int, per: int, seq: int, base: int) -> None:
        out.put(length, rank[length], n, per, seq, base)
        rank[length] += n

    left = dict(counts)
    large = sorted(x for x in counts if 3 * x > capacity and counts[x])
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b is None or (b == a and left[a] == 1):
            b = large[at - 1] if b == a and at >= 1 else None
        if b is None:
            n = left[a]
            place(a, n, 1, out.sequences, 0)
            leave(capacity - a, out.sequences, n)
        elif b == a:
            n = left[a] // 2
            place(a, 2 * n, 2, out.sequences, 0)
            leave(capacity - 2 * a, out.sequences, n)
            left[a] -= n
        else:
            n = min(left[a], left[b])
            place(a, n, 1, out.sequences, 0)
            place(b, n, 1, out.sequences, a)
            leave(capacity - a - b, out.sequences, n)
            left[b] -= n
        out.sequences += n
        left[a] -= n
        large = [x for x in large if left[x]] if b is not None else large[:-1]

    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                have = rooms[at]
                seq, n = room[have].pop()
                if not room[have]:
                    del room[have], rooms[at]
            else:
                have, seq, n = capacity, out.sequences, -(-todo // (capacity // length))
                out.sequences += n
            per = have // length
            full = min(n, todo // per)
            if full:
                place(length, full * per, per, seq, capacity - have)
                leave(have - per * length, seq, full)
                todo -= full * per
            if full < n:
                if todo:
                    place(length, todo, todo, seq + full, capacity - have)
                    leave(have - todo * length, seq + full, 1)
                    full, todo = full + 1, 0
                leave(have, seq + full, n - full)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces."""
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    records = sorted(plan(counts, capacity).records)
    length, rank, _, per, seq, base = (np.array(x, np.int64) for x in zip(*records)) if records else (
        np.zeros(0, np.int64),) * 6
    order = (length << 48) + rank

    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("part_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, r = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(order, (size << 48) + r, "right") - 1
            k = r - rank[i]
            yield pa.record_batch([*b.columns[:5], pa.array(seq[i] + k // per[i]),
                                   pa.array(base[i] + k % per[i] * size)],
                                  names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, "
                                    "ids_crc32 bigint, sequence_id bigint, offset bigint")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents."""
    return pack(materialize(tokenised_pieces(docs), "pieces"))


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of at most 4096 tokens."""
    return packing_stage(spark, documents(spark, sf_dir), sf_dir)
