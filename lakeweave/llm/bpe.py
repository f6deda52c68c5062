"""Byte-level BPE by merge replay.

The distinct words of a block of the corpus are laid end to end as symbols. An inverted index maps each rank to
the positions at which an adjacent pair merges into the token of that rank; a heap holds the ranks that have
positions. The lowest rank is replayed at all its positions at once, in every word, and each merge touches only the
two neighbouring pairs, which are posted anew. So a word is encoded once however often it occurs, and the work of a
merge is its number of occurrences in distinct words.

A word's encoding depends on the word alone, so the blocks need nothing from each other: no shuffle, and a lost
executor costs only its running tasks. What a Python worker has encoded stays in a table of bounded size.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lakeweave.llm.common import col, release, small_batches, without

#: Characters of text that make up a block, and encoded words that a worker remembers.
BLOCK_CHARS, MEMO_WORDS = 3_000_000, 500_000
#: The same where workers are to stay small.
SMALL_BLOCK_CHARS, SMALL_MEMO_WORDS = 1_000_000, 120_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from a rank file: a line holds a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Replay:
    """Encodes and decodes words by one table of ranks; remembers pairs, and up to MEMO_WORDS words."""

    def __init__(self, ranks: dict[bytes, int], memo_words: int = MEMO_WORDS):
        self.ranks, self.memo_words = ranks, memo_words
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.shift = max(self.token).bit_length()
        self.pair: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pair_rank(self, a: int, b: int) -> int:
        """The rank of the token that two adjacent symbols make, or -1."""
        key = a << self.shift | b
        rank = self.pair.get(key)
        if rank is None:
            rank = self.pair[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: every merge is replayed in rank order over all words together."""
        symbol: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbol))
            symbol.extend(map(self.byte.__getitem__, word))
            symbol.append(-1)  # a wall between words
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        index: dict[int, list[int]] = {}
        if len(self.pair) > 200_000:
            self.pair.clear()
        rank_of, shift, pairs = self.pair_rank, self.shift, self.pair
        flat = np.array(symbol, np.int64)
        inside = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        kinds, kind = np.unique(flat[inside] << shift | flat[inside + 1], return_inverse=True)
        low = (1 << shift) - 1
        ranks = np.array([rank_of(k >> shift, k & low) for k in kinds.tolist()], np.int64)[kind] if len(kinds) else kind
        inside, ranks = inside[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        found, first = np.unique(ranks[order], return_index=True)
        for rank, places in zip(found.tolist(), np.split(inside[order], first[1:])):
            index[rank] = places.tolist()
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()  # left to right in each word
            for done, at in enumerate(places):
                a = symbol[at]
                if a < 0:
                    continue
                right = after[at]
                b = symbol[right]
                if b < 0 or pairs.get(a << shift | b) != rank:
                    continue  # a neighbour's merge took one of the two
                symbol[at] = rank
                symbol[right] = -2
                over = after[at] = after[right]
                before[over], left = at, before[at]
                lower = False
                x, y = symbol[left], symbol[over]  # before the first symbol: the last wall
                if x >= 0:
                    new = pairs.get(x << shift | rank)
                    if new is None:
                        new = rank_of(x, rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(heap, new)
                        lower = new <= rank
                if y >= 0:
                    new = pairs.get(rank << shift | y)
                    if new is None:
                        new = rank_of(rank, y)
                    if new >= 0:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(heap, new)
                        lower = lower or new <= rank
                if lower:  # an earlier merge became possible; it goes first
                    if rest := places[done + 1 :]:
                        if rank in index:
                            index[rank] += rest
                        else:
                            index[rank] = rest
                            heappush(heap, rank)
                    break
        return [[s for s in symbol[start:end - 1] if s >= 0] for start, end in zip(starts, [*starts[1:], len(symbol)])]

    def block(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its words, as little-endian unsigned 32-bit integers."""
        if len(self.memo) > self.memo_words // 2:  # words not met for a while are forgotten, frequent ones stay
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        collecting = gc.isenabled()
        gc.disable()  # millions of small lists of numbers, none of them in a cycle
        for word in {word for words in texts for word in words if word not in memo}:
            if word in older:
                memo[word] = older[word]
            else:
                new.append(word)
        for word, ids in zip(new, self.words([w.encode("utf-8", "surrogatepass") for w in new])):
            memo[word] = b"".join(i.to_bytes(4, "little") for i in ids)
        if collecting:
            gc.enable()
        return [b"".join([memo[word] for word in words]) for words in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))


_WORKER: dict[str, Replay] = {}


def _replay(data: bytes) -> Replay:
    """One for each Python worker, kept from task to task."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Replay(read_ranks(data))
    return _WORKER[name]


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", keep_ids: bool = True, keep_memo: bool = True) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Returns the given columns, and n_tokens (long), ids (array<int>, if keep_ids), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes). A null or empty text has no
    tokens. Rows keep to themselves: repeated rows are encoded alike, an empty table gives an empty table. Given
    columns of the same names as new ones are replaced.

    keep_memo: workers keep what they have encoded from task to task; else blocks and memo are small and a task leaves
    no memory behind.
    ranks_file is read on the driver (its size is fixed, under 1 MB for 50,000 tokens) and broadcast.
    """
    small_batches(docs.sparkSession)
    with open(ranks_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    new = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if not keep_ids:
        del new["ids"]
    kinds = {"n_tokens": LongType(), "ids": ArrayType(IntegerType()), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    docs = without(docs, *new)
    given, at = docs.columns, docs.columns.index(text)
    # by number, as names may hold dots, or what the new ones are called in between
    docs = docs.toDF(*(f"given{k}" for k in range(len(given))))
    schema = StructType([*docs.schema.fields, *(StructField(c, kinds[c]) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, find = _replay(data.value), regex.compile(pattern).findall
        most = BLOCK_CHARS if keep_memo else SMALL_BLOCK_CHARS
        replay.memo_words = MEMO_WORDS if keep_memo else SMALL_MEMO_WORDS
        for batch in batches:
            texts = batch.column(at)
            start = 0
            while start < batch.num_rows:
                chars, block = 0, []
                while start + len(block) < batch.num_rows and (not block or chars < most):
                    one = texts[start + len(block)].as_py() or ""
                    chars += len(one)
                    block.append(find(one))
                ids = replay.block(block)
                made = {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(replay.decode(x)).hexdigest() for x in ids], pa.string()),
                }
                if keep_ids:
                    offsets = [0]
                    for x in ids:
                        offsets.append(offsets[-1] + len(x) // 4)
                    flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                    made["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                rows = batch.slice(start, len(block))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(made[c] for c in new)], names=[*rows.schema.names, *new])
                start += len(block)
        if not keep_memo:
            _WORKER.clear()
            del replay
        release()

    return docs.mapInArrow(run, schema).toDF(*given, *new)


def decode(tokens: DataFrame, ranks_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids stands for (null: null)."""
    from pyspark.sql import functions as F

    with open(ranks_file, "rb") as f:
        data = tokens.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def run(column):
        replay = _replay(data.value)
        return column.map(lambda x: None if x is None else b"".join(replay.token[int(i)] for i in x))

    return tokens.withColumn(to, run(col(ids)))
