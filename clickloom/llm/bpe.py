"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a step's pre-tokens form one linked list, with a border between them. Each adjacent pair that can merge lies in the bucket of its merge
rank, as the position of its left part. A bitmap of three levels marks the buckets that are not empty, so the lowest
rank is found by three find-first-set steps, whatever the length. Merging takes the positions of the
lowest bucket from the left; entries whose pair has changed since are stale and skipped. A pre-token of n bytes
costs O(n) queue steps (and the ordering within a bucket), so very long pre-tokens are no special case.

Pre-tokens are the matches of the public pattern (`pretokens`); equal ones are encoded once in a step and kept.

Defined cases: null is the empty text, which has no ids. Strings of special tokens are ordinary text. Repeated rows
each keep a row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled, tidied
from .pretokens import IdCache

MANY = 30_000  # bytes of new pre-tokens from which on buckets are merged as arrays
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Buckets of list positions for each rank, with a three-level bitmap of the buckets in use."""

    __slots__ = ("top", "middle", "leaf", "buckets")

    def __init__(self) -> None:
        self.top = 0  # bit i: middle[i] has a bit; a rank is (top, middle, leaf) of 64 x 64 x 64
        self.middle: dict[int, int] = {}
        self.leaf: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.leaf[rank >> 6] = self.leaf.get(rank >> 6, 0) | 1 << (rank & 63)
            self.middle[rank >> 12] = self.middle.get(rank >> 12, 0) | 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions; the bucket leaves the queue."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.leaf[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        word &= word - 1
        self.leaf[b] = word
        if not word:
            word = self.middle[a] & ~(1 << (b & 63))
            self.middle[a] = word
            if not word:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Ranks of a tiktoken file: bytes of each id, and the rank of each pair of ids that merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for raw, rank in self.ranks.items():
            self.bytes[rank] = raw
        self.pairs: dict[int, int] = {}
        for raw, rank in self.ranks.items():
            for i in range(1, len(raw)):
                left, right = self.ranks.get(raw[:i]), self.ranks.get(raw[i:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.pair_keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token. All of them share one list and one queue; a border (-2) parts them and merges with nothing."""
        out: list[list[int]] = []
        waiting: list[int] = []
        ids: list[int] = [-2]
        single, pairs = self.single, self.pairs
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out.append([whole])
                continue
            waiting.append(len(out))
            out.append([])
            ids += [single[b] for b in raw]
            ids.append(-2)
        ids = self._merge_many(ids) if len(ids) >= MANY else self._merge(ids)
        at, part = -1, []
        for x in ids:
            if x >= 0:
                part.append(x)
            elif x == -2:
                if at >= 0:
                    out[waiting[at]] = part
                at, part = at + 1, []
        return out

    def _merge_many(self, given: list[int]) -> list[int]:
        """The same for long lists: all positions of a bucket at a time, in arrays."""
        n = len(given)
        ids = np.array(given, dtype=np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        queue = RankQueue()

        def ranks_at(left: np.ndarray) -> np.ndarray:
            key = ids[left] << 20 | ids[after[left]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            some = ranks >= 0
            ranks, positions = ranks[some], positions[some]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, a, b in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else (), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                queue.push(rank, positions[a:b])

        every = np.arange(n - 1)
        push(ranks_at(every), every)
        while queue.top:
            rank, parts = queue.pop()
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[(ids[at] >= 0) & (ranks_at(at) == rank)]
            if not len(at):
                continue
            if len(at) > 1:
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # in a chain x x x every second one has lost its left part
                    index = np.arange(len(at))
                    begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), index, 0))
                    at = at[(index - begins) % 2 == 0]
            right = after[at]
            ids[at] = rank
            ids[right] = -1
            after[at] = beyond = after[right]
            before[beyond] = at
            left = before[at]
            positions = np.concatenate([at, left])
            ranks = ranks_at(positions)
            if ((ranks >= 0) & (ranks < rank)).any():  # its pre-token's order matters: one at a time
                return self._merge(given)
            push(ranks, positions)
        return ids.tolist()

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge a list of ids in place: a merged pair leaves its id at the left place and -1 at the right one."""
        pairs, n = self.pairs, len(ids)
        get = pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        push = queue.push
        for i, rank in enumerate(map(get, [a << 20 | b for a, b in zip(ids, ids[1:])])):
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, bucket = queue.pop()
            bucket.sort()
            for k, i in enumerate(bucket):
                j = after[i]
                # stale: the left part is gone or merged, or the right one has changed
                if ids[i] < 0 or get(ids[i] << 20 | ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                after[i] = j = after[j]
                before[j] = i
                pair = get(rank << 20 | ids[j])
                lower = False
                if pair is not None:
                    push(pair, i)
                    lower = pair < rank
                h = before[i]
                pair = get(ids[h] << 20 | rank)
                if pair is not None:
                    push(pair, h)
                    lower = lower or pair < rank
                if lower:  # a lower rank has come up: the rest of this bucket waits
                    for rest in bucket[k + 1 :]:
                        push(rank, rest)
                    break
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind a row of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.joined[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder(path: str) -> IdCache:
    """One cache for each worker process."""
    return IdCache(vocabulary(path).encode_pieces)


def encode(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text."""
    out = []
    for _, _, ids, edges in encoder(path).batches(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    return out


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of each whole text's ids, and of the bytes that they decode to: SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for first, texts, ids, edges in encoder(path).batches(filled(batch.column(1))):
                ids = ids.astype("<u4")
                rows = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(words.decode(r)).hexdigest() for r in rows], pa.string()),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, ids, edges in encoder(path).batches(filled(batch.column(1))):
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decoded_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else words.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, text string")
