"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into whole windows, which are sequences of their own, and a rest, which is cut into
pieces of at most a quarter of a window: with several pieces to a window sums come out near-equal, so that little is padded. The pieces
are dealt evenly into batches of bounded size, and each batch is split into m windows: partial partitions wait by their imbalance, and the two of the largest are merged so that
the largest window of one meets the smallest of the other, until one partition is left. m begins at the least
number of windows and rises whenever a window exceeds the capacity.

Defined cases: null and empty texts are the end id alone. Repeated rows are documents of their own, packed each. Equal
imbalances merge in the order of arrival. Strings of special tokens in a text are ordinary text. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled, tidied, written
from .pretokens import IdCache

CAPACITY = 2048
BATCH = 1024  # pieces that are packed together
STEP = 4096  # pre-tokens that the library encodes at a time
PARTS = 4  # of a window: the largest piece of a rest
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"


@lru_cache(2)
def encoder(path: str) -> IdCache:
    """The tokenizers library over new pre-tokens; one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[str]) -> list[list[int]]:
        ids = []
        for a in range(0, len(pieces), STEP):  # an encoding is far larger than its ids
            ids += [x.ids for x in tokenizer.encode_batch_fast(pieces[a : a + STEP], add_special_tokens=False)]
        return ids

    return IdCache(encode)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's windows and pieces of its rest: PIECES, and the ids themselves if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, ids, edges in encoder(path).batches(filled(batch.column(1))):
                ids = ids.astype("<u4")
                doc_ids = batch.column(0).slice(first, len(texts)).to_pylist()
                rows = []
                for doc_id, a, b in zip(doc_ids, edges[:-1].tolist(), edges[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    whole = len(own) - len(own) % capacity
                    for start in (*range(0, whole, capacity), *range(whole, len(own), capacity // PARTS)):
                        part = own[start : start + (capacity if start < whole else capacity // PARTS)]
                        rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(own), part if with_ids else None))
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    columns.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), PIECES + (", ids array<int>" if with_ids else ""))


def differencing(lengths: list[int], m: int) -> list[list[int]]:
    """The items of m windows whose sums are near-equal."""
    # a partition: its windows that are not empty, largest first, each (sum, tree of items)
    heap = []
    for i, x in enumerate(lengths):
        heap.append((-x if m > 1 else 0, i, [(x, i)]))
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - m
        if over > 0:
            head, tail = a[: len(a) - over], a[len(a) - over :]
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(tail, b[len(b) - over :][::-1])]
            both = head + met + b[: len(b) - over]
        else:
            both = a + b
        both.sort(key=lambda w: -w[0])
        least = both[-1][0] if len(both) == m else 0
        heapq.heappush(heap, (least - both[0][0], order, both))
        order += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += [x[1], x[0]]
            else:
                items.append(x)
        out.append(items)
    return out


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The items of each window; the number of windows rises until none exceeds the capacity."""
    m = max(1, -(-sum(lengths) // capacity))
    while lengths:
        found = differencing(lengths, m)
        most = max(sum(lengths[i] for i in w) for w in found)
        if most <= capacity:
            return found
        m += max(1, m * (most - capacity) // (3 * capacity))
    return []


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each piece with its sequence and offset: SCHEMA (and ids if asked for).

    The pieces are written once; batches are dealt from their row numbers, so that a batch that is
    made again is the same.
    """
    cut = written(pieces(docs, path, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = cut.filter(F.col("length") < capacity)
    n = max(1, -(-rests.count() // BATCH))
    fields = cut.schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        lengths = group["length"].tolist()
        sequence, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        for w, items in enumerate(windows(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = w, at
                at += lengths[i]
        return group.assign(sequence_id=group["batch"].astype("int64") * (1 << 24) + sequence, offset=offset).drop(columns=["batch", "row"])

    dealt = rests.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(n)).cast("long"))
    columns = [f.name for f in fields if f.name != "row"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields if f.name != "row") + ", sequence_id long, offset long"
    mixed = dealt.groupBy("batch").applyInPandas(lambda g: run(g)[[*columns, "sequence_id", "offset"]], schema)
    # sequence ids: batch and window, far below those of whole windows
    whole = cut.filter(F.col("length") == capacity).select(*columns, (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(whole)
