"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (line) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo a power of two. So the order of paragraphs does not matter, and a paragraph
is inserted or deleted by adding or subtracting its vector (`combine`). A vector has two parts:

* IDENTITY lanes modulo 2^64, each 64 bits of its own from a BLAKE2b digest of the whole paragraph: equal sums
  mean equal multisets of paragraphs, but for a chance of about 2^-512.
* CONTENT lanes modulo 2^32, into which each three-word shingle of the paragraph puts +1 or -1 at a
  hashed lane. The squared length of a difference of such sums estimates the size of the symmetric
  difference of two documents, which gives `likeness` (an estimate of their Jaccard similarity).

Defined cases: null is the empty text, which has one empty paragraph. Equal texts have equal fingerprints;
texts that are permutations of the same lines too. Rows are chained by ascending doc_id, then by the text's hash (so that the
rows of one doc_id can be dealt to many tasks), then text; a null doc_id counts as the smallest number; the document
after the last is the first (itself, if it is alone). Repeated rows are documents of their own. A text of any length is hashed whole,
a few lines at a time. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import _FACTORS, STEP_BYTES, U64, mix, shingles_of, ship, steps, text_word_hashes, tidied, word_hashes

IDENTITY, CONTENT = 8, 256
SHINGLE = 3
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _line_sums(owners: np.ndarray, lines: list[bytes], identity: np.ndarray, content: np.ndarray) -> None:
    """Add the vectors of some paragraphs to the sums of the texts that own them (in ascending order)."""
    digests = b"".join(hashlib.blake2b(line, digest_size=8 * IDENTITY, person=b"paragraph").digest() for line in lines)
    first = np.flatnonzero(np.diff(owners, prepend=-1))
    identity[owners[first]] += np.add.reduceat(np.frombuffer(digests, dtype="<u8").reshape(-1, IDENTITY), first, axis=0)
    if len(lines) == 1:
        words = text_word_hashes(lines[0])
        counts = np.array([len(words)])
    else:
        split = [line.split() for line in lines]
        counts = np.array(list(map(len, split)))
        words = word_hashes(list(chain.from_iterable(split)))
    line = np.repeat(np.arange(len(lines)), counts)
    whole = np.flatnonzero(line[: len(words) - SHINGLE + 1] == line[SHINGLE - 1 :]) if len(words) >= SHINGLE else np.empty(0, dtype=np.int64)
    values, of = [shingles_of(words, SHINGLE)[whole]] if len(whole) else [], [line[whole]]
    starts = np.cumsum(counts) - counts
    for n in range(1, SHINGLE):  # a paragraph of fewer words gives one shingle of them all
        short = np.flatnonzero(counts == n)
        value = sum((words[starts[short] + j] * _FACTORS[j] for j in range(n)), np.zeros(len(short), dtype=U64))
        values.append(mix(value + U64(n)))
        of.append(short)
    value, of = np.concatenate(values), owners[np.concatenate(of).astype(np.int64)]
    sign = np.where(value & U64(1), 1.0, -1.0)
    low = int(owners[0])
    rows = int(owners[-1]) - low + 1
    found = np.bincount((of - low) * CONTENT + (value >> U64(56)).astype(np.int64), weights=sign, minlength=rows * CONTENT)
    content[low : low + rows] += found.astype(np.int64).reshape(rows, CONTENT)


def sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Identity sums (texts x IDENTITY, modulo 2^64) and content sums (texts x CONTENT, modulo 2^32)."""
    identity, content = np.zeros((len(texts), IDENTITY), dtype=U64), np.zeros((len(texts), CONTENT), dtype=np.int64)
    owners, lines, size = [], [], 0
    for i, text in enumerate(texts):
        for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
            owners.append(i)
            lines.append(line)
            size += len(line) + 1
            if size > STEP_BYTES:
                _line_sums(np.array(owners), lines, identity, content)
                owners, lines, size = [], [], 0
    if lines:
        _line_sums(np.array(owners), lines, identity, content)
    return identity, content.astype(np.uint32)


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint sums after inserting (sign 1) or deleting (sign -1) the paragraphs of b."""
    return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def _square(content: np.ndarray) -> np.ndarray:
    return (content.astype(np.uint32).view(np.int32).astype(np.float64) ** 2).sum(axis=1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity (0 to 1) of the shingles behind two rows of sums; 1 for equal sums."""
    both, apart = _square(a[1]) + _square(b[1]), _square(a[1] - b[1])
    value = np.clip(np.divide(both - apart, both + apart, out=np.zeros_like(both), where=both + apart > 0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(axis=1), 1.0, value)


def encoded(s: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [base64.b64encode(x.tobytes() + y.tobytes()).decode() for x, y in zip(s[0].astype("<u8"), s[1].astype("<u4"))]


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], of_texts: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Output rows of all texts but the last, which only follows."""
    n = len(ids) - 1
    changed = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:])]
    lengths = np.array([len(t) for t in changed], dtype=np.int64)
    for a, b in steps(lengths):
        own, other = (tuple(x[p : p + b - a] for x in of_texts) for p in (a, a + 1))
        edited = sums(changed[a:b])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[a:b], pa.int64()),
                pa.array([len(t) for t in texts[a:b]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed[a:b]]),
                pa.array(encoded(own)),
                pa.array(encoded(edited)),
                pa.array(likeness(own, edited)),
                pa.array(likeness(own, other)),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )
    assert n == len(changed)


def fingerprints(docs: DataFrame, partition_bytes: int = 16 << 20, most_ranges: int = 10_000) -> DataFrame:
    """Fingerprints of all documents and their edited texts: SCHEMA.

    Rows are dealt out by ranges of (doc_id, hash of the text) and sorted within them. The first row of each range is also
    sent to the range before it (the first of all to the last), so that one shuffle of the texts is enough and
    only one row a range is copied. The ranges are those of a range partitioning of the keys alone; their borders (two
    numbers each, at most `most_ranges`) are all that the driver sees. A larger table has larger ranges, which are sorted with spilling.
    """
    spark = docs.sparkSession
    ship(spark)
    least = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(least)).alias("id"), F.xxhash64("text").alias("h"))
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    if not total["rows"]:
        return spark.createDataFrame([], SCHEMA)
    parts = max(1, min(most_ranges, -(-int(total["chars"] or 0) // partition_bytes)))
    borders = [(least, least)]
    if parts > 1:
        ranges = rows.select("id", "h").repartitionByRange(parts, "id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "h")).alias("b"))
        borders += sorted((r["b"]["id"], r["b"]["h"]) for r in ranges.collect())[1:]
    ids, hashes = (np.array(x, dtype=np.int64) for x in zip(*borders))

    @F.pandas_udf("int")
    def slot_of(id_: pd.Series, h: pd.Series) -> pd.Series:  # the last border at or below (id, h)
        i, x = id_.to_numpy(), h.to_numpy()
        low, high = np.searchsorted(ids, i, side="left"), np.searchsorted(ids, i, side="right")
        found = high.copy()
        for a in np.unique(low[high > low]):  # ids at a border
            own = np.flatnonzero((low == a) & (high > low))
            found[own] = a + np.searchsorted(hashes[a : high[own[0]]], x[own], side="right")
        return pd.Series(np.maximum(found - 1, 0).astype(np.int32))

    slot = slot_of("id", "h") if len(borders) > 1 else F.lit(0)
    dealt = rows.withColumn("slot", slot)
    heads = rows.select("id", "h").withColumn("slot", slot).groupBy("slot").agg(F.min(F.struct("id", "h")).alias("head")).orderBy("slot").collect()
    slots = [r["slot"] for r in heads]
    before = {slots[i]: slots[i - 1] for i in range(len(slots))}
    head_rows = spark.createDataFrame([(r["slot"], before[r["slot"]], r["head"]["id"], r["head"]["h"]) for r in heads], "of int, target int, first_id long, first_h long")
    # of the rows with a range's smallest key, the first by text follows the range before; equal rows are told apart by nothing
    first = (F.col("slot") == F.col("of")) & (F.col("id") == F.col("first_id")) & (F.col("h") == F.col("first_h"))
    copies = (
        dealt.join(F.broadcast(head_rows), first)
        .groupBy("target")
        .agg(F.min(F.struct("text", "doc_id", "id", "h")).alias("r"))
        .select(F.col("target").alias("slot"), "r.doc_id", "r.text", "r.id", "r.h", F.lit(1).alias("copy"))
    )
    every = dealt.select("slot", "doc_id", "text", "id", "h", F.lit(0).alias("copy")).unionByName(copies)
    laid = every.repartitionById(max(slots) + 1, F.col("slot")).sortWithinPartitions("slot", "copy", "id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # the row that waits for its follower: slot, id, text, sums
        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for a, b in steps(lengths):
                part = batch.slice(a, b - a).to_pydict()
                own = sums(part["text"])
                slot, ids, texts = part["slot"], part["doc_id"], part["text"]
                if kept:
                    slot, ids, texts = [kept[0], *slot], [kept[1], *ids], [kept[2], *texts]
                    own = tuple(np.concatenate([k, x]) for k, x in zip(kept[3], own))
                cuts = [0, *[i for i in range(1, len(slot)) if slot[i] != slot[i - 1]], len(slot)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    if y - x > 1:
                        yield from _rows(ids[x:y], texts[x:y], tuple(v[x:y] for v in own))
                kept = (slot[-1], ids[-1], texts[-1], tuple(v[-1:] for v in own))

    return laid.select("slot", "doc_id", "text").mapInArrow(tidied(run), SCHEMA)
