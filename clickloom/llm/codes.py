"""Vector code compression: product codes whose codebooks come from delta-maintained Lloyd rounds.

Vectors of whole numbers are cut into equal consecutive parts, each with a codebook of its own. A round assigns every part to its nearest entry
and moves each entry to the floor of the mean of its parts. The assignments of the round before are kept beside the vectors in a
written table, and the sums and counts of all entries in another one. A round therefore shuffles no vectors: only parts whose assignment has changed
give a minus to their old entry and a plus to the new one, summed up in each task first. The first round has no old entries. If nothing changes,
further rounds could not change anything either, and none is run. Codebooks (parts x entries x components) are all that
the driver holds and sends.

Defined cases: vectors that are null or hold null or non-finite components take no part. Shorter vectors are filled up with zeros at the end to the
longest one's length, and that to a multiple of the number of parts. Components are held within +-`limit_of` the length (2^27 for 64 components, 524,288
before scaling), so that distances fit 64 bits. Ties go to the lower entry. The first codebooks are the vectors of the smallest ids, of equal ids those of the smaller vector, null ids
last; with fewer vectors than entries, the codebooks are smaller. Repeated rows count each time. Labels may repeat without bound: sums of hot ones
are broadcast, the others are joined. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, ship, steps, tidied, written

HOT_SHARE = 1000  # a label with more than 1/HOT_SHARE of the rows is hot
LONGEST = (1 << 63) - 1
DELTAS = "part int, entry int, place int, delta long"  # place -1: the count


@dataclass(frozen=True)
class Books:
    """Entries of all codebooks, parts x entries x components."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components as decimal numbers by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit_of(dims: int) -> int:
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): vectors with each component x as floor(scale * x), without those that take no part."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    fine = F.col("raw").isNotNull() & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = float(1 << 62)
    held = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * scale, F.lit(-most)), F.lit(most))), F.lit(-limit_of(1))), F.lit(limit_of(1)))
    return rows.filter(fine).select("vec_id", "label", F.transform("raw", lambda x: held(x).cast("long")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of numbers, filled up with zeros and held within the limit."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy()
    most = limit_of(dims)
    return np.clip(out, -most, most)


def assigned(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (rows x parts) and the squared distances summed over the parts."""
    parts, entries, width = books.entries.shape
    code, error = np.zeros((len(x), parts), dtype=np.uint16), np.zeros(len(x), dtype=np.int64)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(books.entries).max(initial=0)))
    exact = 4 * width * largest**2 < 1 << 53  # then doubles hold all sums
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width], books.entries[p]
        if exact:
            a, b = own.astype(np.float64), book.astype(np.float64)
            apart = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
        else:
            apart = np.stack([((own - e) ** 2).sum(axis=1) for e in book], axis=1)
        code[:, p] = best = apart.argmin(axis=1)
        error += apart[np.arange(len(x)), best].astype(np.int64)
    return code, error


def _row_steps(column: pa.Array, dims: int, entries: int):
    """(rows, matrix) in steps of bounded size."""
    for a, b in steps(np.full(len(column), max(1, dims, entries))) if len(column) else ():
        yield slice(a, b), matrix(column.slice(a, b - a), dims)


def _codes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype("<u2")], pa.binary())


def _known(column: pa.Array, parts: int) -> np.ndarray:
    """Codes as rows; -1 where there are none yet."""
    none = np.full(parts, -1, dtype=np.int64)
    return np.array([none if c is None else np.frombuffer(c, dtype="<u2") for c in column.to_pylist()], dtype=np.int64).reshape(len(column), parts)


def reassigned(kept: DataFrame, books: Books) -> DataFrame:
    """The vectors with new codes, and those of the round before as `was`."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _row_steps(batch.column(2), parts * width, entries):
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _codes(assigned(x, books)[0]), part.column(3)], names=["vec_id", "label", "v", "code", "was"])

    schema = T.StructType([*kept.select("vec_id", "label", "v", "code").schema.fields, T.StructField("was", T.BinaryType())])
    return kept.select("vec_id", "label", "v", "code").mapInArrow(tidied(run), schema)


def changes(table: DataFrame, books: Books) -> DataFrame:
    """DELTAS: what changed assignments take from their old entries and add to the new ones, one sum of each kind from each task."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), dtype=np.int64)
        for batch in batches:
            for rows, x in _row_steps(batch.column(0), parts * width, entries):
                new, old = (_known(batch.column(c).slice(rows.start, rows.stop - rows.start), parts) for c in (1, 2))
                one = np.ones((len(x), 1), dtype=np.int64)
                for p in range(parts):
                    moved = np.flatnonzero(new[:, p] != old[:, p])
                    values = np.concatenate([one, x[:, p * width : (p + 1) * width]], axis=1)
                    left = moved[old[moved, p] >= 0]
                    np.subtract.at(total[p], old[left, p], values[left])
                    np.add.at(total[p], new[moved, p], values[moved])
        p, e, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (p, e, i - 1)] + [pa.array(total[p, e, i])], names=["part", "entry", "place", "delta"])

    some = F.col("was").isNull() | (F.col("was") != F.col("code"))
    found = table.filter(some).select("v", "code", "was").mapInArrow(tidied(run), DELTAS)
    return found.groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def moved(books: Books, sums: DataFrame) -> Books:
    """Each entry at the floor of the mean of its parts, unused ones where they are. `sums` has a row for each component at most."""
    parts, entries, width = books.entries.shape
    total = np.zeros((parts, entries, 1 + width), dtype=np.int64)
    for r in sums.collect():
        total[r["part"], r["entry"], 1 + r["place"]] = r["delta"]
    n = total[:, :, :1]
    return Books(np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books.entries))


def first_books(vectors: DataFrame, parts: int, entries: int) -> Books | None:
    """The vectors of the smallest ids, part by part; None if there are no vectors."""
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return None
    dims = -(-longest // parts) * parts
    rows = vectors.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = matrix(pa.array([r["v"] for r in rows], pa.list_(pa.int64())), dims)
    return Books(np.ascontiguousarray(start.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2)))


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Books | None:
    """Codebooks for (vec_id, label, v) after some rounds."""
    ship(vectors.sparkSession)
    books = first_books(vectors, parts, entries)
    if books is None:
        return None
    table, sums = vectors.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        after = written(reassigned(table, books), "codes")
        delta = changes(after, books)
        new = written(delta if sums is None else sums.unionByName(delta).groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta")), "sums")
        done, books = books, moved(books, new)
        discard(*[t for t in (table, sums) if t is not None])
        table, sums = after, new
        if (done.entries == books.entries).all():
            break
    discard(*[t for t in (table, sums) if t is not None])
    return books


def encoded(vectors: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error): the entries' numbers in order of the parts, two hex digits each (four from 257 entries on), and the squared distance."""
    parts, entries, width = books.entries.shape
    kind = "u1" if entries <= 256 else ">u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _row_steps(batch.column(2), parts * width, entries):
                code, error = assigned(x, books)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in code.astype(kind)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([*vectors.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "v").mapInArrow(tidied(run), schema)


def decoded(code: str, books: Books) -> np.ndarray:
    """The vector that a code stands for."""
    parts, entries, _ = books.entries.shape
    numbers = np.frombuffer(bytes.fromhex(code), dtype="u1" if entries <= 256 else ">u2")
    return books.entries[np.arange(parts), numbers].ravel()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Add the error summed over equal labels, nulls together (the largest long, should it be more)."""
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = written(rows.groupBy("label").agg(F.count("*").alias("n"), total.alias("label_error")), "labels")
    all_rows = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.filter(F.col("n") * HOT_SHARE > all_rows)  # fewer than HOT_SHARE
    rest = sums.filter(F.col("n") * HOT_SHARE <= all_rows)
    same = lambda s: rows["label"].eqNullSafe(s["label"])
    columns = [rows[c] for c in rows.columns]
    near = rows.join(F.broadcast(hot), same(hot)).select(*columns, "label_error")
    return near.unionByName(rows.join(rest.hint("shuffle_merge"), same(rest)).select(*columns, "label_error"))


def compressed(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes, errors and a digest of the codebooks for all vectors that take part."""
    vectors = written(whole_vectors(table), "vectors")
    books = fit(vectors, parts, entries, rounds)
    if books is None:
        rows = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        rows = written(encoded(vectors, books), "encoded")
        discard(vectors)
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(books.sha256 if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
