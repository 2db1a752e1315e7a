"""Exact top-k search by inner product with vector-approximation files.

Vectors are dealt into blocks, and each block is written once as an approximation file: for every component the number of one
of CELLS equal cells between the block's least and largest value (one byte), and beside it the exact vectors in the smallest
integer type that holds them. For a query, one product with the cells bounds the score of every vector from above. The exact
vectors are then read in the order of these bounds until the k-th exact score is above all bounds that are left. A task
takes a run of blocks for one block of queries and carries each query's k best from block to block; the best of the runs are
merged. So a vector is copied once for each QUERY_BYTES of queries; that is a stated query set against all rows, in blocks.

Rows that are equal in id and vector count once, as query and as candidate. Of the ids with one vector only the k + 1 smallest can be among
the best of any query, so a very common vector does not weigh on the search.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
vectors of different length are not compared; empty vectors score 0 with each other. Ties go to the smaller
vec_id. Different vectors of one vec_id are candidates of their own, but a query never meets its own id; a query id
with several vectors is searched once for each. Very long vectors make smaller blocks. Scores are exact whole numbers; those beyond 64 bits are given
as the largest (smallest) long. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ship, written

CELLS = 256
BLOCK_BYTES, QUERY_BYTES = 1 << 20, 1 << 20  # cells of a block, components of a block of queries
RUN = 8  # blocks that a task takes one after the other, at most
STEP = 128  # queries bounded at a time
LONGEST = (1 << 63) - 1
FILES = "c int, dims int, n int, ids binary, cells binary, low binary, width binary, kind string, exact binary"
ASKED = "q int, dims int, ids binary, notes binary, kind string, exact binary"


def smallest(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest integer type, or as they are if they are beyond 32 bits."""
    most = np.abs(x).max(initial=0)
    return x.astype(next((t for t, b in (("<i1", 7), ("<i2", 15), ("<i4", 31)) if most < 1 << b), "<f8"))


def approximated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and each dimension's least value and cell width."""
    low = x.min(axis=0)
    width = np.maximum((x.max(axis=0) - low) / CELLS, 1e-300)
    return np.clip(np.floor((x - low) / width), 0, CELLS - 1).astype(np.uint8), low, width


def upper_bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of queries (rows) and vectors (columns): a score that the exact one does not exceed. Cells come as 32-bit floats."""
    scaled = q * width
    most = np.abs(scaled).sum(axis=1) * CELLS + np.abs(q * low).sum(axis=1)
    largest = np.abs(scaled).max(initial=0)
    unit = largest if largest > 1e30 else 1.0  # within the range of 32-bit floats
    rest = (q * low).sum(axis=1) + np.maximum(scaled, 0).sum(axis=1) + most * (2 * len(low) + 8) * 2.0**-23  # the far end of each cell, and rounding
    return (scaled / unit).astype(np.float32) @ cells.T * unit + rest[:, None]


def exact_scores(x: np.ndarray, q: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products; in integers of any size where doubles could round."""
    return x.astype(np.float64) @ q if whole else np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in x], dtype=object)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The k best of each query over blocks that come one after the other; `read` counts exact vectors."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        self.query_ids, self.q, self.k, self.read = query_ids, q.astype(np.float64), k, 0
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(q)

    def block(self, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, exact: np.ndarray) -> None:
        dims = cells.shape[1]
        whole = not dims or float(np.abs(exact).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * dims < 2**53
        near = cells.astype(np.float32)
        for a in range(0, len(self.q), STEP):
            part = self.q[a : a + STEP]
            upper = upper_bounds(near, low, width, part) if dims else np.zeros((len(part), len(ids)))
            for i, bound in enumerate(upper):
                self.best[a + i] = self._one(a + i, bound, ids, exact, whole)

    def _one(self, i: int, bound: np.ndarray, ids: np.ndarray, exact: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        best_ids, best = self.best[i]
        bound[ids == self.query_ids[i]] = -np.inf
        if len(best) >= self.k:
            rest = np.flatnonzero(bound >= float(best[-1]))
        elif len(bound) > 4 * self.k:  # the best bounds first, the others only if they could be better
            rest = np.argpartition(-bound, self.k)[: self.k]
        else:
            rest = np.flatnonzero(bound > -np.inf)
        done = len(best) >= self.k or len(bound) <= 4 * self.k
        while True:
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            at = 0
            while at < len(rest) and not (len(best) >= self.k and float(best[-1]) > bound[rest[at]]):
                read = rest[at : at + max(2 * self.k, at)]
                read = read[bound[read] > -np.inf]
                at += max(2 * self.k, at)
                self.read += len(read)
                scores = exact_scores(exact[read], self.q[i], whole)
                best = np.concatenate([best, scores]) if whole and best.dtype != object else np.concatenate([np.array([int(x) for x in best], dtype=object), np.array([int(x) for x in scores], dtype=object)])
                best_ids = np.concatenate([best_ids, ids[read]])
                order = best_of(best_ids, best, self.k)
                best, best_ids = best[order], best_ids[order]
            if done:
                return best_ids, best
            done, bound = True, bound.copy()
            bound[rest] = -np.inf  # they have been read
            least = float(best[-1]) if len(best) >= self.k else -np.inf
            rest = np.flatnonzero((bound >= least) & (bound > -np.inf))

    def rows(self, notes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        for i, (ids, scores) in enumerate(self.best):
            for v, s in zip(ids, scores):
                yield int(self.query_ids[i]), int(notes[i]), int(v), max(-LONGEST - 1, min(LONGEST, int(s)))


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): the vectors with each component x as floor(scale * x), without those that take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("raw")).filter(F.col("id").isNotNull() & v_known("raw"))
    return rows.select("id", F.transform("raw", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def v_known(name: str):
    """Whether a vector is there and all of its components are finite."""
    return F.col(name).isNotNull() & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrices(rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for dims, own in rows.groupby(rows["v"].map(len)):
        yield int(dims), own, np.array(own["v"].tolist(), dtype=np.float64).reshape(len(own), dims)


def approximation_files(vectors: DataFrame, blocks: int) -> DataFrame:
    """FILES: the approximation files of the blocks (one for each length of vectors in a block), written once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, own, x in _matrices(rows):
            own_ids = own["id"].to_numpy(dtype=np.int64)
            cells, low, width = approximated(x)
            exact = smallest(x)
            out.append((rows["c"].iloc[0], dims, len(x), own_ids.tobytes(), cells.tobytes(), low.tobytes(), width.tobytes(), exact.dtype.str, exact.tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in FILES.split(", ")])

    dealt = vectors.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("c").applyInPandas(run, FILES), "files")


def query_files(queries: DataFrame, blocks: int) -> DataFrame:
    """ASKED: the queries in blocks; a note tells apart queries that share an id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, own, x in _matrices(rows):
            exact = smallest(x)
            out.append((rows["q"].iloc[0], dims, own["id"].to_numpy(dtype=np.int64).tobytes(), own["note"].to_numpy(dtype=np.int64).tobytes(), exact.dtype.str, exact.tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in ASKED.split(", ")])

    dealt = queries.withColumn("note", F.xxhash64("id", "v")).withColumn("q", F.pmod("note", F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("q").applyInPandas(run, ASKED), "queries")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (id, v) against candidates (id, v) of whole numbers."""
    spark = vectors.sparkSession
    ship(spark)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    asked_rows = queries.count()
    dims = max(1, size["dims"] or 1)
    tasks = spark.sparkContext.defaultParallelism
    block = max(1, min(BLOCK_BYTES // dims, max(1024, -(-size["n"] // tasks))))
    blocks, asked_blocks = max(1, -(-size["n"] // block)), max(1, -(-asked_rows * dims // QUERY_BYTES))
    run_of = max(1, min(RUN, blocks * asked_blocks // (4 * tasks)))
    runs = -(-blocks // run_of)
    same = W.partitionBy("h", "v").orderBy("id")
    kept = vectors.distinct().withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).select("id", "v")
    files = approximation_files(kept, blocks).withColumn("run", F.floor(F.col("c") / run_of).cast("int"))
    files = files.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))
    asked = query_files(queries.distinct(), asked_blocks).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for mine in right.itertuples():
            ids, notes = np.frombuffer(mine.ids, dtype=np.int64), np.frombuffer(mine.notes, dtype=np.int64)
            search = Search(ids, np.frombuffer(mine.exact, dtype=mine.kind).reshape(len(ids), mine.dims), k)
            for f in left[left["dims"] == mine.dims].itertuples():
                low, width = np.frombuffer(f.low), np.frombuffer(f.width)
                cells, exact = np.frombuffer(f.cells, dtype=np.uint8).reshape(f.n, f.dims), np.frombuffer(f.exact, dtype=f.kind).reshape(f.n, f.dims)
                search.block(np.frombuffer(f.ids, dtype=np.int64), cells, low, width, exact)
            out += search.rows(notes)
        return pd.DataFrame(out, columns=["query_id", "note", "vec_id", "score"]).astype("int64")

    found = files.groupBy("run", "q").cogroup(asked.groupBy("run", "q")).applyInPandas(run, "query_id long, note long, vec_id long, score long")
    order = W.partitionBy("query_id", "note").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
