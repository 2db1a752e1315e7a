"""Vector codes against plain Lloyd rounds in Python numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import codes
from clickloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, v string"


def brute(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) of each row and the digest; rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    longest = max(len(v) for _, v, _ in kept)
    width = -(-longest // parts)
    most = codes.limit_of(width * parts)
    kept = [(i, [max(-most, min(most, x)) for x in v] + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            new.append([[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])])
        books = new
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        total[label] += out[-1][2]
    numbers = [x for book in books for e in book for x in e]
    return [(*r[:3], total[r[3]]) for r in out], hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def check(spark, rows, parts, entries, rounds):
    table = spark.createDataFrame([(*r, "c", "v") for r in rows], SCHEMA).repartition(3)
    got = codes.compressed(table, parts, entries, rounds).collect()
    want, digest = brute(rows, parts, entries, rounds)
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    return got


def some_rows(n, dims, seed=1):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + draw.gauss(0, 0.2) for c in draw.choice(centres)], draw.choice([0, 1, None, 7])) for i in range(n)]


@pytest.mark.parametrize("n, dims, parts, entries, rounds", [(150, 8, 4, 6, 2), (60, 6, 3, 64, 3), (40, 5, 2, 4, 0), (90, 4, 1, 3, 9)])
def test_against_lloyd(spark, n, dims, parts, entries, rounds):
    check(spark, some_rows(n, dims), parts, entries, rounds)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, digest = brute(rows, 16, 64, 2)
    got = QUERIES["op11_vector_codes"](spark, SF).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want) and {r["codebooks_sha256"] for r in got} == {digest}


def test_cases(spark):
    """Nulls, odd components, unequal lengths, empty vectors, repeated rows and ids, null ids, ties, very large numbers, one label for most rows."""
    rows = some_rows(30, 4)
    rows += [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [math.nan, 0.0, 0.0, 0.0], 1), (103, [math.inf, 0.0, 0.0, 0.0], 1), (104, [], 1), (105, [1.0], None), (106, [1.0] * 7, 1)]
    rows += [rows[3], rows[3], (3, [9.0, 9.0, 9.0, 9.0], 2), (None, [0.5] * 4, None), (None, [0.5] * 4, None), (107, [0.1] * 4, 2), (108, [-1e300, 1e300, 5.0, 5.0], 3)]
    rows += [(200 + i, [2.0, 2.0, 2.0, 2.0], 7) for i in range(50)]
    check(spark, rows, 4, 5, 2)
    check(spark, [], 4, 5, 2)
    check(spark, [(1, None, 1)], 4, 5, 2)
    check(spark, [(1, [], 1), (2, [], None)], 4, 5, 2)
    check(spark, [(i, [1.0, 2.0], i % 2) for i in range(9)], 2, 4, 2)  # all equal: ties go to the lowest entry


def test_cold_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT_SHARE", 3)
    check(spark, [(i, v, label if i % 2 else i) for i, v, label in some_rows(80, 4)], 2, 4, 1)


def test_only_changes_are_shuffled(spark):
    vectors = codes.whole_vectors(spark.createDataFrame([(*r, "c", "v") for r in some_rows(200, 4)], SCHEMA)).cache()
    books = codes.first_books(vectors, 2, 8)
    first = codes.reassigned(vectors.withColumn("code", F.lit(None).cast("binary")), books).cache()
    sums = codes.changes(first, books)
    assert sums.filter("place = -1").agg(F.sum("delta")).first()[0] == 400  # each part once
    after = codes.moved(books, sums)
    second = codes.reassigned(first, after).cache()
    delta = codes.changes(second, after)
    assert delta.filter("place = -1").agg(F.sum("delta")).first()[0] in (0, None)  # what leaves an entry joins another
    again = codes.reassigned(first.drop("was").withColumn("code", F.lit(None).cast("binary")), after)
    whole = {tuple(r) for r in codes.changes(again, after).collect()}
    kept = sums.unionByName(delta).groupBy("part", "entry", "place").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    assert {tuple(r) for r in kept.collect()} == whole  # running sums are those of all parts anew
    assert not codes.changes(codes.reassigned(second, after), after).collect()


def test_more_rounds_do_not_hurt_and_codes_decode(spark):
    vectors = codes.whole_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).cache()
    errors = []
    for rounds in (0, 1, 3):
        books = codes.fit(vectors, 16, 64, rounds)
        rows = codes.encoded(vectors, books).join(vectors.select("vec_id", "v"), "vec_id").collect()
        assert all(r["error"] == ((codes.decoded(r["code"], books) - np.array(r["v"])) ** 2).sum() for r in rows)
        errors.append(sum(r["error"] for r in rows))
    assert errors[0] > errors[1] > errors[2]
