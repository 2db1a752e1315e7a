"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

The classifier averages an embedding of every hashed subword (byte n-gram within a word) of the whole
text and puts the mean through a linear softmax. Both layers are trained by stochastic gradient descent
in numpy on a bounded, hashed sample of labelled rows (`most_rows` in all, at most `per_label` of each label; one crop of
`crop` characters and one short crop of each row). All that is broadcast has a fixed size: BUCKETS rows of
embeddings (folded with the linear layer where there are few labels), and the set of known subwords.

A held-back fifth of the sampled rows, with both crops of a row, and of all rows with the same crop, on one side, calibrates the rest:
the softmax temperature; the chance that a text is in one of the learned languages at all, a logistic function of the
share of its subwords that training has met and of their number, fitted on the held-back rows against corrupted copies of them (letters
swapped for each other throughout, letters shuffled, other scripts, keyboard noise); and the threshold on the score (the product of both chances), below
which a text is rejected: the `miss` quantile of held-back rows, or half-way to the corrupted rows if these score less. The rates reached are kept as `missed` and `let_in`.

Defined cases: a null text, or one without a letter, gets `und` with score 0 and is rejected. Very long texts are featurised whole, one at a
time. Repeated rows and ties each keep their own row; among equal scores the alphabetically first label wins. Other
columns are ignored (`accepted_documents` keeps them as they are, of whatever type). An empty table gives an empty result; a table without
labelled rows gives `und`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WIDE_STEP_BYTES, filled, joined, ship, text_steps, tidied, tidy

BUCKETS = 1 << 16
BUCKET_SHIFT, KNOWN_BITS = np.uint32(16), 20
KNOWN_SHIFT = np.uint32(32 - KNOWN_BITS)
ORDERS = (3, 4, 5)
UNKNOWN = "und"
TEXTS = 64  # that training takes the subwords of at a time
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    table: np.ndarray  # columns x BUCKETS: embeddings, or (few labels) their products with the linear layer
    linear: np.ndarray | None  # columns x labels, None if folded into the table
    bias: np.ndarray
    known: np.ndarray  # of each of 2^KNOWN_BITS finer buckets, whether training has met its subword
    inside: np.ndarray  # the logistic weights of `evidence`
    temperature: float
    threshold: float
    missed: float  # share of held-back rows that are rejected
    let_in: float  # share of corrupted rows that are accepted


_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def subwords(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: 32-bit hashes of the subwords of all (lower-case) texts in a row, and where each text's start."""
    data, first, end = joined(texts)
    letter = _LETTER[data]
    data = np.where(letter, data, np.uint8(0x20)).astype(np.uint32)
    out = []
    for n in ORDERS:
        m = max(0, len(data) - n + 1)
        inside = letter[1 : 1 + m].copy()
        for j in range(2, n - 1):
            inside &= letter[j : j + m]
        at = np.flatnonzero(inside)
        value = data[at]
        for j in range(1, n):
            value = value * np.uint32(0x01000193) ^ data[at + j]
        value = (value + np.uint32(n)) * np.uint32(2654435761)
        # a subword may begin at the space before its text
        edge = np.searchsorted(at, np.append(first, end[-1:] + 1) - 1) if len(texts) else np.zeros(1, dtype=np.int64)
        out.append((value, edge))
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


_SCRIPTS = ((0x3B1, 24), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x627, 28), (0x905, 50), (0xE01, 46), (0x10D0, 33), (0x3042, 80), (0x4E00, 400), (0xAC00, 400))


def corrupted(text: str, kind: int, rng: np.random.Generator) -> str:
    """A text that is in no language, though of the same length and layout."""
    letters = sorted({c for c in text if c.isalpha()})
    if kind == 0:  # each letter becomes another one throughout
        return text.translate({ord(a): letters[i] for a, i in zip(letters, rng.permutation(len(letters)))})
    if kind == 1:  # all letters change places
        mixed = iter(rng.permutation([c for c in text if c.isalpha()]))
        return "".join(str(next(mixed)) if c.isalpha() else c for c in text)
    if kind == 2:  # another script
        first, size = _SCRIPTS[rng.integers(len(_SCRIPTS))]
        return text.translate({ord(c): chr(first + int(rng.integers(size))) for c in letters})
    keys = "".join(rng.permutation(list("qwertzuiopasdfghjklyxcvbnm"))[: 4 + rng.integers(12)])  # keyboard noise
    return "".join(keys[rng.integers(len(keys))] if c.isalpha() else c for c in text)


def evidence(known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What tells texts in a learned language from others: known subwords and all subwords of each text."""
    share, size = known / np.maximum(counts, 1), np.log1p(counts)
    return np.stack([np.ones(len(counts)), share, size, share * size], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), slope)
        w -= step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _inside(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def train(
    texts: list[str], labels: list[str], rows: list[int] | None = None, size: int = 16, epochs: int = 5, least_steps: int = 20_000, rate: float = 0.5, gain: float = 5.0, miss: float = 0.001, seed: int = 7
) -> LanguageModel:
    """Fit the embeddings and the linear softmax, then calibrate on a fifth of the rows; texts with equal `rows` stay on one side."""
    names = tuple(sorted(set(labels)))
    place = {x: i for i, x in enumerate(names)}
    target = np.array([place[x] for x in labels], dtype=np.int64)
    rng = np.random.default_rng(seed)
    back = np.array([zlib.crc32(str(r).encode()) % 5 == 0 for r in (rows if rows is not None else range(len(texts)))], dtype=bool)
    ids: list[np.ndarray] = []
    weight: list[np.ndarray] = []
    met = np.zeros(1 << KNOWN_BITS, dtype=np.uint8)
    for a in range(0, len(texts), TEXTS):  # in steps: only the distinct buckets of each text stay in memory
        parts = subwords([t.lower() for t in texts[a : a + TEXTS]])
        for i in range(min(TEXTS, len(texts) - a)):
            value = np.concatenate([x[e[i] : e[i + 1]] for x, e in parts])
            found, count = np.unique((value >> BUCKET_SHIFT).astype(np.int32), return_counts=True)
            ids.append(found)
            weight.append((count / max(1, count.sum())).astype(np.float32))
            if not back[a + i]:
                fine = np.unique(value >> KNOWN_SHIFT)
                met[fine] = np.minimum(met[fine], 253) + 1
    known = met > 0
    embed = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    linear = np.zeros((size, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    usable = np.array([len(u) > 0 for u in ids], dtype=bool)
    fit, held = np.flatnonzero(usable & ~back), np.flatnonzero(usable & back)
    epochs = max(epochs, -(-least_steps // max(1, len(fit))))  # a small table is gone through more often
    done, total = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            step = rate * (1 - done / total)
            done += 1
            own, w = ids[i], weight[i]
            mean = w @ embed[own]
            z = mean @ linear + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            turn = linear @ p
            linear -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            embed[own] -= step * np.outer(w * gain, turn)
    few = len(names) <= size
    table = np.ascontiguousarray((embed @ linear if few else embed).T, dtype=np.float32)
    make = lambda **k: LanguageModel(names, table, None if few else linear, bias, known, **k)
    model = make(inside=np.array([30.0, 0, 0, 0]), temperature=1.0, threshold=0.0, missed=0.0, let_in=1.0)
    if not len(held):
        return model
    kept = [texts[i].lower() for i in held]
    noise = [corrupted(t, j % 4, rng) for j, t in enumerate(kept)]
    z, seen, counts = zip(*([np.concatenate(c) for c in zip(*(activations(model, x[a : a + TEXTS]) for a in range(0, len(x), TEXTS)))] for x in (kept, noise)))
    best = np.inf
    for t in np.geomspace(0.005, 20, 101):
        logp = z[0] / t - np.logaddexp.reduce(z[0] / t, axis=1, keepdims=True)
        right = logp[np.arange(len(held)), target[held]]
        loss = -(right + (logp.sum(axis=1) - right) / (len(held) + 2)).mean()  # targets a little below 1, so that few errors leave it finite
        if loss < best:
            best, temperature = loss, float(t)
    x = [evidence(s, n) for s, n in zip(seen, counts)]
    some = [n > 0 for n in counts]
    truth = np.concatenate([np.ones(some[0].sum()), np.zeros(some[1].sum())])
    inside = _logistic(np.concatenate([v[m] for v, m in zip(x, some)]), truth, np.ones(len(truth)))
    score = [np.exp(v / temperature - np.logaddexp.reduce(v / temperature, axis=1, keepdims=True)).max(axis=1) * _inside(inside, e) for v, e in zip(z, x)]
    least, most = np.quantile(score[0], miss, method="lower"), np.quantile(score[1], 1 - miss, method="higher")
    if most < least:  # where both sides lie apart, the threshold lies half-way in log odds
        odds = [math.log(max(v, 1e-12) / max(1 - v, 1e-12)) for v in (least, most)]
        least = 1 / (1 + math.exp(-sum(odds) / 2))
    threshold = float(least)
    return make(inside=inside, temperature=temperature, threshold=threshold, missed=float((score[0] < threshold).mean()), let_in=float((score[1] >= threshold).mean()))


def activations(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (lower-case) texts: the activations before the softmax, known subwords, all subwords."""
    mean = np.zeros((len(texts), len(model.table)))
    seen, count = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for value, edge in subwords(texts):
        some = np.flatnonzero(np.diff(edge))
        if not len(some):
            continue
        count += np.diff(edge)
        cuts = edge[:-1][some]
        seen[some] += np.add.reduceat(model.known[value >> KNOWN_SHIFT], cuts, dtype=np.int64)
        bucket = value >> BUCKET_SHIFT
        for k, column in enumerate(model.table):
            mean[some, k] += np.add.reduceat(column[bucket], cuts, dtype=np.float64)
    mean /= np.maximum(count, 1)[:, None]
    return (mean if model.linear is None else mean @ model.linear) + model.bias, seen, count


def predict(model: LanguageModel | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, calibrated scores and acceptance of whole texts."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    z, seen, count = activations(model, texts)
    z = z / model.temperature
    p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
    top = p.argmax(axis=1)
    score = np.clip(p[np.arange(len(texts)), top] * _inside(model.inside, evidence(seen, count)), 0.0, 1.0)
    label = [model.labels[k] for k in top]
    for i, text in enumerate(texts):
        if not has_letter(text):
            label[i], score[i] = UNKNOWN, 0.0
    return label, score, np.array([x != UNKNOWN for x in label], dtype=bool) & (score >= model.threshold)


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, per_label: int = 1500, crop: int = 2000, most_rows: int = 12_000) -> LanguageModel | None:
    """Train on at most most_rows hashed rows (per_label of each label, fewer if there are many labels; one of each at least) outside the held-out fold."""
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    each = min(per_label, max(1, most_rows // len(counts)))
    # from Arrow: a list of rows would start Python workers of another kind, which stay beside those of the steps to come
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "share": pa.array([min(1.0, 1.2 * each / r["count"]) for r in counts], pa.float64())}))
    draw = F.xxhash64("doc_id", F.length("text"))
    length = F.length("text")
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(length - crop, F.lit(0)) + 1).cast("int")  # copies give equal crops
    picked = (
        known.select("doc_id", "lang", "text")
        .join(F.broadcast(shares), "lang")
        .filter(F.pmod(draw, F.lit(1 << 20)) < F.col("share") * (1 << 20))
        .select("lang", F.substring("text", start, F.lit(crop)).alias("part"), draw.alias("draw"))
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("draw", "part")))
        .filter(F.col("place") <= each)  # of each label, so that no large one crowds out a small one
        .orderBy("draw", "lang", "part")
        .collect()
    )
    texts, labels, rows = [], [], []
    for i, row in enumerate(picked):
        texts += [row["part"], row["part"][: 20 + 13 * (i % 20)]]
        labels += [row["lang"]] * 2
        rows += [zlib.crc32(row["part"].encode("utf-8", "surrogatepass"))] * 2
    try:
        return train(texts, labels, rows)
    finally:  # the driver has other steps to run
        tidy()


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Predict the language of every whole text: SCHEMA. Only `text` is an input of the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, accepted = [], [], []
            for _, texts in text_steps(pc.utf8_lower(filled(batch.column(2))), WIDE_STEP_BYTES):
                label, score, yes = predict(sent.value, texts)
                labels += label
                scores.append(score)
                accepted.append(yes)
            score, yes = (np.concatenate(x) if x else np.empty(0) for x in (scores, accepted))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(yes.astype(bool), pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), SCHEMA)


def accepted_documents(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows whose language is recognised; the columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [predict(sent.value, texts)[2] for _, texts in text_steps(pc.utf8_lower(filled(batch.column(at))), WIDE_STEP_BYTES)]
            yield batch.filter(pa.array(np.concatenate(keep).astype(bool) if keep else np.empty(0, bool)))

    return docs.mapInArrow(tidied(run), docs.schema)
