"""Language-model scores from an n-gram trie in Elias-Fano levels.

Level 1 holds the words by hash, level k the k-grams, each under the place of its first k - 1 words. In level 2 a word is its number; from level 3 on it
is its place among the successors of the word before it, which is a small number. So an entry's key is (place of its context) * stride + (relative successor),
the keys of a level ascend, and a search for the successor of a context is one search in a monotone sequence. Beside the keys stand 16-bit
logarithms of relative frequencies and of each context's share of mass for unseen successors, and the monotone pointers to the successors.

Smoothing is Witten-Bell's: p(w | h) = (1 - u(h)) c(hw) / c(h) + u(h) p(w | shorter h), where u(h) = T / (c(h) + T) with T different successors of h;
below the words stands one equal share for each known word and for all unknown ones together. A start mark stands before each text.

The trie is built level by level. Tasks count n-grams of about STEP_TOKENS tokens and send the sorted keys as differences, parted by an estimate of their rank
(the mass of all contexts before, and within a context by the word's number), so that a shard is a range of keys with about `block_tokens` tokens at most, also within
a very common context. Each shard becomes one file of a level, in a folder that driver and executors share: the cluster's checkpoint folder, whose files are mapped where it is mounted and
read whole where it is a remote store. Files get their final name when they are complete, so a task that runs again replaces a file by its
like. Later levels and the scores look n-grams up in the files; nothing is joined. The driver holds one line for each file. All n-grams count: nothing is pruned, so what is gathered grows
with the corpus.

Defined cases: null is the empty text, which has the end token alone. Words are runs without ASCII white space, A-Z lower-cased; two words count as one if 62 bits of their
hashes agree, which are keyed by a random seed for each trie. Rows without an id are learned from; repeated rows count each time, as in the contract's counts. Very long texts are scored whole. Without anything to learn from, each token has
probability 1. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import STEP_BYTES, filled, shared_folder, ship, shuffles_dropped, text_steps, tidied
from .elias_fano import Monotone, from_buffer, packed, to_bytes

STEP_TOKENS = 1 << 20
BLOCK_TOKENS = 2 << 20
START = 1 << 62  # the key of the start mark, after those of all words
SCALE = 2048  # steps of a 16-bit logarithm in a power of ten
SHARED = "shard int, keys binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- files -----------------------------------------------------------------------------------------------------------


def _place(path: str) -> tuple[pfs.FileSystem, str]:
    return (pfs.LocalFileSystem(), path) if path.startswith("/") else pfs.FileSystem.from_uri(path)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write a file under another name first; it gets its own when it is complete."""
    fs, name = _place(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        for part in to_bytes(arrays):
            f.write(part)
    fs.move(draft, name)


@lru_cache(maxsize=4096)
def load(path: str) -> dict[str, np.ndarray]:
    """A file's arrays: mapped where it is local, else read."""
    fs, name = _place(path)
    if isinstance(fs, pfs.LocalFileSystem):
        return from_buffer(np.memmap(name, dtype=np.uint8, mode="r"))
    with fs.open_input_stream(name) as f:
        return from_buffer(np.frombuffer(f.read(), dtype=np.uint8))


def logs(p: np.ndarray) -> np.ndarray:
    """Shares as 16-bit logarithms; 0 as the smallest."""
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * SCALE), 0, 65535).astype(np.uint16)


#: What each logarithm stands for.
SHARES = 10.0 ** (np.arange(65536) / -SCALE)


# --- levels ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """The files of a level in order of their keys: shard, first key, entries before, tokens before (each with an end more)."""

    folder: str
    shards: np.ndarray
    first: np.ndarray
    entries: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, folder: str, rows: list) -> "Level":
        rows = sorted(rows, key=lambda r: r["first"])
        column = lambda name: np.array([r[name] for r in rows], dtype=np.int64)
        before = lambda name: np.concatenate([[0], np.cumsum(column(name))]).astype(np.int64)
        return cls(folder, column("shard"), column("first"), before("entries"), before("tokens"))

    def file(self, kind: str, block: int) -> dict[str, np.ndarray]:
        return load(self.path(kind, block))

    def path(self, kind: str, block: int) -> str:
        return f"{self.folder}/{kind}-{self.shards[block]:08d}"

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of ascending keys, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        cuts = np.append(np.searchsorted(keys, self.first), len(keys))
        for block in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[block], cuts[block + 1])
            found = Monotone(self.file("keys", block)).find(keys[own])
            out[own] = np.where(found >= 0, found + self.entries[block], -1)
        return out

    def take(self, places: np.ndarray, read) -> np.ndarray:
        """read(block, places in it) for ascending places, so that each block has a slice of them: however many blocks there are, each place is seen once."""
        if not len(places):
            return np.empty(0, dtype=np.int64)
        cuts = np.searchsorted(places, self.entries)
        return np.concatenate([read(block, places[cuts[block] : cuts[block + 1]] - self.entries[block]) for block in np.flatnonzero(np.diff(cuts)).tolist()])

    def shares(self, places: np.ndarray) -> np.ndarray:
        """Relative frequencies after their contexts."""
        return SHARES[self.take(places, lambda b, i: self.file("keys", b)["share"][i])]

    def unseen(self, places: np.ndarray) -> np.ndarray:
        """Of contexts: the mass of successors that have not been seen."""
        return SHARES[self.take(places, lambda b, i: self.file("weights", b)["unseen"][i])]

    def sums(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all entries before, and those of the entry."""
        sums = lambda b: self.file("sums", b)["sum"]
        return self.take(places, lambda b, i: sums(b)[i] + self.tokens[b]), self.take(places, lambda b, i: sums(b)[i + 1] - sums(b)[i])

    def pointers(self, places: np.ndarray) -> np.ndarray:
        """Of contexts: the place of the first successor in the next level."""
        return self.take(places, lambda b, i: Monotone(self.file("weights", b)).at(i))


@dataclass(frozen=True)
class Trie:
    """Levels and totals: n tokens, v words; the start mark has number v, unknown words v + 1. The seed keys the hashes of words."""

    levels: tuple[Level, ...] = ()
    n: int = 0
    v: int = 0
    seed: int = 0

    @property
    def stride(self) -> int:
        return self.v + 2


# --- words -----------------------------------------------------------------------------------------------------------


def text_keys(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts one after the other, and the number of tokens of each: its words and the end."""
    return words.text_keys(texts, seed, STEP_BYTES)


@dataclass(frozen=True)
class Tokens:
    """Tokens by their numbers: `ids`; `words` are the different ones in ascending order (the unknown ones apart), which `back` deals to the tokens. `heads` are the first tokens of texts."""

    ids: np.ndarray
    words: np.ndarray
    back: np.ndarray
    heads: np.ndarray
    known: np.ndarray  # places in `words`


def numbers(trie: Trie, keys: np.ndarray, sizes: np.ndarray) -> Tokens:
    """The tokens of texts of some sizes."""
    different, back = np.unique(keys, return_inverse=True)
    found = trie.levels[0].find(different) if trie.levels else np.full(len(different), -1)
    words = np.where(found < 0, trie.v + 1, found)
    return Tokens(words[back], words, back, np.cumsum(sizes) - sizes, np.flatnonzero(found >= 0))


def keys_of(trie: Trie, k: int, tokens: Tokens, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose context of k - 1 words is known, and the keys of their k-grams.

    `place` has the places of the (k - 1)-grams that end at each token (-1: none).
    """
    ids, heads = tokens.ids, tokens.heads
    if k == 2:
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[heads] = trie.v
        at = np.flatnonzero(before <= trie.v)
        return at, before[at] * trie.stride + ids[at]
    context = np.empty_like(place)
    context[1:] = place[:-1]
    context[heads] = -1
    if k > 3:  # the relative successor is always that of a pair
        place = places(trie, 2, tokens)
    at = np.flatnonzero(context >= 0)
    place = place[at]
    firsts = np.zeros(len(tokens.words), dtype=np.int64)  # of the successors of each word
    firsts[tokens.known] = trie.levels[0].pointers(tokens.words[tokens.known])
    successor = np.where(place >= 0, place - firsts[tokens.back[at - 1]], trie.v + 1)  # the last number is no one's
    return at, context[at] * trie.stride + successor


def places(trie: Trie, k: int, tokens: Tokens, visit=None) -> np.ndarray:
    """The place of the k-gram that ends at each token, -1 where the trie has none. `visit` sees each level's different keys."""
    place = None
    for level in range(2, k + 1):
        at, key = keys_of(trie, level, tokens, place)
        different, back = np.unique(key, return_inverse=True)
        found = trie.levels[level - 1].find(different)
        place = np.full(len(tokens.ids), -1, dtype=np.int64)
        place[at] = found[back]
        if visit:
            visit(level, at, back, different // trie.stride, found)
    return place


def _mapped(run):
    """`run`, tidied, with the maps of files closed after each partition, so that a deleted file takes no room."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from tidied(run)(batches)
        finally:
            load.cache_clear()

    return whole


def _texts(batches: Iterator[pa.RecordBatch], column: int, seed: int):
    """(other columns, keys, tokens of each text) of about STEP_TOKENS tokens, or of one text."""
    rows, keys, sizes, n = [], [], [], 0
    for batch in batches:
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != column]
        for first, texts in text_steps(filled(batch.column(column))):
            found, counts = text_keys(texts, seed)
            rows += [tuple(c[first + i] for c in others) for i in range(len(texts))]
            keys.append(found)
            sizes.append(counts)
            n += len(found)
            if n >= STEP_TOKENS:
                yield rows, np.concatenate(keys), np.concatenate(sizes)
                rows, keys, sizes, n = [], [], [], 0
    if rows:
        yield rows, np.concatenate(keys), np.concatenate(sizes)


# --- learning --------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first all lowest bytes, and so on; what the shuffle compresses well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts[order], first)


def _sent(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """Ascending keys with their shards (that do not descend), a row for each shard."""
    cuts = [*np.flatnonzero(np.diff(shards, prepend=-1)).tolist(), len(keys)]
    parts = [(int(shards[a]), _planes(np.diff(keys[a:b], prepend=0)), _planes(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["shard", "keys", "counts"])


def _merged(sent: DataFrame, folder: str, share_of=None, stride: int = 1, last: bool = False) -> list:
    """Merge what was sent, shard by shard, into files; a row for each file. Nothing asks for the sums of the last level of several."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([_unplaned(x).cumsum() for x in group["keys"]])
        keys, counts = summed(keys, np.concatenate([_unplaned(x) for x in group["counts"]]))
        shard = int(group["shard"].iloc[0])
        arrays = packed(keys)
        if share_of:
            arrays["share"] = logs(counts / share_of(keys // stride))
        save(f"{folder}/keys-{shard:08d}", arrays)
        if not last:
            save(f"{folder}/sums-{shard:08d}", {"sum": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)})
        load.cache_clear()
        return pd.DataFrame({"shard": [shard], "first": [keys[0]], "entries": [len(keys)], "tokens": [counts.sum()], "last": [keys[-1]], "last_count": [counts[-1]]})

    with shuffles_dropped(sent.sparkSession):
        return sent.groupBy("shard").applyInPandas(run, "shard int, first long, entries long, tokens long, last long, last_count long").collect()


def _words(docs: DataFrame, folder: str, block_tokens: int) -> Trie:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, (size // (4 * block_tokens)).bit_length())

    seed = secrets.randbits(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, np.int64)] * 2
        sent = lambda: _sent(keys, counts, np.minimum(keys >> (62 - bits), (1 << bits) - 1))
        for rows, found, _ in _texts(batches, 0, seed):
            found, n = np.unique(found, return_counts=True)
            keys, counts = summed(np.concatenate([keys, found, [START]]), np.concatenate([counts, n, [len(rows)]]))
            if len(keys) > STEP_TOKENS:
                yield sent()
                keys, counts = [np.empty(0, np.int64)] * 2
        if len(keys):
            yield sent()

    rows = _merged(docs.select("text").mapInArrow(_mapped(run), SHARED), folder)
    texts = sum(r["last_count"] for r in rows if r["last"] == START)
    return Trie((Level.of(folder, rows),), sum(r["tokens"] for r in rows) - texts, sum(r["entries"] for r in rows) - 1, seed)


def _next_level(docs: DataFrame, trie: Trie, folder: str, block_tokens: int, last: bool) -> Trie:
    k = len(trie.levels) + 1
    above = trie.levels[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, sizes in _texts(batches, 0, trie.seed):
            tokens = numbers(trie, found, sizes)
            _, key = keys_of(trie, k, tokens, places(trie, k - 1, tokens) if k > 2 else None)
            if not len(key):
                continue
            keys, counts = np.unique(key, return_counts=True)
            context = keys // trie.stride
            before, inside = above.sums(context)
            rank = before + inside * ((keys - context * trie.stride) / trie.stride)
            yield _sent(keys, counts.astype(np.int64), np.maximum.accumulate((rank // block_tokens).astype(np.int64)))

    rows = _merged(docs.select("text").mapInArrow(_mapped(run), SHARED), folder, lambda context: above.sums(context)[1], trie.stride, last)
    grown = replace(trie, levels=(*trie.levels, Level.of(folder, rows)))
    _weigh(docs, grown)
    return grown


def _weigh(docs: DataFrame, trie: Trie) -> None:
    """Pointers and unseen mass of the contexts in the last level but one, file by file."""
    above, level = trie.levels[-2:]

    def one(block: int) -> None:
        a, b = int(above.entries[block]), int(above.entries[block + 1])
        own = np.zeros(b - a, dtype=np.int64)
        low, high = (int(np.searchsorted(level.first, x * trie.stride, side="right")) for x in (a, b))
        start = None
        for i in range(max(0, low - 1), min(high, len(level.first))):
            context = Monotone(level.file("keys", i)).values() // trie.stride
            x, y = np.searchsorted(context, [a, b])
            if start is None and x < len(context):
                start = int(level.entries[i]) + int(x)
            own += np.bincount(context[x:y] - a, minlength=b - a)
        tokens = np.diff(above.file("sums", block)["sum"])
        start = int(level.entries[-1]) if start is None else start
        arrays = packed(start + np.concatenate([[0], np.cumsum(own)]))
        arrays["unseen"] = logs(own / np.maximum(tokens + own, 1))
        save(above.path("weights", block), arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                one(block)
            yield batch

    n = len(above.shards)
    docs.sparkSession.range(0, n, 1, n).mapInArrow(_mapped(run), "id long").count()


def learn(docs: DataFrame, order: int = 2, block_tokens: int = BLOCK_TOKENS) -> Trie:
    """The trie of n-grams up to `order` of all texts. Its files stay until `release`."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"))
    root = shared_folder(spark, "trie")
    trie = _words(docs, f"{root}/1", block_tokens)
    if not trie.n:
        return Trie()
    for k in range(2, order + 1):
        trie = _next_level(docs, trie, f"{root}/{k}", block_tokens, k == order)
    return trie


# --- scores ----------------------------------------------------------------------------------------------------------


def probabilities(trie: Trie, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of some texts: how often it has been learned, and its probability after the words before it."""
    if not trie.levels:
        return np.zeros(len(keys), dtype=np.int64), np.ones(len(keys))
    tokens = numbers(trie, keys, sizes)
    count = np.zeros(len(tokens.words), dtype=np.int64)
    count[tokens.known] = trie.levels[0].sums(tokens.words[tokens.known])[1]
    count = count[tokens.back]
    p = (count + trie.v / (trie.v + 1)) / (trie.n + trie.v)

    def visit(level: int, at: np.ndarray, back: np.ndarray, context: np.ndarray, found: np.ndarray) -> None:
        unseen, share = trie.levels[level - 2].unseen(context), np.zeros(len(found))
        some = np.flatnonzero(found >= 0)
        share[some] = trie.levels[level - 1].shares(found[some])
        p[at] = ((1 - unseen) * share)[back] + unseen[back] * p[at]

    places(trie, len(trie.levels), tokens, visit)
    return count, p


def scored(docs: DataFrame, trie: Trie, held_out=None) -> DataFrame:
    """Counts and scores of all whole texts: SCORES. Tokens that the trie does not know count into base scores with 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys, sizes in _texts(batches, 2, trie.seed):
            count, p = probabilities(trie, keys, sizes)
            heads = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, heads)
            ids, held = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(held, pa.bool_()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(total((count > 0).astype(np.int64))),
                    pa.array(np.full(len(sizes), trie.n, dtype=np.int64)),
                    pa.array(total(np.log10((count + 1) / (trie.n + trie.v + 1)))),
                    pa.array(total(np.log10(p))),
                ],
                names=[x.split()[0] for x in SCORES.split(", ")],
            )

    held_out = F.lit(None).cast("boolean") if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mapped(run), SCORES)


def fold(id_col: str = "doc_id", of: int = 7, out: int = 2):
    """Whether a row is held out; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == out, F.lit(False))


def held_out_scores(docs: DataFrame, order: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores of all texts under a trie of those that are not held out."""
    return scored(docs, learn(docs.filter(~fold()), order, block_tokens), fold())
