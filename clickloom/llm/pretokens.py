"""Pre-tokens of the public byte-level pattern, split by vectorised rules, and a cache of their ids.

`split` gives the matches of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

as spans of code points: runs of one class end at the next class; the last space character of a run of
white space goes to what follows; an apostrophe that begins a match may form a contraction. Equal pre-tokens
are encoded once: they are grouped by a 64-bit hash of their code points (long ones by themselves) whose base each worker
draws anew, so that no texts can be made to collide.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import STEP_BYTES, U64, mix, steps, text_steps

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
LONG = 64  # code points; longer pre-tokens are encoded by themselves
SPLIT_BYTES = STEP_BYTES // 2  # of text that is split at a time; its arrays are many times as large
ROUND_BYTES = 4 << 20  # of text whose new pre-tokens are encoded together
KEPT = 400_000  # encoded pre-tokens that a worker keeps
_BASE = int.from_bytes(os.urandom(8), "little") | 1
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n; kept up to a step's length."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, dtype=U64)
        powers[0] = 1
        made.append(np.cumprod(powers, dtype=U64))
    if n <= SPLIT_BYTES + 1:
        _POWERS[:] = made
    return made


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] that depend on the content of the span alone, within this process."""
    up, down = _powers(len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@lru_cache(None)
def classes() -> np.ndarray:
    """Class of every code point by the same library that defines the pattern."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for first in range(0, 0x110000, 0x10000):
        text = "".join(map(chr, range(first, first + 0x10000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[first + m.start() : first + m.end()] = kind
    return table


def split(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points and where pre-tokens start (with the end as last)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(code)
    if not n:
        return code, np.zeros(1, dtype=np.int64)
    kind = classes()[code]
    new = np.ones(n + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    # white space before something else: its last character starts a match; a space then takes in what follows
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE)) if n > 1 else np.empty(0, dtype=np.int64)
    new[before] = True
    new[before[code[before] == 0x20] + 1] = False
    # contractions at an apostrophe where a match starts
    marks = np.flatnonzero((code == 0x27) & new[:n])
    if len(marks):
        one = code[np.minimum(marks + 1, n - 1)]
        two = code[np.minimum(marks + 2, n - 1)]
        short = (marks + 1 < n) & np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        pair = (one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        pair &= marks + 2 < n
        new[marks[short] + 1] = False
        new[marks[short] + 2] = True
        new[marks[pair] + 1] = False
        new[marks[pair] + 3] = True
    return code, np.flatnonzero(new)


class IdCache:
    """Ids of pre-tokens by hash, kept between batches as sorted arrays; it starts anew when it is full."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first = np.empty(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.count, self.pool, self.used = np.empty(0, dtype=np.int64), np.empty(1 << 20, dtype=np.uint32), 0

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        need = self.used + int(count.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(need, len(self.pool)), dtype=np.uint32)])
        first = self.used + np.cumsum(count) - count
        self.pool[self.used : need] = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=need - self.used)
        self.used = need
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.first, self.count = np.insert(self.first, at, first[order]), np.insert(self.count, at, count[order])

    def _read(self, texts: list[str], fresh: dict[int, str]) -> tuple:
        """Split one step: its pre-tokens' hashes, its long ones, its pre-tokens per text; new ones go to `fresh`."""
        pieces = [split(t) for t in texts]
        code = np.concatenate([c for c, _ in pieces])
        base = np.cumsum([0, *(len(c) for c, _ in pieces)])
        starts = np.concatenate([b[:-1] + x for (_, b), x in zip(pieces, base)])
        stops = np.concatenate([b[1:] + x for (_, b), x in zip(pieces, base)])
        hashes = span_hashes(code, starts, stops)
        raw = lambda i: code[starts[i] : stops[i]].tobytes().decode("utf-32-le", "surrogatepass")
        long = np.flatnonzero(stops - starts > LONG)
        long_texts = [raw(i) for i in long]
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != unique if len(self.hashes) else np.ones(len(unique), dtype=bool)
        new &= stops[where] - starts[where] <= LONG
        for h, i in zip(unique[new].tolist(), where[new].tolist()):
            if h not in fresh:
                fresh[h] = raw(i)
        return unique, back.astype(np.int32), long, long_texts, np.cumsum([0, *(len(b) - 1 for _, b in pieces)])

    def _write(self, read: tuple) -> tuple[np.ndarray, np.ndarray]:
        unique, back, long, long_texts, per_text = read
        place = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        first = self.first[place][back] if len(self.hashes) else np.zeros(len(back), dtype=np.int64)
        count = self.count[place][back] if len(self.hashes) else np.zeros(len(back), dtype=np.int64)
        pool = self.pool
        if len(long):  # long pre-tokens come after the kept ids, for this step only
            found = self.encode(long_texts)
            count[long] = [len(x) for x in found]
            first[long] = self.used + np.cumsum(count[long]) - count[long]
            pool = np.concatenate([pool[: self.used], np.fromiter((i for x in found for i in x), dtype=np.uint32)])
        total = np.cumsum(count)
        source = np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)
        return pool[source], np.concatenate([[0], total])[per_text]

    def batches(self, column: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """(first row, texts, all their ids in a row, where each text's ids start, with the end as last) in steps.

        The new pre-tokens of up to ROUND_BYTES of text are encoded together.
        """
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
        for a, b in steps(lengths, ROUND_BYTES):
            if len(self.hashes) > KEPT:
                self.clear()
            fresh: dict[int, str] = {}
            read = [(a + first, texts, self._read(texts, fresh)) for first, texts in text_steps(column.slice(a, b - a), SPLIT_BYTES)]
            if fresh:
                self._add(np.fromiter(fresh, dtype=U64, count=len(fresh)), self.encode(list(fresh.values())))
            while read:
                first, texts, found = read.pop(0)
                yield first, texts, *self._write(found)
