"""Monotone sequences of whole numbers in Elias-Fano code, in chunks that each have their own width.

Of the numbers of a chunk, less its first one, the low bits stand in a fixed width side by side; the high bits are a unary bit vector of
two bits a number at most: number i with high part h sets bit h + i. The first numbers of the chunks are kept as they are, so that a
search bisects those and then looks into two words. All operations take arrays of places or keys at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

CHUNK = 64  # numbers; their 2 * CHUNK high bits are two words
WALK = 4  # numbers of one high part that a search looks at one by one
STEP = 1 << 14  # places or keys at a time, so that the work stays in the processor's cache
U64 = np.uint64
_ONE, _HALVES = U64(1), [(U64(w), U64((1 << w) - 1)) for w in (32, 16, 8)]
#: The place of bit number k that is set in a byte, at byte * 8 + k; 0 where there are fewer.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], dtype=np.uint8).ravel()


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of bit number k that is set in each row of two words."""
    inside = np.bitwise_count(words[:, 0])
    go = k >= inside
    word = np.where(go, words[:, 1], words[:, 0])
    rest, place = k.astype(np.uint8) - inside * go, go * np.uint8(64)  # all of these fit into bytes
    for width, mask in _HALVES:
        inside = np.bitwise_count(word & mask)
        go = rest >= inside
        rest -= inside * go
        word = np.where(go, word >> width, word)
        place += go * np.uint8(width)
    return (place + _IN_BYTE[((word & U64(255)) << U64(3)).astype(np.int64) + rest]).astype(np.int64)


def packed(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a non-descending sequence."""
    n = len(values)
    chunks = -(-n // CHUNK)
    v = np.concatenate([values, np.repeat(values[-1:], chunks * CHUNK - n)]).astype(np.int64).reshape(chunks, CHUNK)
    first = v[:, 0].copy()
    rest = v - first[:, None]
    width = np.zeros(chunks, dtype=np.int64)
    while (wide := (rest[:, -1] >> width) >= CHUNK).any():
        width += wide
    bits = np.zeros((chunks, 2 * CHUNK), dtype=np.uint8)
    np.put_along_axis(bits, (rest >> width[:, None]) + np.arange(CHUNK), 1, axis=1)
    high = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    start = np.concatenate([[0], np.cumsum(width)])
    low = np.zeros(start[-1] + 1, dtype="<u8")
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        x = (rest[own] & ((1 << w) - 1)).astype(U64)
        words = np.zeros((len(own), w + 1), dtype=U64)
        for i in range(CHUNK):
            at, shift = divmod(i * w, 64)
            words[:, at] |= x[:, i] << U64(shift)
            if shift + w > 64:
                words[:, at + 1] |= x[:, i] >> U64(64 - shift)
        low[start[own][:, None] + np.arange(w)] = words[:, :-1]
    return {"n": np.array([n]), "first": first, "start": start, "high": high, "low": low}


class Monotone:
    """A packed sequence. Its arrays may be views of a mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n = int(arrays["n"][0])
        self.first, self.start, self.low = arrays["first"], arrays["start"], arrays["low"]
        self.high = arrays["high"].reshape(-1, 2)

    def _width(self, chunk: np.ndarray) -> np.ndarray:
        return self.start[chunk + 1] - self.start[chunk]

    def _low(self, chunk: np.ndarray, i: np.ndarray, width: np.ndarray) -> np.ndarray:
        bit = i * width
        at, shift = self.start[chunk] + (bit >> 6), (bit & 63).astype(U64)
        after = self.low[np.minimum(at + 1, len(self.low) - 1)]
        value = (self.low[at] >> shift) | ((after << _ONE) << (U64(63) - shift))
        return (value & ((_ONE << width.astype(U64)) - _ONE)).astype(np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        return np.concatenate([np.empty(0, np.int64), *[self._at(places[a : a + STEP]) for a in range(0, len(places), STEP)]])

    def _at(self, places: np.ndarray) -> np.ndarray:
        chunk, i = places // CHUNK, places % CHUNK
        width = self._width(chunk)
        place = _select(self.high[chunk], i)
        return self.first[chunk] + (((place - i) << width) | self._low(chunk, i, width))

    def values(self) -> np.ndarray:
        """All numbers."""
        return self.at(np.arange(self.n))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in an ascending sequence without repeats; -1 where it is not in."""
        return np.concatenate([np.empty(0, np.int64), *[self._find(keys[a : a + STEP]) for a in range(0, len(keys), STEP)]])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        if not self.n:
            return out
        chunk = np.searchsorted(self.first, keys, side="right") - 1
        rest = keys - self.first[np.maximum(chunk, 0)]
        width = self._width(np.maximum(chunk, 0))
        some = np.flatnonzero((chunk >= 0) & ((rest >> width) < CHUNK))
        chunk, rest, width = chunk[some], rest[some], width[some]
        bucket, target = rest >> width, rest & ((1 << width) - 1)
        zeros = ~self.high[chunk]
        i = _select(zeros, bucket) - bucket - 1  # the last number that has no larger high part, and its bit if it has this one
        bit = i + bucket
        open_ = np.arange(len(chunk))
        for _ in range(WALK):  # most high parts have few numbers
            open_ = open_[bit[open_] >= 0]
            open_ = open_[(self.high[chunk[open_], bit[open_] >> 6] >> (bit[open_] & 63).astype(U64)) & _ONE == 1]
            value = self._low(chunk[open_], i[open_], width[open_])
            hit = open_[value == target[open_]]
            out[some[hit]] = np.minimum(chunk[hit] * CHUNK + i[hit], self.n - 1)  # the last number fills its chunk
            open_ = open_[value > target[open_]]
            i[open_] -= 1
            bit[open_] -= 1
        if not len(open_):
            return out
        some, chunk, width, bucket, target, high = some[open_], chunk[open_], width[open_], bucket[open_], target[open_], i[open_] + 1
        low = np.where(bucket > 0, _select(zeros[open_], np.maximum(bucket - 1, 0)) - np.maximum(bucket - 1, 0), 0)
        end = high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):  # the successor of the low part
            middle = (low[open_] + high[open_]) // 2
            less = self._low(chunk[open_], middle, width[open_]) < target[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        inside = np.flatnonzero(low < end)
        inside = inside[self._low(chunk[inside], low[inside], width[inside]) == target[inside]]
        out[some[inside]] = chunk[inside] * CHUNK + low[inside]
        return out


def to_bytes(arrays: dict[str, np.ndarray]) -> Iterable[bytes]:
    """A file of named arrays, each at a multiple of 64 bytes after the head."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    yield len(text).to_bytes(8, "little") + text
    for a in arrays.values():
        yield a.tobytes() + bytes(-a.nbytes % 64)


def from_buffer(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of such a file (bytes, mapped or read) as views."""
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {name: np.frombuffer(data, dtype=kind, count=n, offset=8 + size + at) for name, (kind, n, at) in head.items()}
