"""Keyed hashes of the words of whole texts, by array operations."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .common import _LOWER, _SPACE, STEP_BYTES, U64, mix

END = (1 << 62) - 1  # the key of a text's end
LONGEST = 256  # bytes of a word that is not hashed by digest
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)  # so many of eight bytes


@lru_cache(maxsize=8)
def _starts(seed: int) -> np.ndarray:
    """Where the hash of a word of each length begins."""
    return mix(mix(np.array([seed], dtype=U64)) + np.arange(LONGEST + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _digest(word: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little") >> 2


def _hashed(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """62-bit keys of the words in some bytes, and where they start: eight bytes after eight bytes, scrambled; long words by digest."""
    padded = b" " + data + b" " * 8
    x = np.frombuffer(padded, dtype=np.uint8)
    blank = (x == 32) | (x - np.uint8(9) <= 4)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, offset=0, strides=(1,))  # from each byte on
    sums = _starts(seed)[np.minimum(lengths, LONGEST)]
    if len(start):
        sums = mix(sums ^ (eights[start + 1] & _BYTES[np.minimum(lengths, 8)]))
    own = np.flatnonzero((lengths > 8) & (lengths <= LONGEST))
    done = 8
    while len(own):
        sums[own] = mix(sums[own] ^ (eights[start[own] + done + 1] & _BYTES[np.minimum(lengths[own] - done, 8)]))
        done += 8
        own = own[lengths[own] > done]
    keys = (sums >> U64(2)).astype(np.int64)
    for i in np.flatnonzero(lengths > LONGEST).tolist():
        keys[i] = _digest(data[start[i] : start[i] + lengths[i]], seed)
    return keys, start


def _long_keys(data: bytes, seed: int, step: int) -> np.ndarray:
    """Keys of the words of a long text, part by part."""
    out, a = [np.empty(0, np.int64)], 0
    while a < len(data):
        m = _SPACE.search(data, a + step)
        b = m.start() if m else len(data)
        if b - a <= 2 * step:
            out.append(_hashed(data[a:b], seed)[0])
        else:  # a very long word
            words = data[a:b].split()
            short = np.array([len(w) <= LONGEST for w in words])
            keys = np.array([0 if s else _digest(w, seed) for w, s in zip(words, short)], dtype=np.int64)
            keys[short] = _hashed(b" ".join(w for w, s in zip(words, short) if s), seed)[0]
            out.append(keys)
        a = b
    return np.concatenate(out)


def text_keys(texts: list[str], seed: int, step: int = STEP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts one after the other, and the number of tokens of each: its words and the end. More than two steps of text are gone through part by part."""
    parts = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    if lengths.sum() > 2 * step:
        found = [_long_keys(p, seed, step) for p in parts]
        keys, counts = np.concatenate(found), np.array(list(map(len, found)))
    else:
        keys, start = _hashed(b" ".join(parts), seed)
        counts = np.diff(np.searchsorted(start, np.concatenate([np.cumsum(lengths + 1) - lengths - 1, [lengths.sum() + len(parts)]])))
    return np.insert(keys, np.cumsum(counts), END), counts + 1
