"""Vectorised kernels over blocks of UTF-8 texts."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Odd base of the polynomial over bytes, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text: digits, a-z, all beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z and turns all but word bytes into spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if WORD[b] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lower-cased text."""
    return text.translate(FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept per process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[0] = 0, so that (s[e] - s[b]) * BASE**-b identifies data[b:e]."""
    s = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_byte_codes()[data] * powers(len(data))[0], out=s[1:])
    return s


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One lower-cased buffer of all texts, a space before, between and after them; where each text starts."""
    data = np.frombuffer((b" " + b" ".join(docs) + b" ").lower(), dtype=np.uint8)
    lengths = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    return data, np.cumsum(np.concatenate(([1], lengths[:-1] + 1))) if len(docs) else np.zeros(0, dtype=np.int64)


def word_bounds(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of table's bytes; data begins and ends outside of them."""
    inside = table[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    s = prefix_hash(data)
    return mix((s[ends] - s[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(U))


def shingle_sets(docs: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k consecutive words `[^\x20\x09-\x0D]+`.

    A text of fewer words, but not none, has one hash of its whole sequence; one
    without words has none. Hashes have 64 bits.
    """
    data, at = joined(docs)
    starts, ends = word_bounds(data, NOT_SPACE)
    w = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    last = np.append(first[1:], len(starts))
    h = np.zeros(max(0, len(w) - k + 1), dtype=U)
    for i in range(k):
        h += w[i : i + len(h)] * U(pow(BASE, 2 * i + 1, 2**64))
    h = mix(h)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            whole = np.zeros(1, dtype=U) + U(b - a)
            for i in range(a, b):
                whole = mix(whole * U(BASE) + w[i])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=U))
    return out
