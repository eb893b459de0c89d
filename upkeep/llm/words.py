"""Words of a text as 64-bit hashes, and hashes of runs of words, in numpy.

A word is a maximal run of bytes other than the six ASCII white-space
characters.  Hashes depend on the bytes alone, so they agree between
processes and machines.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2^64
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
_LIMIT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(U64)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        m = max(n, 2 * len(_POWERS["up"]), _LIMIT + 2)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, U64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _buffer_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a buffer of about ``_LIMIT`` bytes at most."""
    a = np.frombuffer(data, np.uint8)
    word = np.zeros(len(a) + 2, bool)
    np.logical_not(_SPACE[a], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64), start
    up, down = _powers(len(a))
    total = np.zeros(len(a) + 1, U64)
    np.cumsum(_BYTE[a] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def _long_words(data: bytes) -> np.ndarray:
    """The same for one text of any length: cut at white space; a word longer
    than the buffer gets a digest instead of the polynomial."""
    out, at = [], 0
    while at < len(data):
        end = at + _LIMIT
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            elif cut < 0:           # one word fills the buffer
                word = data[at:].split(None, 1)[0]
                end = at + len(word)
                if len(word) > _LIMIT:
                    out.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), "<u8"))
                    at = end
                    continue
            else:
                end = at + 1
        out.append(_buffer_words(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, U64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the number of words of each text."""
    if sum(map(len, texts)) + len(texts) > _LIMIT:
        each = [_long_words(t) if len(t) > _LIMIT else _buffer_words(t)[0] for t in texts]
        return (np.concatenate(each) if each else np.zeros(0, U64),
                np.array([len(x) for x in each], np.int64))
    hashes, start = _buffer_words(b"\n".join(texts))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, bounds)).astype(np.int64)


def run_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words inside one text.

    Returns the hashes, the position (in ``hashes``) of each run's first word,
    and the number of runs of each text.
    """
    runs = np.maximum(counts - n + 1, 0)
    if not runs.sum():
        return np.zeros(0, U64), np.zeros(0, np.int64), runs
    total = np.zeros(len(hashes) - n + 1, U64)
    for j in range(n):
        total *= U64(0xC2B2AE3D27D4EB4F)
        total += hashes[j:len(hashes) - n + 1 + j]
    ends = np.cumsum(counts)
    inside = np.ones(len(total), bool)
    for e in ends[:-1][counts[:-1] > 0] if len(ends) > 1 else ():
        inside[max(0, e - n + 1):e] = False
    inside[len(total):] = False
    first = np.flatnonzero(inside)
    # Texts shorter than a run have no window of their own: the loop above cleared theirs.
    return mix(total[first]), first, runs
