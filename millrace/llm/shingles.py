"""Hashed words and shingles of whole Arrow columns, by array arithmetic.

No word becomes a Python object, so memory is a small multiple of CHUNK and of the longest
text, whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text hashed at a time.
CHUNK = 1 << 18
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: White space; every other byte's own number, the same for A-Z and a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M1)
BYTE[0x41:0x5B] = BYTE[0x61:0x7B]
POWER, INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _words(data: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of at most CHUNK + 1 bytes; none crosses a text's first byte."""
    space = SPACE[data]
    cut = space.copy()
    cut[:-1] = space[1:]
    cut[-1:] = True
    if first is not None:
        cut[first[first > 0] - 1] = True
    last = np.flatnonzero(cut & ~space)
    before = np.concatenate([[True], cut[:-1]])
    start = np.flatnonzero((before | np.concatenate([[True], space[:-1]])) & ~space)
    v = BYTE[data] * POWER[: len(data)]
    c = np.cumsum(v)
    h = (c[last] - c[start] + v[start]) * INVERSE[start]
    return mix(h + (last - start + 1).astype(np.uint64) * _M1), start


def long_text_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text of any length, piece by piece."""
    out, at = [], 0
    while at < len(data):
        piece = data[at : at + CHUNK + 1]
        if at + len(piece) < len(data):
            ends = np.flatnonzero(SPACE[piece])
            if not len(ends):  # one word above CHUNK: all of its kind come this way
                size = len(piece)
                while at + size < len(data) and not SPACE[data[at + size]]:
                    rest = np.flatnonzero(SPACE[data[at + size : at + size + CHUNK]])
                    size += int(rest[0]) if len(rest) else min(CHUNK, len(data) - at - size)
                out.append(np.array([xxhash.xxh3_64_intdigest(bytes(data[at : at + size]).lower())], np.uint64))
                at += size
                continue
            piece = piece[: ends[-1] + 1]
        elif len(piece) > CHUNK and not SPACE[piece].any():
            out.append(np.array([xxhash.xxh3_64_intdigest(bytes(piece).lower())], np.uint64))
            break
        out.append(_words(piece)[0])
        at += len(piece)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = mix(out * _M1 + h[k : len(h) - n + 1 + k])
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingles (int64) of each text, in runs of successive texts.

    A text of fewer than ``n`` words is one shingle; null and wordless texts have none.
    """
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(ends, ends[k] + CHUNK, "right")) - 1)
        piece = data[ends[k] : ends[upto]]
        if upto == k + 1 and len(piece) > CHUNK:
            h = long_text_words(piece)
            doc = np.zeros(len(h), np.int64)
        else:
            starts = ends[k:upto] - ends[k]
            h, at = _words(piece, starts) if len(piece) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            doc = np.searchsorted(starts, at, "right") - 1
        count = np.bincount(doc, minlength=upto - k)
        first = np.concatenate([[0], np.cumsum(count)])
        w = _windows(h, n)
        sets = []
        for i, c in enumerate(count):
            if c >= n:
                sets.append(np.unique(w[first[i] : first[i + 1] - n + 1].view(np.int64)))
            else:
                sets.append(_windows(h[first[i] : first[i + 1]], c).view(np.int64) if c else np.zeros(0, np.int64))
        yield sets
        k = upto
