"""Vectorised word handling for Arrow batches of texts inside tasks.

Words are runs of bytes other than ASCII white space (a byte of a multi-byte UTF-8 character is
never one of those, so bytes and characters give the same words).  All functions work on whole
batches with numpy; none loops over words in Python but for words of over 256 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LONG = 256
U = np.uint64


def text_bytes(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch's texts, end to end, and the n + 1 offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), off - off[0]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (n + 1 numbers)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_WS[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < len(data))]  # words end where a text ends
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def eights(data: np.ndarray) -> np.ndarray:
    """Little-endian unsigned 64-bit numbers at every byte offset (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; spans of up to 8 bytes and equal length never collide."""
    if not len(starts):
        return np.zeros(0, U)
    at, n = eights(data), ends - starts
    h = mix((at[starts] & _MASK[np.minimum(n, 8)]) + n.astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    todo, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(todo):
        lane = at[starts[todo] + k] & _MASK[np.minimum(n[todo] - k, 8)]
        h[todo] = mix((h[todo] ^ lane) * U(0x9FB21C651E98DF25) + U(k))
        k += 8
        todo = todo[n[todo] > k]
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed & 0xFFFFFFFF)
    return h


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with their words joined by one space, end to end: bytes, word starts, word ends.

    There is a space after the last word of a text as well, so word i + 1 always starts at
    the end of word i plus 1.
    """
    n = ends - starts
    new_start = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(n) else n
    total = int((n + 1).sum()) if len(n) else 0
    keep = np.zeros(len(data) + 2, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    body = data[np.cumsum(keep[:len(data)], dtype=np.int8).astype(bool)] if len(data) else data
    out = np.empty(total, np.uint8)
    space = np.zeros(total, bool)
    if total:
        space[new_start + n] = True
        out[space] = 32
        out[~space] = body
    return out, new_start, new_start + n


# --- XXH64 over many spans at once (the published algorithm; primes are fixed values) ---
P1, P2, P3, P4, P5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_same_length(at: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    s, k = U(seed), 0
    if length >= 32:
        with np.errstate(over="ignore"):
            acc = [np.full(len(starts), v, U) for v in (s + P1 + P2, s + P2, s, s - P1)]
        while k + 32 <= length:
            acc = [_round(a, at[starts + (k + 8 * i)]) for i, a in enumerate(acc)]
            k += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros_like(a), a)) * P1 + P4
    else:
        with np.errstate(over="ignore"):
            h = np.full(len(starts), s + P5, U)
    h += U(length)
    while k + 8 <= length:
        h = _rotl(h ^ _round(np.zeros_like(h), at[starts + k]), 27) * P1 + P4
        k += 8
    if k + 4 <= length:
        h = _rotl(h ^ ((at[starts + k] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
        k += 4
    while k < length:
        h = _rotl(h ^ ((at[starts + k] & U(0xFF)) * P5), 11) * P1
        k += 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of byte spans: spans of one length are hashed together."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    at, n = eights(data), ends - starts
    short = np.flatnonzero(n <= LONG)
    order = short[np.argsort(n[short].astype(np.uint16), kind="stable")]
    lengths, begin = np.unique(n[order], return_index=True)
    for length, a, b in zip(lengths, begin, [*begin[1:], len(order)], strict=True):
        for c in range(a, b, 1 << 16):  # in pieces that stay in the cache
            ids = order[c:min(b, c + (1 << 16))]
            out[ids] = _xxh64_same_length(at, starts[ids], int(length), seed)
    for i in np.flatnonzero(n > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    return out
