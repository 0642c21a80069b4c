"""Sorted hash arrays in the shared folder, memory-mapped by the tasks that look keys up.

A table of unsigned 64-bit keys with values is kept as one pair of files per range of keys.
Tasks count keys on their own, send every range one packed blob, and a task per range merges
the blobs and writes its files (under another name first, so that a repeated or speculative
attempt replaces them whole).  Nothing of it passes through the driver but one row per range.
"""

from __future__ import annotations

import os
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

from ..session import note_landed, shared_path

U = np.uint64


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder for such files.  Memory maps need a file system path, so the shared folder must be a mounted one."""
    url = urlsplit(shared_path(spark, name, unique=True))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {url.scheme}://")
    note_landed(url.path)
    return url.path


def count_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts (1 each if not given)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(keys) else counts


class Counter:
    """Counts keys in bounded memory: what exceeds the bound is given out and counted anew."""

    def __init__(self, n_ranges: int, key_bits: int = 64, most: int = 4_000_000):
        self.n_ranges, self.key_bits, self.most = n_ranges, key_bits, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray):
        part = count_keys(keys)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [count_keys(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def flush(self):
        self._merge()
        if self.size:
            yield from ranges(*self.parts[0], self.n_ranges, self.key_bits)
        self.parts, self.size = [], 0


@lru_cache(maxsize=8)
def edges(n_ranges: int, key_bits: int = 64) -> np.ndarray:
    """First keys of the ranges after the first."""
    return np.array([(k << key_bits) // n_ranges for k in range(1, n_ranges)], U)


def ranges(keys: np.ndarray, counts: np.ndarray, n_ranges: int, key_bits: int = 64):
    """Record batches (part, blob) of sorted keys."""
    cut = np.concatenate([[0], np.searchsorted(keys, edges(n_ranges, key_bits)), [len(keys)]])
    some = [k for k in range(n_ranges) if cut[k + 1] > cut[k]]
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array([pack(keys[cut[k]:cut[k + 1]], counts[cut[k]:cut[k + 1]]) for k in some], pa.binary())],
                          names=["part", "blob"])


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by place value: high bytes of small numbers become runs of zeros."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    body = planes(np.diff(keys, prepend=U(0))) + b"".join(planes(v) for v in values)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes, n_values: int = 1) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(1 + n_values, 8, -1)
    keys, *values = (np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in raw)
    return [np.cumsum(keys, dtype=U), *values]


def merge(blobs) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return count_keys(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def save(folder: str, name: str, x: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(part, "wb") as f:
        np.save(f, x)
    os.replace(part, f"{folder}/{name}.npy")


_MAPS: dict[str, np.ndarray] = {}


def load(folder: str, name: str) -> np.ndarray:
    """A memory map, opened once per worker; pages are shared by all workers of a machine."""
    path = f"{folder}/{name}.npy"
    if path not in _MAPS:
        if len(_MAPS) > 4096:
            _MAPS.pop(next(iter(_MAPS)))  # the one opened first
        x = np.load(path, mmap_mode="r") if os.path.getsize(path) > 256 else np.load(path)
        _MAPS[path] = x
    return _MAPS[path]


class HashArrays:
    """Look-up in such a table: ``sizes`` has the number of keys of every range."""

    def __init__(self, folder: str, name: str, sizes: list[int], key_bits: int = 64):
        self.folder, self.name, self.sizes, self.key_bits = folder, name, sizes, key_bits
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key in the whole table, -1 where it isn't there.  ``keys`` are sorted."""
        out = np.full(len(keys), -1, np.int64)
        owner = np.searchsorted(edges(len(self.sizes), self.key_bits), keys, side="right")
        cut = np.flatnonzero(np.diff(owner, prepend=-1))  # only the ranges that own one of the keys are visited
        for a, b in zip(cut, np.append(cut, len(keys))[1:], strict=True):
            k, own = int(owner[a]), keys[a:b]
            if n := self.sizes[k]:
                table = load(self.folder, f"{self.name}-{k}-keys")
                at = np.minimum(np.searchsorted(table, own), n - 1)
                out[a:b] = np.where(table[at] == own, at + self.base[k], -1)
        return out

    def take(self, at: np.ndarray, what: str) -> np.ndarray:
        """Values at places in rising order (-1, which comes as 0, anywhere)."""
        return gather(self.folder, f"{self.name}-%d-{what}", self.base, at)


def gather(folder: str, pattern: str, base: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places of an array that is kept in pieces starting at ``base``; 0 for place -1."""
    out = np.zeros(len(at), np.int64)
    have = np.flatnonzero(at >= 0)
    piece = np.searchsorted(base, at[have], side="right") - 1
    for k in np.unique(piece):
        own = have[piece == k]
        out[own] = load(folder, pattern % k)[at[own] - base[k]]
    return out
