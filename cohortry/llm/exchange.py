"""Questions from blocks of documents to a partitioned index of 64-bit keys, and the answers.

A block sends each index partition the sorted keys it asks about as one packed row, and gets back one
packed row of as many values in the same order. So a key costs about five bytes in a shuffle, a hot key
costs one entry a block however often it occurs there, and no task holds more than a block or a partition.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

#: UTF-8 bytes of text a block holds about.
BLOCK_BYTES = 4 << 20
#: Keys an index partition holds about, and partitions at least.
PART_KEYS, LEAST_PARTS = 1 << 20, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word (text, or its UTF-8 bytes) to 64-bit hash, forgotten when it grows too large."""

    limit = 300_000

    def __missing__(self, word: str | bytes) -> int:
        import xxhash

        if len(self) > self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the low bytes of their differences, each in as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    small = max(1, (int(np.median(steps)).bit_length() + 7) // 8) if len(steps) else 1
    escape = (np.uint64(1) << np.uint64(8 * small)) - np.uint64(1) if small < 8 else None
    if escape is not None and small < width:
        large = steps >= escape
        low = np.where(large, escape, steps)
        rest = steps[large]
    else:
        small, low, rest = width, steps, steps[:0]
    body = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :small].tobytes()
    return len(keys).to_bytes(4, "little") + bytes([small]) + body + rest.astype("<u8").tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    n, small = int.from_bytes(data[:4], "little"), data[4]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :small] = np.frombuffer(data, np.uint8, n * small, 5).reshape(n, small)
    steps = wide.view("<u8").ravel().astype(np.uint64)
    rest = np.frombuffer(data, "<u8", offset=5 + n * small)
    if len(rest):
        steps[steps == (np.uint64(1) << np.uint64(8 * small)) - np.uint64(1)] = rest
    return np.cumsum(steps, dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """32-bit numbers, their bytes sorted by significance and deflated."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack(values: np.ndarray) -> bytes:
    """Values of a fixed type, deflated."""
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Index partition of each key, by its high bits: partitions are ranges, so sorted keys stay together."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def runs(sorted_parts: np.ndarray):
    """(value, start, stop) of each run of equal values."""
    if not len(sorted_parts):
        return
    cuts = np.flatnonzero(np.diff(sorted_parts)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sorted_parts)]]), strict=True):
        yield int(sorted_parts[a]), int(a), int(b)


def layout_parts(size: int, part_keys: int = PART_KEYS, bytes_a_key: float = 6.5) -> int:
    """Number of index partitions for texts of so many bytes."""
    return max(LEAST_PARTS, math.ceil(size / bytes_a_key / part_keys))
