"""Words of a text as 64-bit hashes, whole and in bounded memory, inside Arrow tasks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 22
SPACE = re.compile(rb"[\x09-\x0d\x20]")
ODD = 0x9E3779B97F4A7C15
# Of the C library; others than GNU's do without.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Cut at white space, so that a very long text is never split into all its words at once."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def split_words(data: bytes | None, lower: bool) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` block by block; ``lower`` folds A-Z only."""
    for part in blocks(data or b""):
        yield (part.lower() if lower else part).split()


def word_hashes(data: bytes | None, lower: bool) -> np.ndarray:
    """One hash a word; empty for null or blank texts."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)) for ws in split_words(data, lower)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; those of common lengths are kept."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            made = []
            for base in (ODD, pow(ODD, -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
        if size > 1 << 18:
            return made[0], made[1]
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by differences of one running sum."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n] + np.uint64(width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x[:n] if have == width else np.minimum(x[:n], x[width - have: width - have + n])


def shingles(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words has its whole sequence as one, a blank one none."""
    h = word_hashes(data, True)
    if 0 < len(h) < width:
        return rolling(h, len(h))
    return np.unique(rolling(h, width))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hand_back() -> None:
    """Gives the system what a task has freed; workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def handed_back(parts: Iterator) -> Iterator:
    """The results of a task, whose memory is handed back after the last."""
    yield from parts
    hand_back()


def emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches from rows of plain values; with ``most`` a batch ends with the row that brings its binary values to so many bytes."""
    kept: list[tuple] = []
    have = 0
    for row in rows:
        kept.append(row)
        if most:
            have += sum(len(v) for v in row if isinstance(v, bytes))
        if len(kept) >= size or most and have >= most:
            yield _batch(kept, schema)
            kept, have = [], 0
    if kept:
        yield _batch(kept, schema)
    kept = []
    hand_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def emit_arrays(parts: Iterable[tuple[np.ndarray, ...]], schema: pa.Schema, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches from equally long arrays, a few documents' worth at a time."""
    kept: list[tuple[np.ndarray, ...]] = []
    have = 0
    for part in parts:
        if not len(part[0]):
            continue
        kept.append(part)
        have += len(part[0])
        if have >= size:
            yield _arrays(kept, schema)
            kept, have = [], 0
    if kept:
        yield _arrays(kept, schema)
    kept = []
    hand_back()


def _arrays(parts: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), schema)], schema=schema)


def columns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of all batches, a slice at a time, so that only few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))
