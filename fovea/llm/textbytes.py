"""Vectorised word and shingle hashing over the raw UTF-8 bytes of an Arrow string column.

Words are maximal runs without ASCII white space (space and bytes 9 to 13). All arithmetic wraps
modulo 2**64, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000
PIECE_BYTES = 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that sums of structured values look random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors)
    return _powers["up"][:n], _powers["down"][:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes: first row, end row, their bytes, row offsets into those. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the number of words before each row (one more entry than rows)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    word = ~gap
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word; `lower` folds A-Z only."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if len(data) > 2 * PIECE_BYTES and len(starts) > 1:  # arrays of eight bytes a byte: a long text goes piece by piece
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), PIECE_BYTES)))
        cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
        pieces = [(a, b, starts[a], ends[b - 1]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return np.concatenate([_hashes(data[s:e], starts[a:b] - s, ends[a:b] - s, lower) for a, b, s, e in pieces])
    return _hashes(data, starts, ends, lower)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    up, down = powers(len(data) + 1)
    value = (_LOWER[data] if lower else data).astype(np.uint64)
    value += np.uint64(1)
    value *= up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(words: np.ndarray, first: int, end: int, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words among words[first:end]; fewer words make one run."""
    w = words[first:end]
    if len(w) == 0:
        return w
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = mix(h + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def all_shingles(words: np.ndarray, counts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """shingles() of each row; counts as word_spans gives them. Hashes are made for all rows at once."""
    n = len(words) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        h = mix(h + words[k : n + k])
    for first, end in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        yield np.unique(h[first : end - size + 1]) if end - first >= size else shingles(words, first, end, size)
