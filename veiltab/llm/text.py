"""Words and n-gram hashes of Arrow string columns as numpy arrays.

A batch is handled as one run of bytes with row bounds, so splitting and hashing cost a few array
passes and no Python object per word. Hashes are 64-bit polynomials over bytes, mixed at the end.
NULL reads as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 2 << 20  # working memory is about 20 times this, or 20 times the longest text
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LANE = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), (1 << 64) - 1], np.uint64)
LONG_RANGE = 2048  # bytes; longer ranges are hashed one by one


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the bounds of its rows (one more than rows)."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, places, raw = col.buffers()
    bounds = np.frombuffer(places, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row bound the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~SPACE[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash for each range of bytes, taken eight bytes at a time; ``which`` picks one of two."""
    odd, size = _ODD[which], ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) + odd)
    at = np.flatnonzero((size > 0) & (size <= LONG_RANGE))
    place, left = starts[at], size[at]
    while len(at):
        out[at] = mix(out[at] * odd + (lanes[place] & _LANE[np.minimum(left, 8)]))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_RANGE).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed=int(odd))
    return out


def same_as(h: np.ndarray) -> np.ndarray:
    """For each value the index of one place that holds it, the same for equal values."""
    found = np.empty(len(h), np.int64)
    todo, turn = np.arange(len(h)), 0
    bits = max(8, int(len(h)).bit_length() + 1)
    table = np.empty(1 << bits, np.int64)
    while len(todo):
        odd = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * turn) & (2**64 - 1))
        slot = (h[todo] * odd) >> np.uint64(64 - bits)
        table[slot] = todo
        held = table[slot]
        fits = h[held] == h[todo]
        found[todo[fits]] = held[fits]
        todo, turn = todo[~fits], turn + 1
    return found


def follow(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and of its last word."""
    return mix(h * np.uint64(0x9FB21C651E98DF25) + nxt)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes (len(h) - n + 1 of them, none when h is shorter)."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = h[:count]
    for k in range(1, n):
        out = follow(out, h[k : k + count])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
