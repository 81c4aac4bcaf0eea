"""Word-shingle sets of whole texts, hashed in bulk on Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Each word gets a
64-bit hash from running sums over the batch's bytes, each shingle a 64-bit mix of its
words' hashes, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 * SLICE_BYTES or "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        up = np.cumprod(np.full(size, _STEP))
        down = np.cumprod(np.full(size, _STEP_INV))
        if size > 4 * SLICE_BYTES:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``most_rows`` rows; a longer text has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n, first + most_rows)
        yield first, last
        first = last


def hashed_words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, hash) of the runs of bytes that ``outside`` does not mark, A-Z lower-cased.

    With ``prefixes``, each word is followed by the hashes of its first so many bytes, where it is longer.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    text = data[base:end]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(text):
        return none
    inside = ~outside[text]
    cut = np.zeros(len(text) + 1, bool)
    cut[offsets - base] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(first):
        return none
    up, down = _power(len(text))
    total = np.cumsum(_BYTE[text] * up[: len(text)])
    before = total[first - 1]
    before[first == 0] = 0
    word = mix((total[last] - before) * down[first] + (last - first).astype(np.uint64))
    row = np.searchsorted(offsets - base, first, "right") - 1
    if not prefixes:
        return row, first, word
    kinds, real = [word], [np.ones(len(word), bool)]
    for size in prefixes:
        real.append(last - first >= size)
        upto = total[np.minimum(first + size - 1, len(total) - 1)]
        kinds.append(mix((upto - before) * down[first] + _PLACE[size]))
    keep = np.stack(real, 1).ravel()
    return np.repeat(row, len(kinds))[keep], np.repeat(first, len(kinds))[keep], np.stack(kinds, 1).ravel()[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, ordered by row and hash."""
    row, _, word = hashed_words(data, offsets, _SPACE)
    if not len(word):
        return row, word
    count = np.bincount(row, minlength=len(offsets) - 1)

    n = len(word) - words + 1
    rows, hashes = [], []
    if n > 0:
        whole = row[:n] == row[words - 1 :]
        value = word[:n] * _PLACE[0]
        for k in range(1, words):
            value = value + word[k : n + k] * _PLACE[k]
        rows.append(row[:n][whole])
        hashes.append(mix(value[whole]))
    few = (count > 0) & (count < words)
    if few.any():
        at = few[row]
        place = np.arange(len(word)) - (np.cumsum(count) - count)[row]
        part = word[at] * _PLACE[place[at]]
        owner = row[at]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        owners = owner[starts]
        rows.append(owners)
        hashes.append(mix(np.add.reduceat(part, starts) + _PLACE[words + count[owners]]))
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def signed(value: np.ndarray) -> np.ndarray:
    """uint64 to int64 in the same order."""
    return (value ^ np.uint64(1 << 63)).view(np.int64)
