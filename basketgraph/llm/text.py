"""Vectorised word and shingle hashing over Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. All
separators are ASCII, so working on UTF-8 bytes gives the same words as working on
characters. Hashes are 64-bit fingerprints of whole words and of whole word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# ASCII punctuation also separates words where only the letters matter.
PUNCT = SPACE.copy()
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offset of each text (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``most`` bytes of text (or one row), so that
    memory follows the longest text, not the batch."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text, start byte, end byte).

    The second array has one entry more than there are texts."""
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins, finishes = offsets[:-1], offsets[1:]
    filled = finishes > begins
    head = begins[filled]
    first[head] = inside[head]
    tail = finishes[filled] - 1
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        base, top = starts[i], ends[j - 1]
        up, down = _power_tables(top - base)
        run = np.cumsum((LOWER[data[base:top]].astype(np.uint64) + np.uint64(1)) * up[: top - base])
        s, e = starts[i:j] - base, ends[i:j] - base
        total = run[e - 1]
        total[1:] -= run[s[1:] - 1]
        out[i:j] = total * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out), np.searchsorted(starts, offsets), starts, ends


def shingles(words: np.ndarray, pointer: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted within it: (hashes, first of each text).

    A text with fewer than n words has its whole sequence as one shingle; without words
    it has none."""
    count = np.diff(pointer)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), made)
    first = np.concatenate([[0], np.cumsum(made)])
    at = pointer[:-1][owner] + np.arange(first[-1]) - first[:-1][owner]
    width = np.minimum(count, n)[owner]
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        piece = (padded[at + k] + np.uint64(1)) * np.uint64(2 * k + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
        piece ^= piece >> np.uint64(29)
        total += np.where(width > k, piece * np.uint64(0x165667B19E3779F9 + 2 * k), np.uint64(0))
    total = mix(total + width.astype(np.uint64))
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[keep], owner[keep]
    return total, np.searchsorted(owner, np.arange(len(count) + 1))


def set_fingerprint(hashes: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set (0 for an empty one)."""
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
    size = np.diff(pointer).astype(np.uint64)
    out = mix((run[pointer[1:]] - run[pointer[:-1]]) ^ (size * np.uint64(0x9FB21C651E98DF25)))
    return np.where(size > 0, out, np.uint64(0))
