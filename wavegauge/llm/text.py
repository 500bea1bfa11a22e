"""Array kernels over Arrow string batches: words, lines, runs and 64-bit hashes.

Everything here works on the UTF-8 bytes of a batch at once. Hashes are plain functions of the
bytes, so a recomputed task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

# ASCII white space, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Longest byte string hashed in eight-byte steps; longer ones are hashed one by one.
STEP_BYTES = 256


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers with well spread output bits."""
    z = z + _M1
    z = (z ^ (z >> np.uint64(30))) * _M2
    z = (z ^ (z >> np.uint64(27))) * _M3
    return z ^ (z >> np.uint64(31))


@dataclass
class Texts:
    """UTF-8 bytes of consecutive texts: ``data[start[i]:start[i + 1]]``, padded by eight zero bytes."""

    data: np.ndarray
    start: np.ndarray
    first: int  # row of the batch at which these texts begin

    @property
    def count(self) -> int:
        return len(self.start) - 1


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 21) -> Iterator[Texts]:
    """Texts of a string column in pieces of about ``most`` bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        data = np.zeros(hi - lo + 8, np.uint8)
        data[:-8] = raw[lo:hi]
        yield Texts(data, offsets[row : stop + 1] - lo, row)
        row = stop


def byte_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``data[start:start + length]``; ``data`` ends in eight spare bytes."""
    out = mix64(length.astype(np.uint64))
    windows = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    live = np.flatnonzero((length > 0) & (length <= STEP_BYTES))
    at = start[live]
    left = length[live]
    while live.size:
        keep = np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        block = (windows[at] << keep) >> keep
        out[live] = mix64(out[live] ^ block)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > STEP_BYTES):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]].tobytes())
    return out


def runs(t: Texts, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the maximal runs of bytes with ``member[byte]``, within each text."""
    body = member[t.data[:-8]]
    edge = np.zeros(len(body) + 1, bool)
    edge[t.start] = True
    start = np.flatnonzero(body & (~np.concatenate(([False], body[:-1])) | edge[:-1])) if len(body) else np.zeros(0, np.int64)
    end = np.flatnonzero(body & (~np.concatenate((body[1:], [False])) | edge[1:])) + 1 if len(body) else start
    return start, end - start


def words(t: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (lower-cased bytes, start, length, first word of each text + end)."""
    start, length = runs(t, ~SPACE)
    return LOWER[t.data] if lower else t.data, start, length, np.searchsorted(start, t.start)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles per text and their offsets; a shorter text gives its whole sequence."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(n)), n)
    at = first[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    out = np.full(len(at), np.uint64(k), np.uint64)
    end = first[1:][text]
    for j in range(k):
        here = at + j < end
        out[here] = mix64(out[here] * _M3 + hashes[at[here] + j])
    return out, offsets


class IdPool:
    """Id lists by the 64-bit hash of a byte string, looked up for whole arrays of hashes at once.

    A worker's cache: ``clear`` when ``full``; what it holds never changes a result.
    """

    def __init__(self, entries: int = 1 << 19, ids: int = 1 << 22):
        self.entries, self.most_ids = entries, ids
        self.clear()

    def clear(self) -> None:
        self.mask = (1 << 12) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @property
    def full(self) -> bool:
        return len(self.keys) > self.entries or len(self.ids) > self.most_ids

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        live = np.arange(len(h))
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while live.size:
            entry = self.slot[at]
            held = entry >= 0
            live, at, entry = live[held], at[held], entry[held]
            same = self.keys[entry] == h[live]
            out[live[same]] = entry[same]
            live, at = live[~same], (at[~same] + 1) & self.mask
        return out

    def _settle(self, entries: np.ndarray) -> None:
        at = (self.keys[entries] & np.uint64(self.mask)).astype(np.int64)
        while entries.size:
            free = self.slot[at] < 0
            self.slot[at[free]] = entries[free]  # of several, the last one wins
            placed = self.slot[at] == entries
            entries, at = entries[~placed], (at[~placed] + 1) & self.mask

    def add(self, h: np.ndarray, lists: list[np.ndarray]) -> None:
        """New, different hashes and the ids of each."""
        old = len(self.keys)
        self.keys = np.concatenate((self.keys, h))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum([len(x) for x in lists])))
        self.ids = np.concatenate((self.ids, *lists)) if lists else self.ids
        if 3 * len(self.keys) > self.mask:
            while 3 * len(self.keys) > self.mask:
                self.mask = 2 * self.mask + 1
            self.slot = np.full(self.mask + 1, -1, np.int32)
            old = 0
        self._settle(np.arange(old, len(self.keys)))

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries one after another, and how many each entry has."""
        begin = self.begin[entries]
        size = self.begin[entries + 1] - begin
        total = np.cumsum(size)
        return self.ids[np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)], size

    def entries_of(self, h: np.ndarray, make) -> np.ndarray:
        """Entries of the hashes; ``make(positions)`` gives the id lists of those not yet held."""
        out = self.find(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            self.add(new, make(missing[first]))
            out[missing] = self.find(h[missing])
        return out
