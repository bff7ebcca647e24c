"""Arrow batches of texts as NumPy arrays: bytes, words and hashes of whole slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE = 1 << 20
#: The same where each word or byte takes many times its own size in arrays.
FINE = 1 << 18
#: Random odd multipliers, the same in every task and run.
MULT = np.random.default_rng(20240229).integers(1, 2**63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = np.random.default_rng(77).integers(1, 2**63, size=256, dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The last column of that name, so that an extra one of the caller's is no harm."""
    return batch.column(len(batch.schema.names) - 1 - batch.schema.names[::-1].index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each (null: empty)."""
    a = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    data, off = text_bytes(column(batch, text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def spread_out(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of each range, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each ordered pair of names."""
    return spread(a * MULT[1] + (b ^ (b >> np.uint64(30))) * MULT[2])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice, or runs of other bytes than those of ``space``: byte range, row and hash of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        inside = ~space[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[off[:-1][off[:-1] < len(data)]] = False
        self.data, self.start = data, np.flatnonzero(inside & ~before)
        at = np.flatnonzero(inside)
        bound = np.searchsorted(at, self.start)
        self.length = np.diff(np.append(bound, len(at)))
        self.row = np.searchsorted(off, self.start, side="right") - 1
        #: words of row i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, off)
        self.hash = np.zeros(0, np.uint64)
        if len(at):
            k = at - np.repeat(self.start, self.length)
            v = (data[at].astype(np.uint64) + np.uint64(1)) * MULT[k & 4095]
            if k.max() > 4095:
                v *= (2 * (k >> 12) + 1).astype(np.uint64)
            self.hash = spread(np.add.reduceat(v, bound) + self.length.astype(np.uint64) * MULT[7])

    def __len__(self) -> int:
        return len(self.start)
