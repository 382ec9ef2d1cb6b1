"""Words of Arrow text columns as numpy arrays, and hashes of words and of runs of words.

Words are runs of other than the ASCII white space 0x20 and 0x09-0x0D, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
#: Bases of run hashes; both are 3 modulo 8, so that runs of up to hundreds of words stay apart in nearly all bits.
RUN_BASES = (0xD6E8FEB86659FD93, 0x9E6C63D0876A9A43)
KEY, STEP, SECOND = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x27D4EB2F165667C5)
#: Words of more bytes than this are hashed by BLAKE2.
VERY_LONG = 1024
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, or of one row. Null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field(at), pc.fill_null(batch.column(at), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def text_bytes(texts: pa.Array) -> list[bytes]:
    return [x.encode() for x in texts.to_pylist()]


class Words:
    """The words of all rows of a text array: ``bytes``, ``starts``, ``ends``, and ``doc``, each word's row."""

    def __init__(self, texts: pa.Array):
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        inside = ~WHITE[self.bytes]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.bytes))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.n_docs = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes.

        Eight bytes at a time go through a bijective mixing that depends on all before them, so no arithmetic relation
        between words survives, and words of up to eight bytes and equal length never collide.
        """
        long = self.ends - self.starts
        out = mixed(long.astype(U64) * STEP + KEY)
        padded = np.append(self.bytes, np.zeros(8, np.uint8))
        lanes = np.ndarray(len(self.bytes) + 1, "<u8", padded, strides=(1,))
        at, left, live = self.starts, long, slice(None)
        while len(at):
            out[live] = mixed((out[live] ^ (lanes[at] & LANE[np.minimum(left, 8)])) + STEP)
            more = np.flatnonzero((left > 8) & (left <= VERY_LONG)) if isinstance(live, slice) else np.flatnonzero(left > 8)
            live = more if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(long > VERY_LONG):
            word = self.bytes[self.starts[i] : self.ends[i]].tobytes()
            out[i] = U64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Runs:
    """Hashes of runs of consecutive words, from prefix sums. ``lane`` chooses one of two hashes that are independent of each other."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        n, base = len(hashes), RUN_BASES[lane]
        own = mixed(hashes + SECOND) if lane else hashes
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(own * np.cumprod(np.full(n, base, U64)), out=self.sums[1:])
        self.unshift = np.cumprod(np.full(n + 1, pow(base, -1, 2**64), U64))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.unshift[starts] + (ends - starts).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return self.of(np.arange(n), np.arange(size, n + size)) if n > 0 else np.zeros(0, U64)


def sliding(x: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of each ``size`` neighbours, from running values inside blocks."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    fill = np.iinfo(x.dtype).max if pick is np.minimum else 0
    blocks = np.append(x, np.full(-len(x) % size, fill, x.dtype)).reshape(-1, size)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[size - 1 : size - 1 + n])
