"""Vectorised text kernels over Arrow string buffers (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; the arrays made of them take about 40 times as much.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1), b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


class Hasher:
    """Polynomial hashes modulo 2**64 of words, and of runs of k words."""

    BYTE, TERM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.pb = self.pt = (np.zeros(0, U64), np.zeros(0, U64))

    def words(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word of each text buf[off[i]:off[i+1]]; word offsets of the texts."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(off), np.int64)
        if len(self.pb[0]) < n:
            self.pb = powers(self.BYTE, n)
        space = self.space[buf]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        cut[1:n] |= space[:-1]
        cut[0] = True
        s = np.flatnonzero(~space & cut[:n])
        cut[:n] |= space
        cut[off] = True
        cut[n] = True
        e = np.flatnonzero(~space & cut[1:]) + 1
        sums = np.zeros(n + 1, U64)
        v = self.table[buf]
        v *= self.pb[0][:n]
        np.cumsum(v, out=sums[1:])
        h = (sums[e] - sums[s]) * self.pb[1][s]
        return s, e, mix(h + (e - s).astype(U64)), np.searchsorted(s, off)

    def grams(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k words, whatever text they are of: len(h)-k+1 values."""
        n = len(h)
        if n < k:
            return np.zeros(0, U64)
        if len(self.pt[0]) < n:
            self.pt = powers(self.TERM, max(n, 1 << 18))
        sums = np.zeros(n + 1, U64)
        np.cumsum(h * self.pt[0][:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * self.pt[1][: n - k + 1] + U64(k))


def texts(col: pa.Array):
    """Yield (first row, bytes, offsets) for slices of a string column of about CHUNK bytes; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1)
        yield a, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def lists(values: list[np.ndarray], lengths: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of concatenated values and the length of each list."""
    n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    off = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=off[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat).cast(kind))


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of the given lengths laid end to end: the range of each element, and its place in that range."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - first[owner]
