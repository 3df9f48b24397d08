"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the raw UTF-8 buffer of an Arrow string column, so that a
batch of documents costs a few numpy passes instead of a Python loop per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: blank and the controls tab to carriage return.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one vectorised pass takes; bounds a worker's memory.
SLICE_BYTES = 1 << 20

_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[list(WORD_BREAKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a buffer that are looked at in one pass, and spans that are hashed in one.
_PASS_BYTES, _PASS_SPANS = 4 << 20, 1 << 19
#: Spans of more bytes are hashed one by one.
_LONG_SPAN = 256
#: What is left of an 8-byte block of which so many bytes count.
_BLOCK_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_KEY = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, size=4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit hashes of the bytes buf[s:e] of each span.

    Blocks of eight bytes are mixed into the state one after the other by a
    function that is no polynomial of them; long spans take a keyed BLAKE2.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), _PASS_SPANS):
        out[i : i + _PASS_SPANS] = _span_hashes(buf, starts[i : i + _PASS_SPANS], ends[i : i + _PASS_SPANS])
    return out


def _span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(starts.min())
    padded = np.zeros(int(ends.max()) - base + 8, np.uint8)
    padded[:-8] = buf[base : base + len(padded) - 8]
    blocks = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at, left = starts - base, ends - starts
    h = mix64(left.astype(np.uint64) * _KEY[0] + _KEY[1])
    live = None  # all of them, in the first round
    long = np.flatnonzero(left > _LONG_SPAN)
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[at[i] : at[i] + left[i]], digest_size=8, key=_KEY.tobytes()).digest(), "little")
    if len(long):
        live = np.flatnonzero(left <= _LONG_SPAN)
        at, left = at[live], left[live]
    while len(at):
        x = blocks[at] & _BLOCK_MASK[np.minimum(left, 8)]
        state = h if live is None else h[live]
        new = mix64((state ^ x) * _KEY[2])
        if live is None:
            h = new
        else:
            h[live] = new
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((a * _KEY[2]) ^ (b + _KEY[3]))


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive 64-bit values, by folding halves: about log k passes."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low, width, out, done = mix64(values ^ _KEY[1]), 1, None, 0
    while done < k:
        if k & width:
            part = low[done : done + n]
            out = part if out is None else _fold(out, part)
            done += width
        if done < k:
            low = _fold(low[:-width], low[width:])
            width *= 2
    return mix64(out + np.uint64(k * int(_KEY[0]) % 2**64))


class Words:
    """Words of a run of documents.

    starts, ends: byte offsets of each word in buf; bounds: word index at which
    each document begins, with the total at the end.
    """

    __slots__ = ("buf", "starts", "ends", "bounds")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = buf
        starts, ends = [], []
        for a in range(0, len(buf), _PASS_BYTES):
            b = min(a + _PASS_BYTES, len(buf))
            gap = _IS_BREAK[buf[a:b]]
            edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a
            before, after = np.empty(b - a, bool), np.empty(b - a, bool)
            before[0] = a == 0 or _IS_BREAK[buf[a - 1]]
            before[1:] = gap[:-1]
            before[edges[edges < b - a]] = True
            after[-1] = b == len(buf) or _IS_BREAK[buf[b]]
            after[:-1] = gap[1:]
            after[edges[edges > 0] - 1] = True
            starts.append(np.flatnonzero(before & ~gap) + a)
            ends.append(np.flatnonzero(after & ~gap) + a + 1)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets).astype(np.int64)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(_LOWER[self.buf] if lower else self.buf, self.starts, self.ends)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.dtype(np.int64 if large else np.int32)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=width, count=len(column) + 1, offset=column.offset * width.itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, end row, bytes, offsets.

    A row longer than the limit makes a run of its own; no text is cut.
    """
    buf, offs = buffer_of(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def gram_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document and the document of each.

    A document of fewer than k words, but of one at least, gives the hash of its
    whole word sequence; one without words gives nothing. Hashes are in no order.
    """
    counts = np.diff(bounds)
    docs = np.repeat(np.arange(len(counts)), counts)
    runs = run_hashes(words, k)
    inside = np.flatnonzero(np.arange(len(runs)) + k <= bounds[1:][docs[: len(runs)]])
    hashes, of = [runs[inside]], [docs[inside]]
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        if len(short):
            h = np.full(len(short), np.uint64(c), np.uint64)
            for j in range(c):
                h = _fold(h, words[bounds[:-1][short] + j])
            hashes.append(h)
            of.append(short)
    return np.concatenate(hashes), np.concatenate(of)


def unique_per_doc(values: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document in ascending order, and their bounds."""
    order = np.argsort(values)
    order = order[np.argsort(docs[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")]
    v, d = values[order], docs[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(n_docs + 1))
