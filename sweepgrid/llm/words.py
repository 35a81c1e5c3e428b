"""Words of many texts at once: bounds and 64-bit hashes, by array operations on the UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, so it is the same as the code-point
pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials modulo 2**64 over a random table of byte
values; r = 3 (mod 8) keeps differences of powers nearly odd, so equal hashes of different words
are as rare as for random 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C1B
_RI = pow(_R, -1, 1 << 64)
_G = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_R, _RI):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end); null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """``start`` and ``end`` bytes of each word in ``raw``; ``first[d]`` is the first word of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.at = text_bytes(texts)
        n = len(self.raw)
        if n:
            space = _SPACE[self.raw]
            cut = np.zeros(n + 1, dtype=bool)
            cut[self.at] = True
            before = np.empty(n, dtype=bool)
            before[0] = True
            before[1:] = space[:-1]
            after = np.empty(n, dtype=bool)
            after[-1] = True
            after[:-1] = space[1:]
            word = ~space
            self.start = np.flatnonzero(word & (before | cut[:-1]))
            self.end = np.flatnonzero(word & (after | cut[1:])) + 1
            power, inverse = _powers_to(n + 1)
            sums = np.empty(n + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum((_LOWER if lower else _BYTES)[self.raw] * power[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        else:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))

    def text(self, a: int, b: int) -> bytes:
        """The bytes from word a to before word b, with the white space between as it is."""
        return self.raw[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""

    def joined(self, a: int, b: int) -> bytes:
        """Words a to before b with one space between."""
        return b" ".join(self.text(a, b).split()) if b > a else b""


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive items of h, also across texts; the caller drops those."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= _G
        acc += h[j : j + m]
    return mix(acc)
