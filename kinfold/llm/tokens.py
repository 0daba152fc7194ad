"""Vectorised splitting and hashing of words over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
HASH_BYTES = 1_000_000

#: [^\x20\x09-\x0D]+ on UTF-8 bytes.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters and digits; every byte of a character beyond ASCII counts as a letter.
ALNUM = np.array([chr(i).isalnum() and i < 128 or i >= 128 for i in range(256)])

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h = h * _U(0x9FB21C651E98DF25)
    h ^= h >> _U(32)
    return h


_P = _U(0x5851F42D4C957F2D)
_PI = _U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _tables(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    if fold:
        t[65:91] = t[97:123]
    return t


_TABLE = {True: _tables(True), False: _tables(False)}


#: A second, independent hash, for places where equal hashes count as equal bytes.
SECOND = mix(np.arange(1001, 1257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of buf; spans ascend without overlap. Spans are hashed in blocks of some bytes, so that memory
    doesn't grow with a text (but with its longest span)."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + HASH_BYTES, "right")))
        part = buf[lo : int(ends[j - 1])]
        p, inv = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * p[: len(part)], out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = mix((total[ends[i:j] - lo] - total[s]) * inv[s])
        i = j
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PI)):
            a = np.full(max(n, HASH_BYTES + 1), base, dtype=_U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=_U)
    return _powers[0], _powers[1]


class Words:
    """Words of some texts. text i has words off[i] to off[i+1]; starts and ends are byte places in buf; base has the texts' places."""

    def __init__(self, buf: np.ndarray, base: np.ndarray, kind: np.ndarray):
        self.buf, self.base = buf, base
        w = kind[buf]
        before = np.empty_like(w)
        before[:1] = False
        before[1:] = w[:-1]
        firsts = base[:-1][base[:-1] < len(buf)]
        before[firsts] = False
        self.starts = np.flatnonzero(w & ~before)
        after = np.empty_like(w)
        after[-1:] = False
        after[:-1] = w[1:]
        lasts = base[1:][base[1:] > 0] - 1
        after[lasts] = False
        self.ends = np.flatnonzero(w & ~after) + 1
        self.off = np.searchsorted(self.starts, base)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """64-bit hash of each word's bytes; fold: A-Z count as a-z."""
        return span_hashes(self.buf, self.starts, self.ends, _TABLE[fold])

    def text(self, k: int) -> str:
        return self.buf[self.starts[k] : self.ends[k]].tobytes().decode("utf-8")

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.base) - 1), np.diff(self.off))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with null as empty, with 64-bit offsets."""
    a = batch.column(name)
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    return a.fill_null("") if a.null_count else a


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a large_string column of about `most` bytes: first and last row, bytes, places of the rows. No text is cut."""
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


#: Bytes of a batch's texts that are turned into Python strings at a time.
PART_BYTES = 2_000_000


def parts_of(batch: pa.RecordBatch, name: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of the string column `name`; a row is never cut."""
    a = batch.column(name)
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    for i, j, _, _ in slices(a, most):
        yield batch.slice(i, j - i)
