"""Vectorised tokens and rolling hashes over Arrow string columns.

A text column is taken as its UTF-8 buffer; words are maximal runs of bytes of a
class, hashed by a polynomial with random byte values modulo 2^64 through prefix
sums, so that no Python object is made for a word.  Texts are handled in chunks
of about a megabyte (or one text, if that is longer), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_space
#: Words of digits, letters and all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of ASCII and of the two-byte Latin-1 letters."""
    out = LOWER[data]
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][capital] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _pow = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]), dtype=np.uint64)
        _inv = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _pow, _inv


@dataclass
class Words:
    """Words of the texts lo..hi of a column."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of these texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # text of each word, from 0 for lo
    counts: np.ndarray  # words of each text
    hashes: np.ndarray


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(column, kind: np.ndarray = NOT_SPACE, fold=SAME, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of each text, chunk by chunk; fold: a table of bytes, or a function of them."""
    data, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield _words(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kind, fold)
        lo = hi


def _words(lo, hi, data, offsets, kind, fold) -> Words:
    size = len(data)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    power, inverse = _powers(size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[fold(data) if callable(fold) else fold[data]] * power[:size], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * inverse[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    doc = np.searchsorted(offsets, starts, "right") - 1
    # an empty text has the same offset as the next one: the last of them holds the word
    counts = np.bincount(doc, minlength=hi - lo).astype(np.int64)
    return Words(lo, hi, data, starts, ends, doc, counts, hashes)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of k consecutive words at each place with k words left.

    The polynomial of k words is put together from those of powers of two.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        have, done, step, power = None, 0, hashes, 1
        left = k
        while True:
            if left & 1:
                if have is None:
                    have, done = step, power
                else:
                    # have covers `done` words, step the `power` words that follow
                    m = min(len(have), len(step) - done)
                    have = have[:m] * np.uint64(pow(_BASE, power, 1 << 64)) + step[done : done + m]
                    done += power
            left >>= 1
            if not left:
                break
            m = len(step) - power
            step = step[:m] * np.uint64(pow(_BASE, power, 1 << 64)) + step[power : power + m]
            power *= 2
        return mix(have[:n])


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of k words inside one text."""
    h = rolling(w.hashes, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    at = np.flatnonzero(w.doc[: len(h)] == w.doc[k - 1 : k - 1 + len(h)])
    return at, h[at]


def word_starts(w: Words) -> np.ndarray:
    """Index of each text's first word."""
    return np.concatenate([[0], np.cumsum(w.counts)[:-1]]).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest width that holds them all."""
    top = int(values.max()) if len(values) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + len(values).to_bytes(5, "little") + values.astype(kind).tobytes()


def unpack(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    width, n = raw[at], int.from_bytes(raw[at + 1 : at + 6], "little")
    end = at + 6 + width * n
    return np.frombuffer(raw[at + 6 : end], f"<u{width}").astype(np.uint64), end
