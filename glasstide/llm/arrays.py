"""Vectorised text work on Arrow buffers: word spans, word hashes and window hashes without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer document is taken alone, whole.
CHUNK_BYTES = 1 << 21
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters neighbours (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers for a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(_GOLD))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and each text's offset in them; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about size bytes: first, last (exclusive), their bytes, their offsets."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def is_space() -> np.ndarray:
    """By byte: white space that ends a word that keeps case and punctuation."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SPACE = is_space()


def lowered(raw: np.ndarray) -> np.ndarray:
    """raw with A-Z in lower case."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


class Words:
    """Words of a run of documents: starts and ends (bytes), first (index of each document's first word, and the total)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.raw, self.offsets = raw, offsets
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~separators[raw]
        begins = inside[1:-1] & ~inside[:-2]
        edges = offsets[offsets < len(raw)]
        begins[edges] = inside[edges + 1]
        ends = inside[1:-1] & ~inside[2:]
        edges = offsets[offsets > 0] - 1
        ends[edges] = inside[edges + 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes, made in pieces of about CHUNK_BYTES."""
        out, i = np.zeros(len(self.starts), np.uint64), 0
        while i < len(out):
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, a + CHUNK_BYTES, side="right")))
            out[i:j] = span_hashes(self.raw[a : self.ends[j - 1]], self.starts[i:j] - a, self.ends[i:j] - a, seed)
            i = j
        return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        base = 0xD1342543DE82EF95
        size = max(n + 1, CHUNK_BYTES + 1)
        _POWERS[0] = tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
    return _POWERS[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit polynomial hash of each span's bytes, from one running sum over all bytes."""
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(random_numbers(256, seed)[raw] * power[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A hash of every run of width consecutive words; runs across documents are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        by = np.uint64(int(random_numbers(1, seed)[0]) | 1)
        out = words[:n].copy()
        for k in range(1, width):
            out *= by
            out += words[k : k + n]
        return mix(out)


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """By word: whether a run of width words that starts there stays in its document."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= width


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each length, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow column of lists from values end to end."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow column of byte strings: of values end to end, by number of values."""
    values = np.ascontiguousarray(values)
    offsets = (np.concatenate([[0], np.cumsum(lengths)]) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])
