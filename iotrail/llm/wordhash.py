"""64-bit hashes of words and shingles of whole Arrow string columns, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit integers in which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and where each value begins (one more at the end)."""
    large = column.cast(pa.large_string())
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def segments(data: np.ndarray, offsets: np.ndarray, ends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and value number of each run of bytes outside the table ends_at."""
    inside = ~ends_at[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    stop[before] = inside[before]
    end = np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of data[start:end] for each segment (ascending, apart). A-Z count as a-z if lower."""
    out = np.empty(len(start), np.uint64)
    group = start // _CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(start)]
    for i, j in zip(cuts, cuts[1:]):
        if i == j:
            continue
        a, b = start[i], end[j - 1]
        part = data[a:b]
        value = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        power = np.full(len(part) + 1, _BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        value *= power[:-1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        s, e = start[i:j] - a, end[i:j] - a
        back = np.full(len(part) + 1, _INVERSE)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        out[i:j] = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def shingles(words: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words and the value of each; a value of fewer words (at least one) has one run.

    words: hashes of the words of all values; n: how many each value has.
    """
    last = np.cumsum(n)
    first = last - n
    runs = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + first[owner]
    out = np.zeros(len(owner), np.uint64)
    for k in range(size):
        there = at + k < last[owner]
        w = words[np.minimum(at + k, len(words) - 1)] if len(words) else np.zeros(0, np.uint64)
        out = np.where(there, mix((out + np.uint64(k + 1)) * np.uint64(0x2545F4914F6CDD1D) ^ w), out)
    return out, owner


def distinct(values: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner in ascending order, and how many each of `count` owners has."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[keep], np.bincount(o[keep], minlength=count)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, all texts one after another; set sizes."""
    data, offsets = buffer_of(column)
    start, end, owner = segments(data, offsets, SPACE)
    runs, of = shingles(hashes(data, start, end), np.bincount(owner, minlength=len(column)), size)
    return distinct(runs, of, len(column))
