"""Word shingles of whole texts as sorted sets of 64-bit hashes, for one Arrow column at a time.

Words are runs of bytes but space and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial over random values of
its bytes, modulo 2**64; a shingle mixes the hashes of its words. Texts are taken in slices of about ``SLICE`` bytes, so
memory does not grow with the batch, and a very long text is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_VALUES = np.random.default_rng(20240501).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SLICE + SLICE // 4)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, _U(base))
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows) of consecutive rows."""
    texts = texts.fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1


def sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each gram counted from there, grams), both sorted by row and gram; distinct grams only. A text
    of fewer words than ``size`` has its whole sequence as one gram, a text without words has none."""
    for first, data, offsets in slices(texts):
        words, rows = word_hashes(data, offsets)
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        begins = np.cumsum(counts) - counts
        n = len(words)
        grams = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            grams = mix(grams * _U(3) + words[k:n - size + 1 + k] + _U(k)) if n >= size else grams
        whole = (rows[:len(grams)] == rows[size - 1:]) if len(grams) else np.zeros(0, bool)
        gram_rows, grams = rows[:len(grams)][whole], grams[whole]
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            short = np.array([_sequence(words[begins[r]:begins[r] + counts[r]]) for r in few], np.uint64)
            gram_rows, grams = np.concatenate([gram_rows, few]), np.concatenate([grams, short])
            order = np.argsort(gram_rows, kind="stable")
            gram_rows, grams = gram_rows[order], grams[order]
        if len(grams):
            cuts = [*np.flatnonzero(np.diff(gram_rows, prepend=-1)).tolist(), len(grams)]
            for a, b in zip(cuts, cuts[1:]):
                grams[a:b].sort()
            fresh = np.ones(len(grams), bool)
            fresh[1:] = (grams[1:] != grams[:-1]) | (gram_rows[1:] != gram_rows[:-1])
            gram_rows, grams = gram_rows[fresh], grams[fresh]
        yield first, gram_rows, grams


def _sequence(words: np.ndarray) -> int:
    found = np.array([len(words) + 1000], np.uint64)
    for w in words:
        found = mix(found * _U(5) + w)
    return int(found[0])
