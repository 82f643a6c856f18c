"""Vectorised words, word hashes and shingle hashes over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` in UTF-8.  The values buffer of a column holds
all texts back to back, so words of a whole batch are found with a few numpy
passes; hashes then cost per word, not per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_U = np.uint64
#: Longer words are hashed one by one.
_LONG_WORD = 128
#: Low bytes kept when 0..8 bytes of a chunk belong to the word.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """The words of some texts.

    ``starts``/``ends``: byte bounds in ``buf``; ``offsets[d]:offsets[d + 1]``: the
    words of text ``d``.  Null texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        values = texts.buffers()[2] if n else None
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self.buf = np.zeros(len(data) + 8, np.uint8)
        if lower:
            np.take(_LOWER, data, out=self.buf[: len(data)])
        else:
            self.buf[: len(data)] = data
        inside = np.empty(len(data) + 1, bool)
        np.logical_not(_SPACE[data], out=inside[:-1])
        inside[-1] = False
        first = np.empty(len(data) + 1, bool)
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        first[self.bounds] = True
        self.starts = np.flatnonzero(inside & first)
        last = first[1:] | ~inside[1:]
        self.ends = np.flatnonzero(inside[:-1] & last) + 1
        self.offsets = np.searchsorted(self.starts, self.bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))
        view = np.lib.stride_tricks.as_strided(self.buf[:8].view(np.uint64), (max(len(self.buf) - 7, 1),), (1,))
        long = np.flatnonzero(size > _LONG_WORD)
        live, at, left = None, self.starts, np.minimum(size, _LONG_WORD)
        while len(at):
            chunk = view[at] & _KEEP[np.minimum(left, 8)]
            if live is None:
                h = mix(h ^ chunk)
                live = np.flatnonzero(left > 8)
                at, left = at[live] + 8, left[live] - 8
            else:
                h[live] = mix(h[live] * _U(0x9FB21C651E98DF25) ^ chunk)
                more = left > 8
                live, at, left = live[more], at[more] + 8, left[more] - 8
        raw = self.buf
        for i in long:
            h[i] = xxhash.xxh3_64_intdigest(raw[self.starts[i] : self.ends[i]].tobytes(), seed=seed)
        return h


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes, across text bounds too.

    Entry ``i`` stands for ``words[i : i + width]``; there are ``len(words) - width + 1``.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base_u = _U(base | 1)
    out = words[:n].copy()
    for j in range(1, width):
        out *= base_u
        out += words[j : j + n]
    return mix(out)


def window_rows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one text, and the number in each text."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    first = np.repeat(offsets[:-1], counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first + within, counts


def shingles(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the number in each text.

    A text of fewer words, but at least one, has its whole sequence as its only
    shingle; a text without words has none.  Repeats are kept.
    """
    h = words.hashes(seed)
    offsets, counts = words.offsets, words.counts
    starts, n = window_rows(offsets, width)
    full = window_hashes(h, width, 0xD6E8FEB86659FD93)
    short = np.flatnonzero((counts > 0) & (counts < width))
    n = n.copy()
    n[short] = 1
    out = np.empty(int(n.sum()), np.uint64)
    at = np.cumsum(n) - n
    is_short = np.zeros(len(out), bool)
    is_short[at[short]] = True
    out[~is_short] = full[starts] if len(starts) else full[:0]
    for d in short:
        acc = np.uint64(0xA0761D6478BD642F + int(counts[d]))
        for x in h[offsets[d] : offsets[d + 1]]:
            acc = mix(np.array([acc], np.uint64) ^ x)[0]
        out[at[d]] = acc
    return out, n


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each consecutive group, and their number."""
    group = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[keep], np.bincount(group[keep], minlength=len(counts))


def blocks(column: pa.Array | pa.ChunkedArray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text (a longer text alone is one range)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to
