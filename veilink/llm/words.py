"""Array kernels over a run of texts held as one byte buffer.

A *run* is the UTF-8 bytes of several documents side by side, with the offset where each begins.
Words are maximal stretches of bytes other than space, tab, newline, vertical tab, form feed, return.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"

_table = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_fold = _table.copy()
_fold[65:91] = _table[97:123]
_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_table[_is_space] = _fold[_is_space] = 0  # no part of a name
_STEP = np.uint64(0x9E3779B97F4A7C17)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that every bit of a key depends on all of them."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of the concatenation of two named pieces."""
    return mix(left * _JOIN + (right ^ (right >> np.uint64(32))) * _STEP + np.uint64(0x51))


def arrow_run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, without copying; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of every word and the index of the first word of every document, plus the end."""
    inside = ~_is_space[data]
    first = inside.copy()
    last = inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """A 64-bit name of every word; ``fold_case`` takes A-Z for a-z."""
    out = [np.zeros(0, np.uint64)]
    at = 0
    while at < len(starts):  # in pieces that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 16), "right")))
        lo = starts[at]
        out.append(_names_of(data[lo : ends[to - 1]], starts[at:to] - lo, ends[at:to] - lo, fold_case))
        at = to
    return np.concatenate(out)


def _names_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool) -> np.ndarray:
    longest = int((ends - starts).max())
    powers = np.empty(longest, np.uint64)
    powers[0] = 1
    powers[1:] = _STEP
    np.multiply.accumulate(powers, out=powers)
    # the place of every byte within its word, by a running count that restarts at each word
    place = np.ones(len(data), np.int32)
    place[0] = 0
    place[starts[1:]] = 1 - np.diff(starts).astype(np.int32)
    place = np.cumsum(place, dtype=np.int32)
    np.minimum(place, longest - 1, out=place)
    terms = (_fold if fold_case else _table)[data]
    terms *= powers[place]
    return mix(np.add.reduceat(terms, starts))


def room(first_word: np.ndarray, n_words: int) -> np.ndarray:
    """For every word, how many words of its document begin there or later."""
    counts = np.diff(first_word)
    return np.repeat(first_word[1:], counts) - np.arange(n_words)


def chain(names: np.ndarray, length: int) -> np.ndarray:
    """Name of the ``length`` pieces that begin at each place; the last places have a partial one."""
    out = names
    for j in range(1, length):
        shifted = np.zeros_like(names)
        shifted[: max(0, len(names) - j)] = names[j:]
        out = pair(out, shifted)
    return out


def shifted(names: np.ndarray, by: int) -> np.ndarray:
    """names[p + by] at p, zero beyond the end."""
    out = np.zeros_like(names)
    out[: max(0, len(names) - by)] = names[by:]
    return out


def cover(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a stretch of ``length`` from one of ``starts``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + length, total), 1)
    return np.cumsum(edge[:-1]) > 0


def group_number(name: str | None) -> int:
    """A number that tells texts apart well enough to put equal ones side by side."""
    return 0 if name is None else zlib.crc32(name.encode()) >> 1
