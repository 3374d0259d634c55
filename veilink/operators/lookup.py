"""Kernel of the encoding: bigrams of a batch of values looked up in a codebook."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The kernels travel to the executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a text column, each as the number that its UTF-8 bytes spell, and how many each value has."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    first = (data & 0xC0) != 0x80
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(data)))
    codes = data[starts].astype(np.uint64)
    for more in range(1, int(sizes.max())):
        longer = np.flatnonzero(sizes > more)
        codes[longer] = codes[longer] << np.uint64(8) | data[starts[longer] + more]
    return codes, np.diff(np.searchsorted(starts, offsets - offsets[0]))


def bigram_names(column: pa.Array, pad: str) -> tuple[np.ndarray, np.ndarray]:
    """Names of all bigrams of the padded values, and where each value's begin: one more than it has characters."""
    codes, lengths = characters(column)
    edge = np.uint64(int.from_bytes(pad.encode(), "big"))
    ends = np.cumsum(lengths + 2)
    padded = np.full(int(ends[-1]) if len(ends) else 0, edge)
    inner = np.ones(len(padded), bool)
    inner[ends - 1] = False
    inner[ends - lengths - 2] = False
    padded[inner] = codes
    pairs = padded[:-1] << np.uint64(32) | padded[1:]
    within = np.ones(len(pairs), bool)
    within[ends[:-1] - 1] = False
    return pairs[within], np.cumsum(lengths + 1) - lengths - 1


def token_names(tokens: pa.Array) -> np.ndarray:
    """Names of bigrams that stand alone."""
    codes, _ = characters(tokens)
    return codes[::2] << np.uint64(32) | codes[1::2]


def merged(column: pa.Array, names: np.ndarray, filters: np.ndarray, pad: str, into: np.ndarray) -> None:
    """ORs the filters of every value's bigrams into its row of ``into``, (words, values).

    ``names`` are sorted; ``filters`` is (words, names + 1), the last one empty: that of a bigram the codebook lacks.
    A null value has no bigrams.
    """
    known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(known) or not len(names):
        return
    found, starts = bigram_names(column.take(pa.array(known)) if len(known) < len(column) else column, pad)
    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
    at[names[at] != found] = len(names)
    for word, own in zip(into, filters, strict=True):
        word[known] |= np.bitwise_or.reduceat(own[at], starts)


def encode_batches(batches, book: dict, n_values: int, words: int, pad: str, names_out: list[str]):
    """Record batches of (config_id, kept columns, values) become (config_id, kept columns, words).

    ``book`` holds (names, filters) by (configuration, place of the attribute).
    """
    none = (np.zeros(0, np.uint64), np.zeros((words, 1), np.uint64))
    for batch in batches:
        config = batch.column(0).to_numpy()
        first = batch.num_columns - n_values
        out = np.zeros((words, batch.num_rows), np.uint64)
        for number in np.unique(config).tolist():
            mine = np.flatnonzero(config == number)
            part = out if len(mine) == len(config) else np.zeros((words, len(mine)), np.uint64)
            for place in range(n_values):
                value = batch.column(first + place)
                value = value if part is out else value.take(pa.array(mine))
                merged(value, *book.get((number, place), none), pad, part)
            if part is not out:
                out[:, mine] = part
        flat = pa.array(np.ascontiguousarray(out.T).ravel().view(np.int64))
        filters = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), flat)
        yield pa.RecordBatch.from_arrays([*batch.columns[:first], filters], names=names_out)
