"""Removing repeated passages: windows of words that also begin earlier in the corpus.

Level-wise doubling.  At the first level every window of ``start`` words asks whether it is repeated anywhere.
Windows repeated at one length alone are extended to twice that length (both halves must be repeated), and
ask again; the last level is the window length itself, where every surviving window learns whether the corpus
holds it at an earlier place.  Documents without survivors leave with their result after each level, so later
levels see only repeated text, and the loop ends early when nothing is left.

The levels before the last compare 32 bits beyond the key range and only ever let too much through; the last
compares 48 bits beyond it.

Defined results: null text has no words; null ids are one last document each; rows that repeat an id are separate
documents of which the one in the smaller chunk counts as earlier.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from veilink.llm import chunks, words
from veilink.llm.chunks import Chunk
from veilink.sources.store import store

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, carried string"


def _lengths(window: int, start: int) -> list[int]:
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _named(chunk: Chunk, length: int, window: int, start: int):
    """Names of the windows of ``length`` at every word, and which places are candidates."""
    first, last, bounds = words.word_spans(chunk.data, chunk.offsets)
    names = words.chain(words.word_names(chunk.data, first, last), min(start, window))
    below = 0
    for longer in _lengths(window, start):
        if below:
            names = words.pair(names, words.shifted(names, longer - below))
        if longer == length:
            break
        below = longer
    fits = words.room(bounds, len(first)) >= length
    if chunk.alive is not None:
        alive = chunk.alive[: len(first)]
        fits &= alive & words.shifted(alive, length - below)
    return names, fits, first, last, bounds


def _rows(chunk: Chunk, which: np.ndarray, gone: np.ndarray, first, last, bounds, with_text: bool) -> list[dict]:
    rows = []
    removed = np.concatenate(([0], np.cumsum(gone)))
    for i in np.flatnonzero(which):
        lo, hi = bounds[i], bounds[i + 1]
        n_gone = int(removed[hi] - removed[lo])
        if not n_gone:
            kept = b" ".join(chunk.text(i).split())
        else:
            keep = np.flatnonzero(~gone[lo:hi]) + lo
            kept = b" ".join(chunk.data[first[k] : last[k]].tobytes() for k in keep)
        rows.append({
            "doc_id": None if chunk.ids[i] == chunks.NO_ID else int(chunk.ids[i]),
            "n_words": int(hi - lo), "n_removed": n_gone, "kept_sha256": hashlib.sha256(kept).hexdigest(),
            "kept": _without(chunk, i, gone, first, bounds) if with_text else None,
            "carried": chunk.rest[i] if chunk.rest else None,
        })
    return rows


def _without(chunk: Chunk, i: int, gone: np.ndarray, first, bounds) -> str:
    """The text without the removed words and the white space after each."""
    lo, hi = bounds[i], bounds[i + 1]
    if not gone[lo:hi].any():
        return chunk.text(i).decode()
    ends = np.append(first[lo + 1 : hi], chunk.offsets[i + 1])
    drop = np.zeros(chunk.offsets[i + 1] - chunk.offsets[i] + 1, np.int32)
    np.add.at(drop, first[lo:hi][gone[lo:hi]] - chunk.offsets[i], 1)
    np.subtract.at(drop, ends[gone[lo:hi]] - chunk.offsets[i], 1)
    return chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]][np.cumsum(drop[:-1]) == 0].tobytes().decode()


STATE = RESULT + ", " + chunks.CHUNK_SCHEMA


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, start: int = 5,
    with_text: bool = False, carry: Column | None = None,
) -> DataFrame:
    """One row per document: words, removed words, digest of the words kept.

    ``with_text`` adds ``kept``, the text without the removed words and the white space after them; ``carry`` a text of
    the caller's that comes back as ``carried``.
    """
    base = chunks.write_chunks(docs, id_col, text_col, "passages", carry)
    table, bits = base.frame, chunks.range_bits(base.seen["bytes"] / 6)
    finished: list[DataFrame] = []
    lengths = _lengths(window, start)

    def keys_of(length):
        def keys(chunk: Chunk):
            names, fits, *_ = _named(chunk, length, window, start)
            found, place = np.unique(names[fits], return_index=True)
            if length < window:
                return found, None
            bounds = _[2]
            doc = np.searchsorted(bounds, np.flatnonzero(fits)[place], "right") - 1
            return found, chunk.ids[doc]

        return keys

    def narrow(length):
        def use(chunk: Chunk, said: np.ndarray) -> list[dict]:
            names, fits, first, last, bounds = _named(chunk, length, window, start)
            _, inverse, count = np.unique(names[fits], return_inverse=True, return_counts=True)
            alive = np.zeros(len(names), bool)
            alive[fits] = ((count > 1) | (said > 0))[inverse]
            seen = np.concatenate(([0], np.cumsum(alive)))
            live = seen[bounds[1:]] > seen[bounds[:-1]]
            rows = _rows(chunk, ~live, np.zeros(len(names), bool), first, last, bounds, with_text)
            if live.any():
                rows.append(chunks.keep_documents(chunk, live, bounds, alive).row())
            return rows

        return use

    def close(chunk: Chunk, said: np.ndarray) -> list[dict]:
        names, fits, first, last, bounds = _named(chunk, window, window, start)
        _, place, inverse = np.unique(names[fits], return_index=True, return_inverse=True)
        earliest = np.zeros(int(fits.sum()), bool)
        earliest[place[said > 0]] = True
        gone = words.cover(np.flatnonzero(fits)[~earliest], window, len(names))
        return _rows(chunk, np.ones(len(chunk.ids), bool), gone, first, last, bounds, with_text)

    for length in lengths[:-1]:
        answers = chunks.ask(table, keys_of(length), bits, 4, chunks.repeated)
        state = store(
            chunks.told(table, answers, narrow(length), STATE), f"passages-{length}",
            left=F.count("chunk"), bytes=F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)),
        )
        if not finished:
            base.drop()  # all that follows reads the states
        finished.append(state.frame.where(F.col("chunk").isNull()).select(*chunks.names(RESULT)))
        table = state.frame.where(F.col("chunk").isNotNull()).select(*chunks.names(chunks.CHUNK_SCHEMA))
        if not state.seen["left"]:
            break
        bits = chunks.range_bits(state.seen["bytes"] / 6)
    else:
        answers = chunks.ask(table, keys_of(window), bits, 6, chunks.first_owner)
        finished.append(chunks.told(table, answers, close, RESULT))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.drop(*([] if with_text else ["kept"]), *([] if carry is not None else ["carried"]))
