"""Repeated byte strings by prefix doubling over the positions of all texts.

A position's *rank* at a length names the string of that length that begins there: equal ranks, equal strings.
Ranks double: rank(p, 2L) names the pair (rank(p, L), rank(p + L, L)), from eight bytes taken as they are up to
the threshold.  After a Spark round over sorted rank ranges, positions whose rank is unique in the corpus leave.

Rounds.  All ranks of all positions would be many times the input.  The first round (at ``seed_length``) therefore
sorts, for every window of positions that a string of the threshold length spans, only the smallest rank in it: two
equal strings have the same smallest rank inside, so a position whose window minimum is unique is unique itself.  The
last round sorts the rank pairs (rank(p), rank(p + offset)) at the threshold for every position left.  Ranks are 64-bit
names rather than consecutive numbers, which need no global numbering; only their equality is used.

Defined results: null text is empty; null ids come back null; repeated ids are separate documents; matches never cross
documents; all copies of a repeated string go, the first included.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from veilink.llm import chunks, words
from veilink.llm.chunks import Chunk
from veilink.sources.store import store

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
STATE = RESULT + ", " + chunks.CHUNK_SCHEMA


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank at ``length`` (a power of two, 8 at least) of every position; the last ones reach into zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    out = words.mix(np.ascontiguousarray(eight).view("<u8").ravel())
    reach = 8
    while reach < length:
        out = words.pair(out, words.shifted(out, reach))
        reach *= 2
    return out


def _slide(x: np.ndarray, width: int, best, worst: int) -> np.ndarray:
    """best(x[s : s + width]) at every s, from running values within blocks of ``width``."""
    n = len(x)
    blocks = -(-(n + width) // width)
    full = np.full(blocks * width, worst, np.uint64)
    full[:n] = x
    full = full.reshape(blocks, width)
    ahead = best.accumulate(full, axis=1).ravel()
    behind = best.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def _room(offsets: np.ndarray) -> np.ndarray:
    """How many bytes of its document begin at every position."""
    return np.repeat(offsets[1:], np.diff(offsets)) - np.arange(offsets[-1])


def _minima(chunk: Chunk, length: int, seed: int):
    """Starts with room for the whole string, the least seed rank in each one's string, and the picked ranks."""
    width = length - seed + 1
    found: tuple[list, list, list] = ([np.zeros(0, bool)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
    for data, offsets, _ in chunk.runs():
        names = ranks(data, seed)
        starts = _room(offsets) >= length
        least = _slide(names, width, np.minimum, 2**64 - 1)
        # a position is picked if it is the least of some string that contains it
        asked = np.where(starts, least, 0)
        back = _slide(asked[::-1], width, np.maximum, 0)[::-1]
        for to, part in zip(found, (starts, least, names[(back == names) & (back > 0)]), strict=True):
            to.append(part)
    return tuple(map(np.concatenate, found))


def _pair_ranks(names: np.ndarray, places: np.ndarray, seed: int, length: int) -> np.ndarray:
    """Ranks at ``length`` of some places, from the ranks at ``seed`` of all: pairs at growing offsets."""

    def at(p: np.ndarray, span: int) -> np.ndarray:
        return names[p] if span == seed else words.pair(at(p, span // 2), at(p + span // 2, span // 2))

    reach = seed
    while 2 * reach <= length:
        reach *= 2
    full = at(places, reach)
    return full if reach == length else words.pair(full, at(places + length - reach, reach))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, seed_length: int = 128
) -> DataFrame:
    """One row per document: its bytes, those covered by repeated strings of ``length`` bytes, runs, digest of the rest."""
    if length < 2 * seed_length or seed_length < 8 or seed_length & (seed_length - 1):
        raise ValueError("seed_length is a power of two from 8 to half the length")
    base = chunks.write_chunks(docs, id_col, text_col, "bytes")

    def seed_keys(chunk: Chunk):
        return words.distinct(_minima(chunk, length, seed_length)[2]), None

    def narrow(chunk: Chunk, said: np.ndarray) -> list[dict]:
        starts, least, picked = _minima(chunk, length, seed_length)
        found, count = np.unique(picked, return_counts=True)
        twice = (said > 0) | (count > 1)
        alive = np.zeros(len(chunk.data), bool)
        places = np.flatnonzero(starts)
        if len(places):  # one look-up for each stretch with the same minimum
            values = least[places]
            turn = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            alive[places] = np.repeat(twice[np.searchsorted(found, values[turn])], np.diff(np.append(turn, len(values))))
        seen = np.concatenate(([0], np.cumsum(alive)))
        live = seen[chunk.offsets[1:]] > seen[chunk.offsets[:-1]]
        rows = _rows(chunk, ~live, np.zeros(len(chunk.data), bool))
        if live.any():
            rows.append(chunks.keep_documents(chunk, live, chunk.offsets, alive).row())
        return rows

    def last_names(chunk: Chunk):
        places, named = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for data, _, begin in chunk.runs():
            here = np.flatnonzero(chunk.alive[begin : begin + len(data)])
            if len(here):
                places.append(here + begin)
                named.append(_pair_ranks(ranks(data, seed_length), here, seed_length, length))
        return np.concatenate(places), np.concatenate(named)

    def last_keys(chunk: Chunk):
        return words.distinct(last_names(chunk)[1]), None

    def close(chunk: Chunk, said: np.ndarray) -> list[dict]:
        places, names = last_names(chunk)
        _, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
        twice = ((said > 0) | (count > 1))[inverse]
        gone = words.cover(places[twice], length, len(chunk.data))
        return _rows(chunk, np.ones(len(chunk.ids), bool), gone)

    total = base.seen["bytes"]
    answers = chunks.ask(base.frame, seed_keys, chunks.range_bits(2 * total / (length - seed_length)), 4, chunks.repeated)
    state = store(
        chunks.told(base.frame, answers, narrow, STATE), "bytes-seeded",
        bytes=F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)),
    )
    base.drop()
    out = state.frame.where(F.col("chunk").isNull()).select(*chunks.names(RESULT))
    if state.seen["bytes"]:
        table = state.frame.where(F.col("chunk").isNotNull()).select(*chunks.names(chunks.CHUNK_SCHEMA))
        answers = chunks.ask(table, last_keys, chunks.range_bits(state.seen["bytes"]), 6, chunks.repeated)
        out = out.unionByName(chunks.told(table, answers, close, RESULT))
    return out


def _rows(chunk: Chunk, which: np.ndarray, gone: np.ndarray) -> list[dict]:
    rows = []
    removed = np.concatenate(([0], np.cumsum(gone)))
    for i in np.flatnonzero(which):
        lo, hi = chunk.offsets[i], chunk.offsets[i + 1]
        n_gone, spans, kept = int(removed[hi] - removed[lo]), 0, chunk.text(i)
        if n_gone:
            mask = gone[lo:hi]
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            kept = chunk.data[lo:hi][~mask].tobytes()
        rows.append({
            "doc_id": None if chunk.ids[i] == chunks.NO_ID else int(chunk.ids[i]),
            "n_bytes": int(hi - lo), "n_removed": n_gone, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(),
        })
    return rows
