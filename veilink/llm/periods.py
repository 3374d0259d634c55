"""Periodic runs of words by string synchronising sets.

A *run* is a stretch with smallest period q and at least 2 q words that no neighbouring word extends.  At each dyadic scale
t a position is *synchronising* if, of the names of the t-word windows that begin in [i, i + t], the smallest is the first
or the last.  This depends on the 2 t words from i alone (its *context*), so of two places with equal contexts either both
are chosen or none.  Windows with a period up to t / 3 take no part.

* In a run with 3 t - 1 <= q < 6 t - 1 the places i and i + q have equal contexts, and unless a whole period of it is itself
  highly periodic one of them is chosen.  Equal contexts propose their distance; contexts are not highly periodic, so only
  some 18 of a kind begin within 6 t words, and all their pairs are tried.
* Periods below the smallest scale come from direct comparison at offsets 1 to 4.
* What is left are runs whose period is a stretch of a smaller period p.  Two maximal stretches of period p then touch, and
  the periods of such runs differ by multiples of p: they are listed from the touching pair.

Every proposal is extended word by word on exact word numbers, so a proposal can be wrong and a run cannot.

Documents are independent, so nothing is shuffled; a task works on some hundred thousand words at a time, or on one longer
document.  Defined results: a null text has no words; null ids and rows that repeat an id are documents like others; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilink.llm import words

LEAST = 12
GROUP_WORDS = 200_000
DIRECT = 4
WORD = r"[^\x20\x09-\x0D]+"
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUN), ("collapsed", pa.string())])
NEVER = np.uint64(2**64 - 1)


class Numbers(dict):
    """A number for every different word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width] at every i, from running minima within blocks of ``width``."""
    blocks = -(-len(x) // width) + 1
    full = np.full(blocks * width, NEVER)
    full[: len(x)] = x
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x)], ahead[width - 1 : width - 1 + len(x)])


def _extend(t: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch [start, end) around i in which words q apart are equal; empty if those at i differ."""
    lo = hi = i
    n, step = len(t) - q, 32
    while hi < n:
        same = t[hi : min(hi + step, n)] == t[hi + q : min(hi + step, n) + q]
        if not same.all():
            hi += int(same.argmin())
            break
        hi, step = hi + len(same), 2 * step
    step = 32
    while lo > 0:
        at = max(0, lo - step)
        same = t[at:lo] == t[at + q : lo + q]
        if not same.all():
            lo -= int(same[::-1].argmin())
            break
        lo, step = at, 2 * step
    return lo, hi + q


def _direct(t: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of the runs of a small period, by comparing words q apart."""
    same = np.concatenate(([False], t[q:] == t[:-q], [False])) if len(t) > q else np.zeros(1, bool)
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] >= q]
    return np.column_stack((edge[:, 0], edge[:, 1] + q, np.full(len(edge), q)))


def _synchronising(names: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """The chosen positions at scale t; ``names`` name the t-word windows, ``runs`` hold all of period up to t / 3."""
    own = names.copy()
    low = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    if len(low):
        edge = np.zeros(len(own) + 1, np.int32)
        np.add.at(edge, low[:, 0], 1)
        np.subtract.at(edge, low[:, 1] - t + 1, 1)
        own[np.cumsum(edge[:-1]) > 0] = NEVER
    least = _least(own, t + 1)
    at = np.arange(len(own) - 2 * t + 1)
    least = least[: len(at)]
    return at[(least != NEVER) & ((own[: len(at)] == least) | (own[t : t + len(at)] == least))]


def _proposed(contexts: np.ndarray, chosen: np.ndarray, t: int) -> np.ndarray:
    """(i, distance) of chosen positions with equal contexts, 3 t - 1 to 6 t - 2 apart; of a chain its first place."""
    order = np.argsort(contexts[chosen], kind="stable")
    places = chosen[order]
    named = contexts[places]
    found = [np.zeros((0, 2), np.int64)]
    for k in range(1, len(places)):
        apart = places[k:] - places[:-k]
        near = (named[k:] == named[:-k]) & (apart < 6 * t - 1)
        if not near.any():
            break
        fits = near & (apart >= 3 * t - 1)
        found.append(np.column_stack((places[:-k][fits], apart[fits])))
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (np.diff(pairs[:, 1]) != 0) | (np.diff(pairs[:, 0]) > 2 * t)
    return pairs[fresh]


def _across(t: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs whose period is itself a long stretch of a smaller one: from stretches of one period that touch."""
    long = runs[runs[:, 1] - runs[:, 0] >= 8 * runs[:, 2]]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    found = []
    touch = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1]))
    for (l1, r1, p), (l2, r2, _) in zip(long[touch].tolist(), long[touch + 1].tolist(), strict=True):
        last, next_ = t[r1 - p : r1].tobytes(), t[l2 : l2 + 2 * p].tobytes()
        at = next_.find(last)
        while at % 8 and at >= 0:
            at = next_.find(last, at + 1)
        if at < 0:
            continue
        first = (l2 + at // 8 - (r1 - p)) % p or p
        for q in range(first, min(r1 - l1, r2 - l2, (r2 - l1) // 2) + 1, p):
            lo, hi = _extend(t, max(l1, l2 - q), q)
            if hi - lo >= 2 * q:
                found.append((lo, hi, q))
    return found


def runs_of(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs in documents that stand side by side, each closed by a number of its own.

    ``bounds`` are the documents' first places, and the end.
    """
    found = np.concatenate([_direct(t, q) for q in range(1, DIRECT + 1)])
    sizes, first = np.diff(bounds), bounds[:-1]
    back = np.arange(len(t))  # where the places of the documents that are left were
    seq, scale = t, 2
    names = words.mix(t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C17) + np.uint64(11))
    names = words.pair(names, words.shifted(names, 1))
    here = found
    while True:
        stay = sizes - 1 >= 2 * (3 * scale - 1)
        if not stay.any():
            break
        if not stay.all():  # shorter documents have no such run
            keep = np.repeat(stay, sizes)
            moved = np.cumsum(keep) - 1
            seq, names, back = seq[keep], names[keep], back[keep]
            here = here[keep[here[:, 0]]]
            here = np.column_stack((moved[here[:, 0]], moved[here[:, 1] - 1] + 1, here[:, 2]))
            sizes = sizes[stay]
            first = np.cumsum(sizes) - sizes
        contexts = words.pair(names, words.shifted(names, scale))
        chosen = _synchronising(names, scale, here)
        new, end, period = [], 0, 0
        for i, q in _proposed(contexts, chosen, scale).tolist():
            if q == period and i < end - q:
                continue  # within the run found last
            lo, hi = _extend(seq, i, q)
            if hi - lo >= 2 * q:
                new.append((lo, hi, q))
                end, period = hi, q
        if new:
            new = _smallest(np.array(new, np.int64))
            here = _smallest(np.concatenate((here, new)))
            found = np.concatenate((found, np.column_stack((back[new[:, 0]], back[new[:, 1] - 1] + 1, new[:, 2]))))
        names, scale = contexts, 2 * scale
    found = _smallest(found)
    across = _across(t, found)
    return _smallest(np.concatenate((found, np.array(across, np.int64)))) if across else found


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period, by start and then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _group(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[dict], bytes]]:
    """Runs (as start, length, period) and the words outside repeats, for each document."""
    numbers = Numbers()
    sizes = np.array([len(w) + 1 for w in texts])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    t = np.empty(bounds[-1], np.int64)
    for k, w in enumerate(texts):
        t[bounds[k] : bounds[k + 1] - 1] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
        t[bounds[k + 1] - 1] = -1 - k
    runs = runs_of(t, bounds)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    cut = np.searchsorted(runs[:, 0], bounds)
    for k, w in enumerate(texts):
        own = runs[cut[k] : cut[k + 1]] - [bounds[k], bounds[k], 0]
        if len(own):
            edge = np.zeros(len(w) + 1, np.int32)
            np.add.at(edge, own[:, 0] + own[:, 2], 1)
            np.subtract.at(edge, own[:, 1], 1)
            w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        yield [{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()], b" ".join(w)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: its words, its runs of ``least`` words or more by start and period, and its collapsed text.

    The collapsed text has the words that no run holds beyond its first period, joined by single spaces.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            found = list(_group([w for _, w in held], least))
            columns = [[i for i, _ in held], [len(w) for _, w in held], [r for r, _ in found], [c.decode() for _, c in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                split = (texts[i].as_py() or b"").split()
                held.append((id_, split))
                total += len(split)
                if total >= GROUP_WORDS or len(held) >= 20_000:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(find, FOUND)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): for every tenth id by checksum a text that from some word on repeats what begins there.

    The place and the period follow from the id's checksum and the number of words; such a text has single spaces.  Other
    texts, and those of null ids, stay as they are.
    """
    chosen, g = F.col("_sum") % 10 == 0, F.floor(F.col("_sum") / 10)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = slim.withColumn("_sum", F.crc32(F.col("doc_id").cast("string")))
    split = split.withColumn("_words", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    split = split.withColumn("_n", F.greatest(F.size("_words"), F.lit(1)).cast("long")).withColumn("_a", g % F.col("_n"))
    left = F.col("_n") - F.col("_a")
    split = split.withColumn("_p", 1 + F.floor(left / (3 + g % 8)))
    joined = lambda start, n: F.nullif(F.array_join(F.slice("_words", start.cast("int"), n.cast("int")), " "), F.lit(""))
    turn, turns = joined(F.col("_a") + 1, F.col("_p")), F.floor(left / F.col("_p")).cast("int")
    parts = (joined(F.lit(1), F.col("_a")), F.rtrim(F.repeat(F.concat(turn, F.lit(" ")), turns)), joined(F.col("_a") + 1, left % F.col("_p")))
    return split.select("doc_id", F.when(chosen, F.concat_ws(" ", *parts)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and checksums instead of runs and text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    length, period = -F.col("_best.less"), F.col("_best.period")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
