"""Array kernels that run inside tasks, on groups whose size is bounded beforehand."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The kernels travel to the executors with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def word_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list<int64> column of equal lengths as an (n, words) matrix, unsigned for counting bits."""
    rows = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype("<i8", copy=False).view("<u8")


def bit_matrix(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


SHORT_SEGMENT = 12
FLUSH_BYTES = 64 * 1024 * 1024


def segment_counts(bits: np.ndarray, copies: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run of rows (beginning at ``starts``) and bit: records and rows that have the bit.

    Most rows stand for one record, so rows are counted in 32 bits and only the surplus of repeated
    filters is weighted.
    """
    ends = np.append(starts[1:], len(bits))
    if len(bits) < SHORT_SEGMENT * len(starts):
        rows = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    else:
        rows = np.stack([bits[s:e].sum(axis=0, dtype=np.int32) for s, e in zip(starts.tolist(), ends.tolist())])
    records = rows.astype(np.int64)
    repeated = np.flatnonzero(copies > 1)
    if repeated.size:
        run = np.searchsorted(starts, repeated, side="right") - 1
        runs, at = np.unique(run, return_index=True)
        surplus = bits[repeated] * (copies[repeated] - 1)[:, None]
        records[runs] += np.add.reduceat(surplus, at, axis=0)
    return records, rows.astype(np.int64)


def count_batches(batches, size: int):
    """Partial counts of a partition: rows (config_id, path, n, d, bit, ones, ones_d) from record batches.

    Counts are kept per node over the batches and handed out whenever they outgrow ``FLUSH_BYTES``; the
    sums of the parts are the same however often that happens.
    """
    held: dict = {}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        config = rows["config_id"].to_numpy()
        encoded = rows["path"].combine_chunks().dictionary_encode()
        paths = encoded.dictionary.to_pylist()
        code = config.astype(np.int64) * len(paths) + encoded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        bits = bit_matrix(word_matrix(rows["words"]))[order, :size]
        records, distinct = segment_counts(bits, rows["copies"].to_numpy()[order], starts)
        first = order[starts]
        n, d = rows["n"].to_numpy(), rows["d"].to_numpy()
        for at, row in enumerate(first.tolist()):
            key = (int(config[row]), paths[encoded.indices[row].as_py()], int(n[row]), int(d[row]))
            if key in held:
                held[key][0] += records[at]
                held[key][1] += distinct[at]
            else:
                held[key] = [records[at], distinct[at]]
        if len(held) * size * 16 > FLUSH_BYTES:
            yield _count_rows(held)
            held = {}
    if held:
        yield _count_rows(held)


def _count_rows(held: dict) -> pa.RecordBatch:
    records = np.stack([v[0] for v in held.values()])
    distinct = np.stack([v[1] for v in held.values()])
    node, bit = np.nonzero(distinct)
    keys = list(held)
    taken = pa.array(node)
    columns = [
        pa.array([k[0] for k in keys], pa.int32()).take(taken),
        pa.array([k[1] for k in keys], pa.string()).take(taken),
        pa.array([k[2] for k in keys], pa.int64()).take(taken),
        pa.array([k[3] for k in keys], pa.int64()).take(taken),
        pa.array(bit.astype(np.int32)),
        pa.array(records[node, bit]),
        pa.array(distinct[node, bit]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["config_id", "path", "n", "d", "bit", "ones", "ones_d"])


@dataclass
class Subtree:
    """Nodes in creation order; ``bit`` is -1 at a leaf, children are ``child`` (0) and ``child + 1`` (1)."""

    path: list[str]
    bit: np.ndarray
    child: np.ndarray
    leaf_of: np.ndarray

    def route(self, bits: np.ndarray) -> np.ndarray:
        """Leaf of every row of another table."""
        node = np.zeros(len(bits), dtype=np.int64)
        open_rows = np.flatnonzero(self.bit[node] >= 0)
        while open_rows.size:
            at = node[open_rows]
            node[open_rows] = self.child[at] + bits[open_rows, self.bit[at]]
            open_rows = open_rows[self.bit[node[open_rows]] >= 0]
        return node


def grow(bits: np.ndarray, copies: np.ndarray, group: int) -> Subtree:
    """Split distinct filters level by level until a node holds at most ``group`` records or one filter.

    All open nodes of a level are counted together: rows sorted by node, one segmented sum per level.
    """
    node = np.zeros(len(bits), dtype=np.int64)
    path, bit, child = [""], [-1], [-1]
    rows = np.arange(len(bits))
    while rows.size:
        rows = rows[np.argsort(node[rows], kind="stable")]
        nodes, starts, distinct = np.unique(node[rows], return_index=True, return_counts=True)
        totals = np.add.reduceat(copies[rows], starts)
        live = (totals > group) & (distinct > 1)
        if not live.any():
            break
        keep = np.repeat(live, distinct)
        rows, nodes, totals, distinct = rows[keep], nodes[live], totals[live], distinct[live]
        starts = np.concatenate(([0], np.cumsum(distinct)[:-1]))
        ones, _ = segment_counts(bits[rows], copies[rows], starts)
        gap = np.abs(2 * ones - totals[:, None])
        gap[(ones == 0) | (ones == totals[:, None])] = np.iinfo(np.int64).max
        best = gap.argmin(axis=1)
        first_child = len(path) + 2 * np.arange(len(nodes))
        for number, chosen, down in zip(nodes.tolist(), best.tolist(), first_child.tolist()):
            bit[number], child[number] = chosen, down
            path += [path[number] + "0", path[number] + "1"]
            bit += [-1, -1]
            child += [-1, -1]
        turn = bits[rows, np.repeat(best, distinct)]
        node[rows] = np.repeat(first_child, distinct) + turn
    return Subtree(path, np.array(bit), np.array(child), node)


def pair_up(leaf_a: np.ndarray, leaf_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every b row the a rows of its leaf, in a's order: (a index, b index, pairs per b row)."""
    by_leaf = np.argsort(leaf_a, kind="stable")
    sorted_leaf = leaf_a[by_leaf]
    low = np.searchsorted(sorted_leaf, leaf_b, side="left")
    per_b = np.searchsorted(sorted_leaf, leaf_b, side="right") - low
    b = np.repeat(np.arange(len(leaf_b)), per_b)
    within = np.arange(len(b)) - np.repeat(np.cumsum(per_b) - per_b, per_b)
    return by_leaf[np.repeat(low, per_b) + within], b, per_b


def dice_of(words_a: np.ndarray, words_b: np.ndarray) -> np.ndarray:
    """Row-wise Dice; NaN when both rows are empty."""
    both = np.bitwise_count(words_a & words_b).sum(axis=1, dtype=np.int64)
    total = np.bitwise_count(words_a).sum(axis=1, dtype=np.int64) + np.bitwise_count(words_b).sum(axis=1, dtype=np.int64)
    with np.errstate(invalid="ignore"):
        return 2.0 * both / total


def best_in_tile(bits_a: np.ndarray, bits_b: np.ndarray, step: int = 512, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """First best a row for every b row of a tile: (index, dice); index -1 if no Dice is positive.

    Among a rows of one cardinality the most common bits decide, so only the best of each cardinality becomes a Dice.
    """
    ones_a = bits_a.sum(axis=1, dtype=np.int64)
    order = np.argsort(ones_a, kind="stable")
    left = np.ascontiguousarray(bits_a[order].T, dtype=np.float32)
    edges = np.flatnonzero(np.diff(ones_a[order], prepend=-1, append=-1)).tolist()
    runs = [(lo, min(lo + width, end)) for begin, end in zip(edges[:-1], edges[1:]) for lo in range(begin, end, width)]
    index = np.full(len(bits_b), -1, dtype=np.int64)
    score = np.zeros(len(bits_b))
    for start in range(0, len(bits_b), step):
        rows = bits_b[start : start + step]
        right, ones_b, each = rows.astype(np.float32), rows.sum(axis=1, dtype=np.int64), np.arange(len(rows))
        best, first = np.zeros(len(rows)), np.full(len(rows), len(bits_a))
        for lo, hi in runs:
            both = right @ left[:, lo:hi]
            at = both.argmax(axis=1)
            total = ones_b + ones_a[order[lo]]
            dice = np.divide(2.0 * both[each, at].astype(np.float64), total, out=np.zeros(len(rows)), where=total > 0)
            row = order[lo + at]
            better = (dice > best) | ((dice == best) & (row < first))
            best, first = np.where(better, dice, best), np.where(better, row, first)
        index[start : start + step] = np.where(best > 0, first, -1)
        score[start : start + step] = best
    return index, score
