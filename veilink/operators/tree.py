"""Multibit-tree index over distinct filters.

A node is split by the bit whose count of ones is nearest to half of the node's records, the lowest such
bit on ties; rows with the bit go to child '1', the others to child '0'.  A child is split again while it
holds more than ``group`` records and more than one distinct filter.  A leaf therefore holds at most
``group`` distinct filters.

The upper tree is built breadth-first by joins and aggregates: one job per level counts (node, bit) over
the open nodes and writes the level's splits.  Rows are not rewritten per level; they find their node by
joining the split tables written so far, several levels to a join.  Every ``regroup_every`` levels the rows are written once,
range-partitioned by (node, filter hash), so that counts combine before the shuffle and a big node still
spreads over many tasks.  A node of at most ``subtree_rows`` distinct
filters is finished by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import bitwords
from ..sources.store import BROADCAST_BYTES, Stored, store
from .distinct import DistinctFilters
from .subtree import bit_matrix, count_batches, grow, word_matrix

SPLIT_ROW_BYTES = 160
HOPS = 6
SUBTREE_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class Tree:
    """``levels``: written splits of the upper tree; ``placed``: (config_id, id_a, words, copies, ord, root)."""

    levels: list[Stored]
    placed: DataFrame
    group: int


def hop_table(levels: list[Stored]) -> DataFrame:
    """Consecutive levels as one row per node of the first: (config_id, path, hops).

    ``hops`` holds the split bits of the node and its descendants in heap order, null where there is none.
    """
    # All nodes of a level lie at its depth.
    base = levels[0].seen["depth"]
    nodes = None
    for level in levels:
        rows = level.frame.selectExpr(
            "config_id",
            f"substring(node_path, 1, {base}) as path",
            f"cast(conv(concat('1', substring(node_path, {base + 1})), 2, 10) as int) - 1 as hop",
            "bit",
        )
        nodes = rows if nodes is None else nodes.unionByName(rows)
    by_hop = nodes.groupBy("config_id", "path").agg(F.expr("map_from_entries(collect_list(struct(hop, bit))) as m"))
    every = 2 ** len(levels) - 2
    return by_hop.selectExpr("config_id", "path", f"transform(sequence(0, {every}), k -> m[k]) as hops")


def descend(rows: DataFrame, levels: list[Stored], path: str = "path") -> DataFrame:
    """Walk rows down the upper tree; the node reached is kept in ``path``.

    ``HOPS`` levels at a time cost one join; a heap position plus one, in binary, is '1' and the turns.
    """
    turn = bitwords.bit_test("words", "get(hops, i)")
    step = f"(i, x) -> if(get(hops, i) is null, i, 2 * i + 1 + cast({turn} as int))"
    columns = rows.columns
    for start in range(0, len(levels), HOPS):
        chunk = levels[start : start + HOPS]
        table = hop_table(chunk).withColumnRenamed("path", path)
        if chunk[0].rows * (64 + 4 * 2 ** len(chunk)) <= BROADCAST_BYTES:
            table = F.broadcast(table)
        walked = f"aggregate(sequence(1, {len(chunk)}), 0, {step})"
        moved = f"if(hops is null, {path}, concat({path}, substring(bin({walked} + 1), 2))) as {path}"
        rows = rows.join(table, ["config_id", path], "left").selectExpr(*[moved if c == path else c for c in columns])
    return rows


def open_rows(rows: DataFrame, last: Stored | None, totals: DataFrame, depth: int, group: int, limit: int) -> DataFrame:
    """Rows in the open nodes of a level, with the node's records ``n`` and distinct filters ``d``."""
    if last is None:
        known = rows.join(F.broadcast(totals), "config_id")
        return known.where((F.col("n") > 0) & (F.col("d") > limit))
    parents = last.small_side(SPLIT_ROW_BYTES).selectExpr(
        "config_id", "node_path as parent", "n as p_n", "d as p_d", "ones", "ones_d"
    )
    here = rows.where(F.length("path") == depth).withColumn("parent", F.expr(f"substring(path, 1, {depth - 1})"))
    right = "right(path, 1) = '1'"
    known = here.join(parents, ["config_id", "parent"]).selectExpr(
        *rows.columns, f"if({right}, ones, p_n - ones) as n", f"if({right}, ones_d, p_d - ones_d) as d"
    )
    return known.where((F.col("n") > group) & (F.col("d") > limit))


COUNT_SCHEMA = "config_id int, path string, n bigint, d bigint, bit int, ones bigint, ones_d bigint"


def bit_counts(open_rows: DataFrame, size: int) -> DataFrame:
    """Records and distinct filters having each bit, per node.

    A row holds a hundred and more set bits, so exploding them costs two orders more rows than it has.
    Each task instead adds up its rows' bits as arrays and hands one partial count per (node, bit) to an
    ordinary sum.
    """

    def partial(batches):
        return count_batches(batches, size)

    rows = open_rows.select("config_id", "path", "n", "d", "copies", "words")
    parts = rows.mapInArrow(partial, COUNT_SCHEMA)
    return parts.groupBy("config_id", "path", "n", "d", "bit").agg(
        F.sum("ones").alias("ones"), F.sum("ones_d").alias("ones_d")
    )


def choose_splits(counts: DataFrame) -> DataFrame:
    """The bit nearest to an even split, lowest on ties; a bit that all or none have splits nothing."""
    gap = F.abs(F.col("ones") * 2 - F.col("n"))
    best = F.min(F.struct(gap.alias("gap"), "bit", "ones", "ones_d")).alias("best")
    chosen = counts.where(F.col("ones") < F.col("n")).groupBy("config_id", "path", "n", "d").agg(best)
    return chosen.select(
        "config_id", F.col("path").alias("node_path"), "best.bit", "n", "d", "best.ones", "best.ones_d"
    )


def _open(n, d, group: int, limit: int):
    return (n > group) & (d > F.lit(limit))


def build_tree(
    distinct: DistinctFilters,
    size: int,
    group: int = 5,
    subtree_rows: int | None = None,
    min_levels: int = 3,
    regroup_every: int = HOPS,
    max_levels: int | None = None,
) -> Tree:
    """Build the upper tree; the first ``min_levels`` levels are always built by joins and aggregates.

    The root is split even if it holds ``group`` records or fewer, so there is at least one such level.
    ``subtree_rows`` is by default what unpacks to ``SUBTREE_BYTES`` in a task.  ``max_levels`` stops early and is meant
    for looking at the first splits.
    """
    min_levels = max(1, min_levels)
    subtree_rows = subtree_rows or max(4096, SUBTREE_BYTES // max(1, size))
    filters = distinct.filters.frame
    # One row per configuration.
    roots = filters.groupBy("config_id").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("d")).collect()
    totals = filters.sparkSession.createDataFrame(roots, "config_id int, n bigint, d bigint")
    rows = filters.withColumn("path", F.lit(""))
    levels: list[Stored] = []
    pending: list[Stored] = []
    depth = 0
    open_nodes = sum(1 for r in roots if r.d > 1)
    while open_nodes and (max_levels is None or depth < max_levels):
        if len(pending) == regroup_every:
            placed = descend(rows, pending).repartitionByRange("config_id", "path", F.xxhash64("words"))
            rows, pending = store(placed, "placed").frame, []
        limit = 1 if depth < min_levels else subtree_rows
        here = open_rows(descend(rows, pending), levels[-1] if levels else None, totals, depth, group, limit)
        splits = choose_splits(bit_counts(here, size))
        below = 1 if depth + 1 < min_levels else subtree_rows
        left, left_d = F.col("n") - F.col("ones"), F.col("d") - F.col("ones_d")
        still_open = F.count_if(_open(F.col("ones"), F.col("ones_d"), group, below)) + F.count_if(
            _open(left, left_d, group, below)
        )
        level = store(splits, f"splits-{depth}", open_children=still_open, depth=F.max(F.length("node_path")))
        levels.append(level)
        pending.append(level)
        open_nodes = level.seen["open_children"]
        depth += 1
    placed = descend(rows, pending).withColumnRenamed("path", "root")
    return Tree(levels, placed, group)


SPLIT_SCHEMA = "config_id int, node_path string, bit int"


def _by_root(tree: Tree):
    return tree.placed.groupBy("config_id", "root")


def leaf_of(tree: Tree) -> DataFrame:
    """Leaf of every distinct filter: (config_id, id_a, node_path)."""
    group = tree.group

    def finish(key, rows):
        sub = grow(bit_matrix(word_matrix(rows["words"])), rows["copies"].to_numpy(), group)
        root = key[1].as_py()
        paths = np.array([root + p for p in sub.path], dtype=object)[sub.leaf_of]
        return pa.table({"config_id": rows["config_id"], "id_a": rows["id_a"], "node_path": pa.array(paths, pa.string())})

    schema = T.StructType([*(tree.placed.schema[c] for c in ("config_id", "id_a")), T.StructField("node_path", T.StringType())])
    return _by_root(tree).applyInArrow(finish, schema)


def leaf_members(tree: Tree, distinct: DistinctFilters) -> DataFrame:
    """Leaf of every record of A: (config_id, id, node_path)."""
    leaves = leaf_of(tree)
    firsts = leaves.select("config_id", F.col("id_a").alias("id"), "node_path")
    others = distinct.aliases().join(leaves, ["config_id", "id_a"]).select("config_id", F.col("member").alias("id"), "node_path")
    return firsts.unionByName(others)


def splits_of(tree: Tree) -> DataFrame:
    """All inner nodes of the tree: (config_id, node_path, bit)."""
    group = tree.group

    def finish(key, rows):
        sub = grow(bit_matrix(word_matrix(rows["words"])), rows["copies"].to_numpy(), group)
        inner = np.flatnonzero(sub.bit >= 0)
        root = key[1].as_py()
        return pa.table(
            {
                "config_id": pa.array([key[0].as_py()] * len(inner), pa.int32()),
                "node_path": pa.array([root + sub.path[i] for i in inner], pa.string()),
                "bit": pa.array(sub.bit[inner].astype(np.int32), pa.int32()),
            }
        )

    lower = _by_root(tree).applyInArrow(finish, SPLIT_SCHEMA)
    for level in tree.levels:
        lower = lower.unionByName(level.frame.select("config_id", "node_path", "bit"))
    return lower
