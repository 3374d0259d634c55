import random
import tracemalloc

import model
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilink.functions.bitwords import set_bits
from veilink.operators import match, tree
from veilink.operators.distinct import distinct_filters, last_per_id
from veilink.operators.encode import block_filter, codebook, encode, gather_lists
from veilink.operators.match import best_of, candidate_map, candidates_long, pair_dice, search_all, search_tree
from veilink.operators.subtree import best_in_tile, bit_matrix, grow
from veilink.operators.tree import build_tree, leaf_members, leaf_of, splits_of
from veilink.sources.sweep import LinkConfig

PEOPLE = [
    (1, "MARIA DA SILVA", "JOSÉ GONÇALVES", "01/02/1990", "3550308"),
    (2, "ÉRICA", "", "31/12/1999", "10"),
    (3, None, "ANA", None, ""),
    (4, None, None, None, None),
    (5, "ÉRICA", "", "31/12/1999", "10"),
]
COLUMNS = ["name", "guardian", "birth_date", "city_code"]


def people(spark, rows=PEOPLE):
    return spark.createDataFrame(rows, "id bigint, name string, guardian string, birth_date string, city_code string")


def filters_of(spark, config):
    df = people(spark)
    encoded = encode(df, COLUMNS, [config], codebook([df], [COLUMNS], [config]), ["id"])
    assert encoded.count() == len(PEOPLE)
    found = {row[0]: set() for row in PEOPLE}
    for r in set_bits(encoded, config.size).collect():
        found[r.id].add(r.bit)
    return found


@pytest.mark.parametrize("family", ["DoubleHash", "TripleHash", "EnhancedDHash"])
@pytest.mark.parametrize("encoding", ["ABF", "CLK"])
def test_encodings(spark, family, encoding):
    config = LinkConfig(m=100, k=3, hash=family, encoding=encoding)
    found = filters_of(spark, config)
    for key, *values in PEOPLE:
        want = (
            model.attribute_filter(values, 100, 3, family)
            if encoding == "ABF"
            else model.shared_filter(values, 400, 3, family)
        )
        assert found[key] == want


def test_record_level_encoding(spark):
    config = LinkConfig(m=100, k=2, hash="TripleHash", encoding="RLB", rlb_share=0.4)
    gather = [(r.src, r.dst) for r in gather_lists(spark, [config]).collect()]
    assert sorted(d for _, d in gather) == list(range(400))
    assert all(s % 100 != 99 for s, _ in gather)
    assert max(len({s for s, _ in gather if s // 100 == i}) for i in range(4)) <= 40
    found = filters_of(spark, config)
    for key, *values in PEOPLE:
        source = model.attribute_filter(values, 100, 2, "TripleHash")
        assert found[key] == {d for s, d in gather if s in source}


def test_block_filter(spark):
    got = {r.id: r.block for r in block_filter(people(spark), "name").collect()}
    for key, name, *_ in PEOPLE:
        bits = model.shared_filter([name], 30, 3, "DoubleHash")
        assert got[key] == sum(1 << b for b in bits)


def random_filters(seed, n, size=60, hot=0):
    draw = random.Random(seed)
    rows = [(i, frozenset(b for b in range(size) if draw.random() < 0.3)) for i in range(n)]
    if hot:
        rows += [(n + i, rows[0][1]) for i in range(hot)]
    return rows


def frame(spark, rows, words=1, **extra):
    columns = "config_id int, id bigint, words array<bigint>"
    return spark.createDataFrame([(1, i, model.to_words(b, words)) for i, b in rows], columns)


TREES = [
    {},
    {"min_levels": 0, "subtree_rows": 1_000_000},
    {"min_levels": 1, "subtree_rows": 1, "regroup_every": 2},
    {"min_levels": 2, "subtree_rows": 7, "regroup_every": 3},
]


@pytest.mark.parametrize("options", TREES, ids=lambda o: "-".join(f"{k}{v}" for k, v in o.items()) or "default")
def test_leaves_match_recursion(spark, options):
    rows = random_filters(3, 150, hot=40)
    distinct = distinct_filters(frame(spark, rows))
    tree = build_tree(distinct, 60, **options)
    got = {r.id: r.node_path for r in leaf_members(tree, distinct).collect()}
    assert got == model.leaves(rows)
    inner = {r.node_path: r.bit for r in splits_of(tree).collect()}
    paths = set(got.values())
    assert set(inner) == {p[:i] for p in paths for i in range(len(p))}
    assert inner[""] == model.split_bit(rows)


@pytest.mark.parametrize("seed", range(4))
def test_tree_does_not_depend_on_partitions(spark, seed):
    rows = random_filters(seed, 60 + 10 * seed, hot=3 * seed)
    want = model.leaves(rows)
    for parts in (1, 17):
        distinct = distinct_filters(frame(spark, rows).repartition(parts))
        tree = build_tree(distinct, 60, subtree_rows=16)
        assert {r.id: r.node_path for r in leaf_members(tree, distinct).collect()} == want
        per_leaf = leaf_of(tree).groupBy("node_path").count().collect()
        assert max(r["count"] for r in per_leaf) <= 5


def test_small_and_equal_trees(spark):
    few = [(1, frozenset({1})), (2, frozenset({1, 2}))]
    distinct = distinct_filters(frame(spark, few))
    assert {r.id: r.node_path for r in leaf_members(build_tree(distinct, 60), distinct).collect()} == {1: "0", 2: "1"}
    same = [(i, frozenset({3, 9})) for i in range(8)]
    distinct = distinct_filters(frame(spark, same))
    assert {r.node_path for r in leaf_members(build_tree(distinct, 60), distinct).collect()} == {""}


def test_search_matches_recursion_and_exhaustive(spark):
    rows = random_filters(5, 120, hot=30)
    queries = random_filters(6, 80) + [(500, rows[7][1]), (501, rows[0][1]), (502, frozenset())]
    distinct = distinct_filters(frame(spark, rows))
    tree = build_tree(distinct, 60, subtree_rows=16)
    b = frame(spark, queries)
    found = search_tree(tree, b, ["id"], chunk_rows=8)
    matches = {r.id: r for r in found.collect()}
    assert len(matches) == len(queries)
    leaf = model.leaves(rows)
    for key, bits in queries:
        at = model.walk(bits, rows)
        members = [r for r in rows if leaf[r[0]] == at]
        got = matches[key]
        assert (got.best_a, got.dice) == model.best(bits, members)
        assert sum(c.copies for c in got.candidates) == len(members)
        assert len(got.candidates) <= 5
        for c in got.candidates:
            assert c.dice == model.dice(bits, dict(rows)[c.id_a])
    everything = {r.id: (r.best_a, r.dice) for r in search_all(distinct, b, ["id"], tile_rows=16).collect()}
    assert everything == {key: model.best(bits, rows) for key, bits in queries}
    assert all(matches[k].dice is None or matches[k].dice <= everything[k][1] for k in matches)
    long = candidates_long(found, ["id"])
    again = {r.id: (r.best_a, r.dice) for r in best_of(long, ["id"]).collect()}
    assert again == {k: (m.best_a, m.dice) for k, m in matches.items() if m.best_a is not None}
    mapped = {r.id: r.busca for r in candidate_map(found, ["id"]).collect()}
    assert all(set(mapped[k].pares_candidatos) == {c.id_a for c in m.candidates} for k, m in matches.items())
    pairs = long.select("config_id", F.col("id").alias("id_b"), "id_a")
    scored = pair_dice(
        pairs.join(frame(spark, rows).withColumnRenamed("id", "id_a"), ["config_id", "id_a"]),
        b.withColumnRenamed("id", "id_b"),
        ["config_id", "id_b"],
        1,
    )
    check = scored.join(long.withColumnRenamed("id", "id_b").withColumnRenamed("dice", "want"), ["config_id", "id_b", "id_a"])
    assert check.where(~F.col("dice").eqNullSafe(F.col("want"))).count() == 0


def test_exhaustive_search_by_bands(spark):
    """Filters of very different sizes: same results, ties by A's order across bands, far bands skipped."""
    draw = random.Random(15)
    rows = [(i, frozenset(draw.sample(range(120), draw.choice([3, 8, 20, 45, 80, 110])))) for i in range(300)]
    rows += [(400 + i, frozenset()) for i in range(2)]
    queries = [(1000 + i, frozenset(list(b)[: max(1, len(b) - draw.randrange(3))])) for i, b in rows[:150] if b]
    queries += [(2000, frozenset()), (2001, rows[3][1]), (2002, frozenset(range(120)))]
    # one bit of two against one bit of four and two: equal Dice from different bands, the first in order wins
    rows += [(-2, frozenset({0, 1, 2, 3})), (-1, frozenset({0}))]
    queries += [(3000, frozenset({0, 1}))]
    distinct, figures = distinct_filters(frame(spark, rows, 2)), {}
    got = {r.id: (r.best_a, r.dice) for r in search_all(distinct, frame(spark, queries, 2), ["id"], tile_rows=16, figures=figures).collect()}
    assert got == {key: model.best(bits, rows) for key, bits in queries}
    assert got[3000][0] == -2
    assert 0 < figures["compared"] < 0.7 * figures["all"]
    one = {r.id: (r.best_a, r.dice) for r in search_all(distinct, frame(spark, queries, 2), ["id"]).collect()}
    assert one == got
    none = distinct_filters(frame(spark, rows, 2).where("id > 9000"))
    assert all(r.best_a is None for r in search_all(none, frame(spark, queries, 2), ["id"]).collect())


def test_two_empty_filters(spark):
    distinct = distinct_filters(frame(spark, [(1, frozenset()), (2, frozenset())]))
    found = search_tree(build_tree(distinct, 60), frame(spark, [(9, frozenset())]), ["id"]).collect()
    assert found[0].best_a is None and found[0].dice is None
    assert [(c.id_a, c.dice, c.copies) for c in found[0].candidates] == [(1, None, 2)]


def test_order_of_a_decides_ties(spark):
    rows = [(1, {1, 2}, 30), (2, {1, 2}, 10), (3, {1, 3}, 20)]
    a = spark.createDataFrame(
        [(1, i, model.to_words(b, 1), o) for i, b, o in rows], "config_id int, id bigint, words array<bigint>, ord bigint"
    )
    distinct = distinct_filters(a)
    b = frame(spark, [(7, {1})])
    # Among the equally similar filters {1,2} and {1,3} the one first in A's order wins, by its first record.
    assert [r.best_a for r in search_all(distinct, b, ["id"]).collect()] == [2]
    assert {(r.member, r.id_a) for r in distinct.aliases().collect()} == {(1, 2)}


def test_last_record_of_a_repeated_id(spark):
    rows = [(1, 5, [1], 1), (1, 5, [2], 2), (1, 6, [3], 1)]
    df = spark.createDataFrame(rows, "config_id int, id bigint, words array<bigint>, ord bigint")
    assert {(r.id, r.words[0]) for r in last_per_id(df).collect()} == {(5, 2), (6, 3)}


def test_a_subtree_stays_small_in_memory():
    """A task that finishes a subtree of the default bound unpacks and counts it in a few tens of MB."""
    rows = tree.SUBTREE_BYTES // 100
    words = np.random.default_rng(3).integers(0, 2**50, (rows, 2), dtype=np.uint64)
    tracemalloc.start()
    grow(bit_matrix(words)[:, :100], np.ones(rows, np.int64), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 2**20


def test_best_in_tile_equals_all_pairs():
    """The best of each cardinality decides: first row on ties, across cardinalities too; empty filters have none."""
    draw = np.random.default_rng(5)
    a = (draw.random((700, 20)) < draw.choice([0.1, 0.3, 0.6], (700, 1))).astype(np.uint8)
    b = np.concatenate((a[:90], (draw.random((60, 20)) < 0.3).astype(np.uint8), np.zeros((1, 20), np.uint8)))
    index, score = best_in_tile(a, b, step=32, width=16)
    both, total = b.astype(int) @ a.T, b.sum(1, dtype=int)[:, None] + a.sum(1, dtype=int)
    dice = np.where(total > 0, 2.0 * both / np.maximum(total, 1), 0.0)
    assert (score == dice.max(axis=1)).all()
    assert (index == np.where(dice.max(axis=1) > 0, dice.argmax(axis=1), -1)).all()


def test_exhaustive_search_meets_large_tiles(spark):
    """A's filters make few tiles, so that B's filters are not exchanged for every two thousand of them."""
    a = spark.range(20_000).select(F.lit(1).alias("config_id"), "id", F.array(F.xxhash64("id")).alias("words"))
    b = spark.range(1).select(F.lit(1).alias("config_id"), "id", F.array(F.xxhash64(F.lit("other"))).alias("words"))
    figures = {}
    assert search_all(distinct_filters(a), b, ["id"], figures=figures).count() == 1
    assert 1 <= figures["all"] <= 8


def test_exhaustive_search_exchanges_little(spark, monkeypatch):
    """Sides that unpack to ten tiles: B's filters are not copied for each of them."""
    rows = lambda n, seed: spark.range(n).select(F.lit(1).alias("config_id"), "id", F.array(F.xxhash64("id", F.lit(seed)).bitwiseAND(0xFFFFF)).alias("words"))
    monkeypatch.setattr(match, "TILE_BYTES", match.TILE_BYTES // 64)
    n, figures = 10 * 2048, {}
    assert search_all(distinct_filters(rows(n, 1)), rows(n, 2), ["id"], figures=figures).count() == n
    assert figures["all"] <= 2 * match.MIN_TILES * n


def test_pieces_of_a_tile_equal_the_whole():
    draw = np.random.default_rng(7)
    a, b = (draw.integers(0, 2**12, (n, 1), dtype=np.uint64) for n in (500, 333))
    b[:3] = 0
    for rows in (64, 100, 1000):
        index, score = match._best_by_pieces(a, b, rows)
        want = best_in_tile(bit_matrix(a), bit_matrix(b))
        assert (index == want[0]).all() and (score == want[1]).all()
