"""Search of the index, exhaustive search, and candidate forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import bitwords
from ..sources.store import Stored, store
from .distinct import DistinctFilters
from .subtree import best_in_tile, bit_matrix, dice_of, grow, pair_up, word_matrix
from .tree import Tree, descend

MIN_TILES = 4
TILE_BYTES = 16 * 1024 * 1024
TILES_AT_ONCE = 16


def _candidates(id_type: T.DataType, ord_type: T.DataType) -> T.ArrayType:
    fields = [("id_a", id_type), ("dice", T.DoubleType()), ("copies", T.LongType()), ("ord", ord_type)]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


def search_tree(tree: Tree, encoded_b: DataFrame, keep: list[str], chunk_rows: int = 16384) -> DataFrame:
    """Walk every B row to its leaf, score the leaf, keep the best: (config_id, keep..., best_a, dice, candidates).

    B walks the upper tree by joins.  Then B and A meet per finished subtree.  A subtree that draws many
    B rows is replicated (at most ``subtree_rows`` filters) and its B rows are dealt over the replicas, so
    a task never holds more than about ``chunk_rows`` of them.  ``candidates`` has one entry per distinct
    filter of the leaf, at most ``group`` of them, with the number of A records that share the filter.
    No positive similarity gives a null best; two empty filters have a null Dice.  Ids are of any type with an order.
    Every row of B is searched on its own, also where ids repeat; where A has no rows, all of B comes back with a
    null best and no candidates.
    """
    group = tree.group
    routed = descend(encoded_b.withColumn("root", F.lit("")), tree.levels, "root")
    placed_b = store(routed, "routed").frame
    demand = placed_b.groupBy("config_id", "root").agg(F.count(F.lit(1)).alias("n_b"))
    replicas = store(
        demand.select("config_id", "root", F.ceil(F.col("n_b") / chunk_rows).cast("int").alias("replicas")), "demand"
    )
    shares = replicas.small_side(96)
    b = placed_b.join(shares, ["config_id", "root"]).withColumn(
        "share", F.pmod(F.xxhash64(*keep), F.col("replicas")).cast("int")
    )
    a = tree.placed.join(shares, ["config_id", "root"]).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1))
    )
    key = ["config_id", "root", "share"]
    left = a.select(*key, "id_a", "words", "copies", "ord").groupBy(*key)
    right = b.select(*key, *keep, "words").groupBy(*key)
    id_type, ord_type = (tree.placed.schema[c].dataType for c in ("id_a", "ord"))
    out = T.StructType(
        [T.StructField("config_id", T.IntegerType())]
        + [encoded_b.schema[c] for c in keep]
        + [
            T.StructField("best_a", id_type),
            T.StructField("dice", T.DoubleType()),
            T.StructField("candidates", _candidates(id_type, ord_type)),
        ]
    )

    def link(a_rows, b_rows):
        a_rows = a_rows.sort_by("ord")
        words_a, words_b = word_matrix(a_rows["words"]), word_matrix(b_rows["words"])
        copies, ids, places = (a_rows[c].combine_chunks() for c in ("copies", "id_a", "ord"))
        sub = grow(bit_matrix(words_a), copies.to_numpy(), group)
        at_a, at_b, per_b = pair_up(sub.leaf_of, sub.route(bit_matrix(words_b)))
        dice = dice_of(words_a[at_a], words_b[at_b])
        missing = np.isnan(dice)
        offsets = np.concatenate(([0], np.cumsum(per_b)))
        scored = np.where(missing, 0.0, dice)
        # Every leaf holds a row of A, so no segment is empty.
        top = np.maximum.reduceat(scored, offsets[:-1])
        hit = np.flatnonzero(scored == np.repeat(top, per_b))
        first = hit[np.searchsorted(hit, offsets[:-1])]
        none = top <= 0
        chosen = pa.array(at_a)
        candidates = pa.StructArray.from_arrays(
            [ids.take(chosen), pa.array(dice, mask=missing), copies.take(chosen), places.take(chosen)],
            ["id_a", "dice", "copies", "ord"],
        )
        columns = {"config_id": b_rows["config_id"]}
        columns |= {c: b_rows[c] for c in keep}
        columns["best_a"] = ids.take(pa.array(at_a[first], mask=none))
        columns["dice"] = pa.array(top, mask=none)
        columns["candidates"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), candidates)
        return pa.table(columns)

    def meet(a_rows, b_rows):
        if b_rows.num_rows and a_rows.num_rows:
            return link(a_rows, b_rows)
        if not b_rows.num_rows:
            return empty
        own = {c: b_rows[c] for c in ["config_id", *keep]}
        nothing = {c: pa.nulls(b_rows.num_rows, empty.schema.field(c).type) for c in ("best_a", "dice")}
        none_each = pa.array([[]] * b_rows.num_rows, empty.schema.field("candidates").type)
        return pa.table(own | nothing | {"candidates": none_each})

    empty = _empty(out)
    return left.cogroup(right).applyInArrow(meet, out)


def _empty(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def _bands(distinct: DistinctFilters, n_words: int, tile_rows: int) -> Stored:
    """Neighbouring cardinalities of A's filters, some ``tile_rows`` filters together: one row per cardinality.

    (config_id, band, ones, low, high, slices): ``low`` to ``high`` are the band's cardinalities, ``slices`` how many tiles
    its filters fill.  There are no more rows than a filter has bits, for each configuration.
    """
    per_config = W.partitionBy("config_id")
    counts = distinct.filters.frame.groupBy("config_id", bitwords.cardinality(F.col("words"), n_words).alias("ones")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(per_config.orderBy("ones")) - F.col("n")
    width = F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.ceil(F.sum("n").over(per_config) / MIN_TILES)))
    cut = counts.where("ones > 0").select("*", width.alias("width"), before.alias("before"))
    step = F.floor(F.col("before") / F.col("width"))
    dense = cut.withColumn("band", F.dense_rank().over(per_config.orderBy(step)))
    whole = W.partitionBy("config_id", "band")
    slices = F.ceil(F.sum("n").over(whole) / F.col("width")).cast("int")
    return store(
        dense.select("config_id", "band", "ones", F.min("ones").over(whole).alias("low"), F.max("ones").over(whole).alias("high"), slices.alias("slices")),
        "bands", most=F.max("band"),
    )


def _bound(ones: Column, low: Column, high: Column) -> Column:
    """The largest Dice that a filter with ``ones`` bits can have with any of ``low`` to ``high`` bits: 2 min / sum."""
    near = F.greatest(low, F.least(high, ones))
    return F.lit(2.0) * F.least(ones, near) / (ones + near).cast("double")


def search_all(
    distinct: DistinctFilters, encoded_b: DataFrame, keep: list[str], tile_rows: int | None = None, figures: dict | None = None
) -> DataFrame:
    """Exhaustive search: the best of all A records for every B record, (config_id, keep..., best_a, dice).

    A B record whose filter A holds exactly is settled by an equi-join on the filter (Dice 1 cannot be
    beaten).  The others meet A tile by tile in tasks of their own, as matrix products, and only the best row per B filter
    and A tile leaves a task.

    A's tiles are banded by cardinality.  Two filters of x and y bits have a Dice of at most 2 min(x, y) / (x + y), so a B
    filter begins with the bands around its own cardinality and then goes outward as far as the bound reaches the best
    found.  A band whose bound equals it is visited, as ties go by A's order.
    The work is |A| x |B| at worst; it is the yardstick for the index, not the way to link large tables.

    Both sides are exchanged once for every ``tile_rows`` filters of the other, by default TILES_AT_ONCE times as many as
    a task unpacks to ``TILE_BYTES`` at once.  As each side is copied as often as the other has such tiles, what is exchanged
    grows with |A| x |B| / ``tile_rows``.

    ``figures`` gets the pairs of B filters and A tiles that were ``compared``, and how many there are in ``all``.
    """
    filters = distinct.filters.frame
    b = store(encoded_b, "encoded-b").frame
    n_words = distinct.filters.seen["words"] or 1
    tile_rows = tile_rows or TILES_AT_ONCE * _piece_rows(n_words)
    wanted = b.groupBy("config_id", "words").agg(F.count(F.lit(1)).alias("uses"))
    settled = wanted.join(filters.select("config_id", "words", "id_a"), ["config_id", "words"], "left")
    nonempty = F.exists("words", lambda w: w != 0)
    settled = settled.withColumn("sure", F.col("id_a").isNotNull() & nonempty)
    wide = store(settled, "wanted", open=F.count_if(~F.col("sure")))
    exact = wide.frame.where("sure").select("config_id", "words", F.col("id_a").alias("best_a"), F.lit(1.0).alias("dice"))

    bands = _bands(distinct, n_words, tile_rows)
    ranges = bands.frame.select("config_id", "band", "low", "high", "slices").distinct()
    slice_of = F.pmod(F.xxhash64("words", F.lit("tile")), F.col("slices")).cast("int")
    a = filters.withColumn("ones", bitwords.cardinality(F.col("words"), n_words)).join(F.broadcast(bands.frame), ["config_id", "ones"])
    a = a.select("config_id", "band", slice_of.alias("slice"), "id_a", "ord", "words")
    open_ = wide.frame.where(~F.col("sure") & nonempty).select("config_id", "words")
    open_ = open_.withColumn("ones", bitwords.cardinality(F.col("words"), n_words))
    # the own band is the one that a filter comes nearest to
    reach = F.abs(F.greatest(F.col("low"), F.least(F.col("high"), F.col("ones"))) - F.col("ones"))
    home = open_.select("config_id", "ones").distinct().join(F.broadcast(ranges), "config_id")
    home = home.groupBy("config_id", "ones").agg(F.min_by("band", F.struct(reach, "band")).alias("home"))
    open_ = open_.join(F.broadcast(home), ["config_id", "ones"]).join(F.broadcast(ranges), "config_id")
    apart = F.abs(F.col("band") - F.col("home"))
    near = max(1, (bands.seen["most"] or 0) // 8)
    shares = max(MIN_TILES, -(-wide.seen["open"] // tile_rows))

    first = _compared(a, open_.where(apart <= near), shares)
    first = store(first.groupBy("config_id", "words").agg(F.min("top").alias("top")), "best-of-near-bands").frame
    worth = _bound(F.col("ones"), F.col("low"), F.col("high")) >= F.coalesce(-F.col("top.below"), F.lit(0.0))
    further = open_.where(apart > near).join(first, ["config_id", "words"], "left").where(worth)
    if figures is not None:
        pairs = lambda visits: visits.agg(F.sum("slices")).first()[0] or 0
        figures |= {"compared": pairs(open_.where(apart <= near)) + pairs(further), "all": pairs(open_)}
    best = first.unionByName(_compared(a, further, shares)).groupBy("config_id", "words").agg(F.min("top").alias("top"))
    compared = best.select("config_id", "words", F.col("top.id_a").alias("best_a"), (-F.col("top.below")).alias("dice"))
    return b.join(exact.unionByName(compared), ["config_id", "words"], "left").select("config_id", *keep, "best_a", "dice")


def _piece_rows(n_words: int) -> int:
    """So many filters unpack to TILE_BYTES."""
    return max(2048, TILE_BYTES // (4 * bitwords.WORD * n_words))


def _best_by_pieces(words_a: np.ndarray, words_b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``best_in_tile`` of packed filters of any number, of which ``rows`` of a side are unpacked at once."""
    index, score = np.full(len(words_b), -1, np.int64), np.zeros(len(words_b))
    for a in range(0, len(words_a), rows):
        bits_a = bit_matrix(words_a[a : a + rows])
        for b in range(0, len(words_b), rows):
            at, dice = best_in_tile(bits_a, bit_matrix(words_b[b : b + rows]))
            better = dice > score[b : b + rows]  # the pieces of A are in order, so the first keeps a tie
            index[b : b + rows][better], score[b : b + rows][better] = at[better] + a, dice[better]
    return index, score


def _compared(a: DataFrame, visits: DataFrame, shares: int) -> DataFrame:
    """Best row of each A tile for every B filter that visits it: (config_id, words, top).

    A tile is copied ``shares`` times and the B filters that visit it are dealt over the copies.
    """
    cell = ["config_id", "band", "slice", "share"]
    a_side = a.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    b_side = visits.withColumn("share", F.pmod(F.xxhash64("words", F.lit("share")), F.lit(shares)).cast("int"))
    b_side = b_side.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    top = T.StructType([T.StructField("below", T.DoubleType()), *(a.schema[c] for c in ("ord", "id_a"))])
    out = T.StructType([a.schema["config_id"], a.schema["words"], T.StructField("top", top)])
    empty = _empty(out)

    def compare(a_rows, b_rows):
        if not (a_rows.num_rows and b_rows.num_rows):
            return empty
        a_rows = a_rows.sort_by("ord")
        words_a, words_b = word_matrix(a_rows["words"]), word_matrix(b_rows["words"])
        index, score = _best_by_pieces(words_a, words_b, _piece_rows(words_a.shape[1]))
        found = np.flatnonzero(index >= 0)
        at = pa.array(index[found])
        columns = [pa.array(-score[found]), *(a_rows[c].combine_chunks().take(at) for c in ("ord", "id_a"))]
        taken = b_rows.select(["config_id", "words"]).take(pa.array(found))
        return taken.append_column("top", pa.StructArray.from_arrays(columns, ["below", "ord", "id_a"]))

    left = a_side.select(*cell, "id_a", "ord", "words").groupBy(*cell)
    return left.cogroup(b_side.select(*cell, "words").groupBy(*cell)).applyInArrow(compare, out)


def candidates_long(matches: DataFrame, keep: list[str]) -> DataFrame:
    """One row per B record and distinct candidate filter: (config_id, keep..., id_a, dice, copies, ord)."""
    return matches.select("config_id", *keep, F.inline("candidates"))


def candidate_pairs(matches: DataFrame, aliases: DataFrame, keep: list[str]) -> DataFrame:
    """One row per B record and candidate record of A: (config_id, keep..., id_a, dice).

    Copies that stand behind a candidate's first id (``aliases``: config_id, member, id_a) are listed by an
    equi-join, each with its own id; a hot filter's rows are dealt by the planner's skew handling.
    """
    found = candidates_long(matches, keep).select("config_id", *keep, "id_a", "dice")
    copies = found.join(aliases, ["config_id", "id_a"]).select("config_id", *keep, F.col("member").alias("id_a"), "dice")
    return found.unionByName(copies)


def candidate_map(matches: DataFrame, keep: list[str]) -> DataFrame:
    """Export form: ``pares_candidatos`` maps each distinct filter's first id to Dice, beside the best.

    ``candidate_maps`` has the ids of all copies.
    """
    entries = F.transform(
        "candidates", lambda c: F.struct(c["id_a"].alias("key"), c["dice"].cast("float").alias("value"))
    )
    return matches.select(
        "config_id",
        *keep,
        F.struct(
            F.col("best_a").alias("baseA"),
            F.col("dice").cast("float").alias("dice"),
            F.map_from_entries(entries).alias("pares_candidatos"),
        ).alias("busca"),
    )


def candidate_maps(matches: DataFrame, members: DataFrame, keep: list[str], entries: int = 65_536) -> DataFrame:
    """Export form with the ids of all candidate records: (config_id, keep..., part, parts, busca).

    ``members`` are A's records that share a filter (config_id, member, id_a, copies, ord).  A filter of many records is
    cut by hash of the id into parts of about ``entries`` ids, a power of two of them, and a B row whose leaf holds such
    a filter gets as many rows, ``part`` of ``parts``: no map grows with the number of copies.  Each part of a filter is
    gathered once, so a B row meets one row per candidate and part.  An id that several records of the leaf have keeps
    its last record in A's order (then the larger Dice).
    """
    cut = lambda copies: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(copies / entries, F.lit(1.0))))).cast("int")
    turn = lambda id_, parts: F.xxhash64(id_).bitwiseAND((parts - 1).cast("bigint")).cast("int")
    key = ["config_id", "id_a"]
    gathered = members.withColumn("_slot", turn(F.col("member"), cut(F.col("copies"))))
    gathered = gathered.groupBy(*key, "_slot").agg(F.collect_list(F.struct(F.col("member").alias("key"), "ord")).alias("_own"))

    parts = F.array_max(F.transform("candidates", lambda c: cut(c["copies"])))
    rows = matches.select("config_id", *keep, "best_a", "dice", "candidates", F.coalesce(parts, F.lit(1)).alias("parts"))
    many = F.exists("candidates", lambda c: c["copies"] > 1)
    single = rows.where(~many).withColumn("part", F.lit(0)).withColumn(
        "_all", F.transform("candidates", lambda c: F.struct(c["id_a"].alias("key"), c["ord"].alias("ord"), c["dice"].alias("dice")))
    )
    carried = ["config_id", *keep, "best_a", "dice", "parts"]
    shared = rows.where(many).withColumn("_row", F.monotonically_increasing_id())
    shared = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = shared.select("_row", "part", *carried, F.explode("candidates").alias("_c"))
    each = each.withColumn("id_a", F.col("_c.id_a")).withColumn("_slot", F.col("part").bitwiseAND(cut(F.col("_c.copies")) - 1).cast("int"))
    met = each.join(gathered, [*key, "_slot"], "left")
    alone = F.array(F.struct(F.col("_c.id_a").alias("key"), F.col("_c.ord").alias("ord")))
    here = F.filter(F.coalesce("_own", alone), lambda m: turn(m["key"], F.col("parts")) == F.col("part"))
    scored = F.transform(here, lambda m: F.struct(m["key"].alias("key"), m["ord"].alias("ord"), F.col("_c.dice").alias("dice")))
    met = met.select("_row", "part", *carried, scored.alias("_scored"))
    again = met.groupBy("_row", "part").agg(*[F.first(c).alias(c) for c in carried], F.flatten(F.collect_list("_scored")).alias("_all"))

    both = single.select(*carried, "part", "_all").unionByName(again.drop("_row"))
    both = both.withColumn("_all", F.array_sort("_all"))
    last = lambda m, i: F.coalesce(F.get("_all", i + 1)["key"] != m["key"], F.lit(True))
    pairs = F.transform(F.filter("_all", last), lambda m: F.struct(m["key"].alias("key"), m["dice"].cast("float").alias("value")))
    busca = F.struct(F.col("best_a").alias("baseA"), F.col("dice").cast("float").alias("dice"), F.map_from_entries(pairs).alias("pares_candidatos"))
    return both.select("config_id", *keep, "part", "parts", busca.alias("busca"))


def best_of(candidates: DataFrame, keep: list[str]) -> DataFrame:
    """Best candidate from the long form; ties go to the first in A's order, no positive Dice gives no row."""
    top = F.min(F.struct((-F.col("dice")).alias("below"), "ord", "id_a")).alias("top")
    grouped = candidates.where(F.col("dice") > 0).groupBy("config_id", *keep).agg(top)
    return grouped.select("config_id", *keep, F.col("top.id_a").alias("best_a"), (-F.col("top.below")).alias("dice"))


def pair_dice(a: DataFrame, b: DataFrame, on: list[str], words: int) -> DataFrame:
    """Dice of given pairs, by equi-join: adds ``dice``."""
    left = a.withColumnRenamed("words", "a_words")
    right = b.withColumnRenamed("words", "b_words")
    joined = left.join(right, on)
    return joined.withColumn("dice", bitwords.dice(F.col("a_words"), F.col("b_words"), words)).drop("a_words", "b_words")
