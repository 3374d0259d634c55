"""Bloom-filter encodings through a codebook.

A filter is the OR of its bigrams' filters, also for the resampled record-level form (copying bits keeps
OR).  So each distinct (attribute, bigram) is hashed once into a codebook of packed filters, and a record
is encoded by looking its bigrams up there and OR-ing fixed-width words: in one expression per record for one
configuration, by array for the rows that a sweep's configurations make of each record.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import bitwords, hashing
from ..functions.draws import unit_draw
from ..functions.text import PAD, with_tokens
from ..sources.store import Stored, store
from ..sources.sweep import CLK, RLB, LinkConfig, config_rows, widest
from .lookup import encode_batches, token_names


def with_configs(people: DataFrame, configs: Sequence[LinkConfig]) -> DataFrame:
    """Carry the configurations as a key: one copy of the row per configuration."""
    if "config_id" in people.columns:
        return people
    if len(configs) == 1:
        return people.withColumn("config_id", F.lit(configs[0].config_id))
    return people.withColumn("config_id", F.explode(F.array(*[F.lit(c.config_id) for c in configs])))


def gather_lists(spark: SparkSession, configs: Sequence[LinkConfig]) -> DataFrame:
    """Record-level resampling of the attribute filters: frame (config_id, src, dst).

    Per attribute, ``rlb_slots`` of the positions 0..m-2 are picked without replacement (the last bit is
    never eligible), m slots draw from them with replacement, and all slots are permuted.  The frame has
    one row per filter bit and does not grow with the data.
    """
    chosen = [c for c in configs if c.encoding == RLB]
    base = spark.range(1).select(F.explode(config_rows(chosen)).alias("c")).select("c.*") if chosen else None
    if base is None:
        return spark.createDataFrame([], "config_id int, src int, dst int")
    rows = {(c.config_id, c.seed) for c in chosen}

    def draw(purpose: str, *keys: str):
        # The seed differs by configuration, so the draw is a choice among a few literals.
        result = F.lit(None).cast("double")
        for number, seed in sorted(rows):
            own = unit_draw(seed, purpose, *[F.col(k) for k in keys])
            result = F.when(F.col("config_id") == number, own).otherwise(result)
        return result

    slots = base.select("config_id", "m", "rlb_slots", F.explode(F.expr("sequence(0, size - 1)")).alias("slot"))
    slots = slots.withColumn("attr_idx", F.floor(F.col("slot") / F.col("m")).cast("int"))
    slots = slots.withColumn("pos", (F.col("slot") - F.col("attr_idx") * F.col("m")).cast("int"))
    by_draw = W.partitionBy("config_id", "attr_idx").orderBy("u", "pos")
    picks = (
        slots.where(F.col("pos") < F.col("m") - 1)
        .withColumn("u", draw("rlb-pick", "attr_idx", "pos"))
        .withColumn("rank", F.row_number().over(by_draw) - 1)
        .where(F.col("rank") < F.col("rlb_slots"))
        .select("config_id", "attr_idx", "rank", F.col("pos").alias("picked"))
    )
    shuffled = W.partitionBy("config_id").orderBy("u", "slot")
    drawn = slots.withColumn(
        "rank", F.floor(draw("rlb-slot", "attr_idx", "pos") * F.col("rlb_slots")).cast("int")
    ).withColumn("u", draw("rlb-shuffle", "slot"))
    placed = drawn.withColumn("dst", F.row_number().over(shuffled) - 1)
    src = F.col("picked") + F.col("attr_idx") * F.col("m")
    return placed.join(picks, ["config_id", "attr_idx", "rank"]).select("config_id", src.cast("int").alias("src"), "dst")


def token_positions(tokens: DataFrame, configs: Sequence[LinkConfig], mode: str = "literal") -> DataFrame:
    """Bit positions of every (config_id, attr_idx, token): one row per hash round."""
    hashed = tokens.withColumn("c", F.explode(config_rows(configs)))
    if "config_id" in tokens.columns:
        hashed = hashed.where(F.col("c.config_id") == F.col("config_id"))
    hashed = hashed.select("attr_idx", "token", "c.*")
    families = {c.hash for c in configs}
    hashed = hashed.withColumns(hashing.residues(F.col("token"), F.col("modulus"), families))
    rounds = hashed.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("k"))))
    return rounds.withColumn("pos", hashing.position(F.col("hash"), F.col("round"), F.col("modulus"), families, mode))


LETTERS_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class Codebook:
    """Packed filter of every (config_id, attr_idx, token).

    ``letters``, made while the counted rows fit ``LETTERS_BYTES``, is the same in one value, found without a join: an array
    by configuration and attribute of (first characters, for each of them (second characters, their filters)).  ``places``
    says where a configuration's attributes begin in it.  For several configurations ``arrays`` is made instead, within the
    same bound: by configuration and attribute the sorted names of the bigrams and their filters, which all tasks get.
    """

    table: Stored
    words: int
    places: dict[int, int]
    letters: Stored | None = None
    arrays: Broadcast | None = None


def _letters(table: DataFrame, words: int, places: dict[int, int], n_places: int) -> DataFrame:
    """The codebook as one row; its size is bounded by the caller."""
    start = F.expr(f"map({', '.join(f'{number}, {place}' for number, place in places.items())})[config_id]")
    filters = table.select(
        (start + F.col("attr_idx")).alias("place"), F.substring("token", 1, 1).alias("first"),
        F.substring("token", 2, 1).alias("second"), bitwords.pack(words).alias("words"),
    )
    pairs = F.sort_array(F.collect_list(F.struct("second", "words")))
    nexts = F.struct(F.array_join("pairs.second", "").alias("chars"), F.col("pairs.words").alias("filters"))
    by_first = filters.groupBy("place", "first").agg(pairs.alias("pairs")).select("place", "first", nexts.alias("next"))
    entries = F.sort_array(F.collect_list(F.struct("first", "next")))
    by_place = by_first.groupBy("place").agg(entries.alias("e")).select(
        "place", F.struct(F.array_join("e.first", "").alias("chars"), F.col("e.next").alias("nexts")).alias("node")
    )
    every = table.sparkSession.range(n_places).select(F.col("id").cast("int").alias("place"))
    one = every.join(F.broadcast(by_place), "place", "left").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("p"))
    return one.select(F.col("p.node").alias("letters"))


def _arrays(table: DataFrame, words: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The codebook by (configuration, attribute); its size is bounded by the caller."""
    filters = [F.coalesce(f"w{i}", F.lit(0).cast("bigint")).alias(f"w{i}") for i in range(words)]
    rows = table.select("config_id", "attr_idx", "token", *filters).toArrow()
    config, place = (rows[c].to_numpy() for c in ("config_id", "attr_idx"))
    names = token_names(rows["token"].combine_chunks())
    packed = np.stack([rows[f"w{i}"].to_numpy().view(np.uint64) for i in range(words)])
    book = {}
    for key in sorted(set(zip(config.tolist(), place.tolist(), strict=True))):
        own = np.flatnonzero((config == key[0]) & (place == key[1]))
        own = own[np.argsort(names[own])]
        book[key] = names[own], np.pad(packed[:, own], ((0, 0), (0, 1)))
    return book


def codebook(
    people: Sequence[DataFrame], columns: Sequence[list[str]], configs: Sequence[LinkConfig], mode: str = "literal"
) -> Codebook:
    """Hash each distinct bigram of all given tables once."""
    spark = people[0].sparkSession
    tokens = None
    for frame, names in zip(people, columns, strict=True):
        own = with_tokens(frame.select(*names), names).select("attr_idx", "token").where(F.col("token").isNotNull())
        tokens = own if tokens is None else tokens.unionByName(own)
    placed = token_positions(tokens.distinct(), configs, mode)
    offset = F.when(F.col("encoding") == CLK, 0).otherwise(F.col("attr_idx") * F.col("m"))
    bits = placed.select(
        "config_id", "attr_idx", "token", "encoding", (F.col("pos") + offset).cast("int").alias("src")
    )
    if any(c.encoding == RLB for c in configs):
        gather = F.broadcast(gather_lists(spark, configs))
        bit = F.when(F.col("encoding") == RLB, F.col("dst")).otherwise(F.col("src"))
        bits = bits.join(gather, ["config_id", "src"], "left").withColumn("bit", bit).where(F.col("bit").isNotNull())
    else:
        bits = bits.withColumnRenamed("src", "bit")
    words = bitwords.word_count(widest(configs))
    book = bits.groupBy("config_id", "attr_idx", "token").agg(*bitwords.or_words("bit", words))
    table = store(book, "codebook")
    attributes = max(map(len, columns))
    places = {c.config_id: at * attributes for at, c in enumerate(configs)}
    letters = arrays = None
    if table.rows * (64 + 8 * words) <= LETTERS_BYTES:
        if len(configs) > 1:
            arrays = spark.sparkContext.broadcast(_arrays(table.frame, words))
        else:
            letters = store(_letters(table.frame, words, places, attributes * len(configs)), "letters")
    return Codebook(table, words, places, letters, arrays)


def merged_filters(values: list[Column], place: Column, letters: Column, words: int) -> Column:
    """OR of the filters of all bigrams of the padded values, by look-ups in ``letters``.

    ``place`` is where the first value's filters stand.  A null value has no bigrams; a bigram that the codebook does not
    hold sets no bit.
    """
    padded = [F.struct(F.lit(i).alias("at"), F.concat(F.lit(PAD), v, F.lit(PAD)).alias("text")) for i, v in enumerate(values)]
    none = F.array(*[F.lit(0).cast("bigint")] * words)

    def found(book: Column, value: Column, i: Column) -> Column:
        node = F.get(book, place + value["at"])
        next_ = F.get(node["nexts"], F.instr(node["chars"], value["text"].substr(i, F.lit(1))) - 1)
        return F.get(next_["filters"], F.instr(next_["chars"], value["text"].substr(i + 1, F.lit(1))) - 1)

    def with_value(book: Column, value: Column, so_far: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(value["text"]) - 1)
        one = lambda acc, i: F.coalesce(F.zip_with(acc, found(book, value, i), lambda x, y: x.bitwiseOR(y)), acc)
        return F.coalesce(F.aggregate(steps, so_far, one), so_far)

    # the codebook is named once, so the planner keeps it as the subquery's value and does not carry it in rows
    over = F.transform(F.array(letters), lambda book: F.aggregate(F.array(*padded), none, lambda acc, v: with_value(book, v, acc)))
    return F.get(over, F.lit(0))


def encode(people: DataFrame, columns: list[str], configs: Sequence[LinkConfig], book: Codebook, keep: list[str]) -> DataFrame:
    """Filters of every record: (config_id, keep..., words).  Records with equal ``keep`` stay apart.

    While the codebook fits one value, a record's filter is one expression over its attributes: no rows per bigram, no
    exchange, no Python.  For several configurations, of which each has a row per record, the values of a batch of rows are
    looked up by array instead, in a small part of the expression's time.  A larger codebook is met by a shuffled join, so records carry a row number; they are written
    with it first, so that a task that runs again finds the numbers unchanged.  Null tokens take no part in that join.
    """
    rows = with_configs(people.select(*dict.fromkeys(keep + columns + _config_column(people))), configs)
    carried = ["config_id", *keep]
    if book.arrays:
        values = [F.col(c).cast("string").alias(f"_value{i}") for i, c in enumerate(columns)]
        out = T.StructType([*(rows.schema[c] for c in carried), T.StructField("words", T.ArrayType(T.LongType()))])
        arrays, n_values, words, names = book.arrays, len(values), book.words, [*carried, "words"]

        def look_up(batches):
            return encode_batches(batches, arrays.value, n_values, words, PAD, names)

        return rows.select(*carried, *values).mapInArrow(look_up, out)
    if book.letters:
        values = [F.col(c).cast("string") for c in columns]
        starts = list(book.places.items())
        place = F.lit(starts[0][1])
        if len(starts) > 1:
            place = F.expr(f"map({', '.join(f'{number}, {at}' for number, at in starts)})[config_id]")
        with_book = rows.withColumn("_book", book.letters.frame.scalar())
        return with_book.select(*carried, merged_filters(values, place, F.col("_book"), book.words).alias("words"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    written = store(numbered, "numbered").frame
    tokens = with_tokens(written, columns).select("_row", "config_id", "attr_idx", "token").where(F.col("token").isNotNull())
    joined = tokens.join(book.table.frame, ["config_id", "attr_idx", "token"])
    merged = joined.groupBy("_row").agg(*bitwords.merge_words(book.words))
    packed = written.select("_row", *carried).join(merged, "_row", "left")
    return packed.select(*carried, bitwords.pack(book.words).alias("words"))


def _config_column(people: DataFrame) -> list[str]:
    return ["config_id"] if "config_id" in people.columns else []


def block_filter(people: DataFrame, column: str, key: str = "id", m: int = 30, k: int = 3) -> DataFrame:
    """One-attribute blocking filter: (key, block), the filter as an integer; null gives 0."""
    config = LinkConfig(m=m, k=k, hash=hashing.DOUBLE, encoding="ABF", n_attrs=1)
    book = codebook([people], [[column]], [config])
    filters = encode(people, [column], [config], book, [key])
    return filters.select(key, F.get("words", F.lit(0)).alias("block"))
