"""Positional operators: row ordinals, slices and zip joins, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.store import store


def _total(df: DataFrame, order: list[str | Column]) -> list[Column]:
    """The order, made total: ties fall to the other columns, in their order, nulls first.

    Rows that tie even then are equal.  A column without an order counts by its hash.
    """
    named = {c for c in order if isinstance(c, str)}
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    for field in df.schema.fields:
        if field.name not in named:
            ordered = not field.dataType.simpleString().count("map<") and field.dataType.typeName() != "variant"
            keys.append(F.col(f"`{field.name}`") if ordered else F.hash(F.to_json(F.struct(f"`{field.name}`"))))
    return keys


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Number the rows 0, 1, ... in the given order.

    One exchange: rows are range-partitioned by the total order, sorted within their range and written with their
    place in it; the ordinal is that place plus the sizes of the ranges before.  A value shared by many rows is spread
    over several ranges by the other columns.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _total(df, order)
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the number of a row is its partition's and, in the low 33 bits, its place there
    rows = store(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges").frame
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per range: the window below never sees data rows.
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    numbered = rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + place)
    return numbered.drop("_part", "_offset", "_at")


def rows_between(df: DataFrame, low: int, high: int, order: list[str | Column]) -> DataFrame:
    """Rows low..high-1 in the given order, ties as in ``with_ordinal``.

    A slice near the head is a top-k, one further down goes by ordinal; both give the same rows.
    """
    if high <= 10_000:
        return df.orderBy(*_total(df, order)).offset(low).limit(max(0, high - low))
    numbered = with_ordinal(df, order)
    return numbered.where((F.col("ordinal") >= low) & (F.col("ordinal") < high)).drop("ordinal")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Pair the rows of two unrelated frames by position; the longer side's surplus is dropped."""
    return with_ordinal(left, left_order).join(with_ordinal(right, right_order), "ordinal")
