"""Bloom filters packed in 64-bit words (``words array<bigint>``)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

WORD = 64


def word_count(size: int) -> int:
    return -(-size // WORD)


def or_words(bit: str, words: int) -> list[Column]:
    """Aggregates w0..w(n-1): the OR of all positions of a group, one fixed-width long per word.

    A position outside a word is null for it, which bit_or skips.
    """
    mask = f"shiftleft(1L, cast({bit} % {WORD} as int))"
    return [F.expr(f"bit_or(case when {bit} div {WORD} = {i} then {mask} end) as w{i}") for i in range(words)]


def merge_words(words: int) -> list[Column]:
    """Aggregates w0..w(n-1): the OR of partial filters."""
    return [F.expr(f"bit_or(w{i}) as w{i}") for i in range(words)]


def pack(words: int) -> Column:
    """The words as one array; a word that no position reached is 0."""
    return F.expr("array(" + ", ".join(f"coalesce(w{i}, 0L)" for i in range(words)) + ")")


def bit_test(words: str, bit: str) -> str:
    """SQL text of the bit's value, 0 or 1."""
    return f"bit_get(get({words}, cast({bit} div {WORD} as int)), cast({bit} % {WORD} as int))"


def set_bits(filters: DataFrame, size: int) -> DataFrame:
    """Long form: one row per set bit, ``words`` replaced by ``bit``.

    A constant range is exploded and filtered; both steps stay in generated code.
    """
    kept = [c for c in filters.columns if c != "words"]
    ranged = filters.withColumn("bit", F.expr(f"explode(sequence(0, {size - 1}))"))
    return ranged.where(bit_test("words", "bit") + " = 1").select(*kept, "bit")


def dense(words: Column, size: int) -> Column:
    """Export form: array<int> of 0 and 1, length ``size``.

    Every bit names ``words`` on its own, so the planner computes a costly ``words`` once, before this; inside a lambda,
    where it is named once, it would be computed again for each bit.
    """
    return F.array(*[F.bit_get(F.get(words, F.lit(bit // WORD)), F.lit(bit % WORD)).cast("int") for bit in range(size)])


def cardinality(words: Column, n: int) -> Column:
    return reduce(add, [F.bit_count(F.get(words, F.lit(i))) for i in range(n)]).cast("bigint")


def overlap(left: Column, right: Column, n: int) -> Column:
    parts = [F.bit_count(F.get(left, F.lit(i)).bitwiseAND(F.get(right, F.lit(i)))) for i in range(n)]
    return reduce(add, parts).cast("bigint")


def dice(left: Column, right: Column, n: int) -> Column:
    """2|x AND y| / (|x| + |y|); null when both filters are empty."""
    return F.try_divide(
        F.lit(2.0) * overlap(left, right, n),
        (cardinality(left, n) + cardinality(right, n)).cast("double"),
    )
