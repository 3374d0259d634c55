"""Keyed draws: random choices that are pure functions of (seed, purpose, key).

A draw does not depend on partitioning or task order, so a lost executor or a second evaluation of the
same plan gives the same rows, and any SQL engine with md5 can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def unit_draw(seed: int, purpose: str, *key: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of md5('seed:purpose:key...')."""
    text = F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def int_draw(seed: int, purpose: str, low: int, high: int, *key: Column) -> Column:
    """Uniform integer in [low, high], both ends included."""
    return F.floor(unit_draw(seed, purpose, *key) * F.lit(float(high - low + 1))).cast("bigint") + F.lit(low)


def cut_points(weights: Sequence[float]) -> list[float]:
    """Upper ends of the normalised cumulative weights, without the last one."""
    total = sum(weights)
    return [part / total for part in accumulate(weights)][:-1]


def weighted_bucket(draw: Column, weights: Sequence[float]) -> Column:
    """Index of the bucket a uniform draw falls into; weights need not add up to 1."""
    bucket = F.lit(len(weights) - 1)
    for index, upper in reversed(list(enumerate(cut_points(weights)))):
        bucket = F.when(draw < F.lit(upper), F.lit(index)).otherwise(bucket)
    return bucket
