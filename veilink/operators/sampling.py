"""Samples and splits by keyed draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.draws import unit_draw, weighted_bucket
from ..sources.store import store

STRATUM_BYTES = 128


def strata(df: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """Distinct strata with one sampling fraction each, as a joinable frame."""
    return df.select(stratum).distinct().withColumn("fraction", F.lit(fraction))


def stratified_sample(df: DataFrame, stratum: str, fractions: DataFrame | float, key: str, seed: int) -> DataFrame:
    """Bernoulli sample per stratum; strata without a fraction are left out.

    One fraction for all strata needs no lookup; a frame (stratum, fraction) is written, counted, and
    joined on the stratum, by broadcast while it is small, so that a large stratum is not shuffled.
    """
    draw = unit_draw(seed, "stratum", F.col(key))
    if isinstance(fractions, DataFrame):
        lookup = store(fractions.select(stratum, "fraction"), "fractions").small_side(STRATUM_BYTES)
        chosen = df.join(lookup, stratum)
        return chosen.where(draw < F.col("fraction")).select(*df.columns)
    return df.where(F.col(stratum).isNotNull() & (draw < F.lit(fractions)))


def weighted_split(df: DataFrame, weights: Sequence[float], key: str, seed: int, purpose: str, name: str) -> DataFrame:
    """Assign every row to one of the weighted groups: adds the group index, never splits the frame."""
    return df.withColumn(name, weighted_bucket(unit_draw(seed, purpose, F.col(key)), weights))
