"""Synthetic values: a column drawn from the marginal distribution of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.damage import DATE_WRITE
from ..functions.draws import unit_draw

EPOCH_DAY = "1970-01-01"
STEPS = 100


def day_grid(sample: DataFrame, date: str, steps: int = STEPS) -> DataFrame:
    """One row, one array: the quantiles 0, 1/steps, ..., 1 of a date column in epoch days.

    Days are counted first, so the exact quantiles are taken over distinct days with their frequencies,
    a domain that does not grow with the sample.
    """
    days = sample.where(F.col(date).isNotNull()).select(F.unix_date(F.col(date).cast("date")).alias("day"))
    counted = days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    shares = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    exact = counted.agg(F.percentile("day", shares, F.col("n")).alias("grid"))
    return exact.select(F.transform("grid", lambda q: F.round(q, 6)).alias("grid"))


def inverse_cdf(grid: Column, draw: Column, steps: int = STEPS) -> Column:
    """Value of the piecewise linear inverse distribution at a uniform draw."""
    at = draw * F.lit(float(steps))
    low = F.floor(at).cast("int")
    below, above = F.get(grid, low), F.get(grid, low + 1)
    return below + (above - below) * (at - low)


def with_synthetic_date(
    rows: DataFrame, sample: DataFrame, date: str, key: str, seed: int, name: str = "data_nasc"
) -> DataFrame:
    """Add a date text per row, distributed like ``date`` in ``sample``; a pure function of the key."""
    gridded = rows.withColumn("_grid", day_grid(sample, date).scalar())
    day = F.round(inverse_cdf(F.col("_grid"), unit_draw(seed, "synthetic-date", F.col(key)))).cast("int")
    return gridded.withColumn(name, F.date_format(F.date_from_unix_date(day), DATE_WRITE)).drop("_grid")
