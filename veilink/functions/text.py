"""Character bigrams of padded attribute values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAD = "_"


def attribute_vector(columns: list[str]) -> Column:
    """The chosen columns as one array<string>; every column is cast, so mixed types never meet."""
    return F.array(*[F.col(c).cast("string") for c in columns])


def with_tokens(people: DataFrame, columns: list[str]) -> DataFrame:
    """One row per bigram: adds ``attr_idx`` and ``token``.

    A value of n characters has n + 1 bigrams, the empty value has one (two pads).  A null value keeps a
    single row with a null token, so that records without any token are not lost.
    """
    carried = [F.col(c) for c in people.columns if c not in ("attr_idx", "token")]
    values = people.select(*carried, F.posexplode(attribute_vector(columns)).alias("attr_idx", "value"))
    starts = values.withColumn(
        "start", F.explode_outer(F.sequence(F.lit(1), F.length("value") + 1))
    )
    padded = F.concat(F.lit(PAD), F.col("value"), F.lit(PAD))
    token = padded.substr(F.col("start"), F.lit(2))
    return starts.withColumn("token", token).drop("value", "start")
