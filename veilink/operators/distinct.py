"""Distinct filters of A: identical filters are indexed and compared once, with a copy count.

This is what keeps identical records, however many, from ever meeting pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..sources.store import Stored, store


@dataclass(frozen=True)
class DistinctFilters:
    """``filters``: (config_id, id_a, words, copies, ord), id_a being the first id in A's order.

    ``encoded`` is the record-level table it was grouped from.
    """

    filters: Stored
    encoded: DataFrame

    @property
    def has_copies(self) -> bool:
        return bool(self.filters.seen["repeated"])

    def members(self) -> DataFrame:
        """(config_id, member, id_a, copies, ord) of all records whose filter others share; ``ord`` is the record's own."""
        repeated = self.filters.frame.where(F.col("copies") > 1).select("config_id", "words", "id_a", "copies")
        words = self.filters.seen["words"] or 0
        if self.filters.seen["repeated"] * (56 + 8 * words) <= 64 * 1024 * 1024:
            repeated = F.broadcast(repeated)
        own = F.col("ord") if "ord" in self.encoded.columns else F.col("id")
        found = self.encoded.join(repeated, ["config_id", "words"])
        return found.select("config_id", F.col("id").alias("member"), "id_a", "copies", own.alias("ord"))

    def aliases(self) -> DataFrame:
        """(config_id, member, id_a) of the records that are represented by another id."""
        if not self.has_copies:
            # A known-empty side lets the planner drop the joins with it.
            nothing = self.encoded.select("config_id", F.col("id").alias("member"), F.col("id").alias("id_a"))
            return self.encoded.sparkSession.createDataFrame([], nothing.schema)
        return self.members().where(F.col("member") != F.col("id_a")).select("config_id", "member", "id_a")


def distinct_filters(encoded: DataFrame) -> DistinctFilters:
    """Group (config_id, id [, ord], words) by equal filters; ties go to the smallest ``ord``, default id."""
    if "ord" in encoded.columns:
        first = F.min(F.struct("ord", "id"))
        grouped = encoded.groupBy("config_id", "words").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
        chosen = grouped.select("config_id", F.col("f.id").alias("id_a"), "words", "copies", F.col("f.ord").alias("ord"))
    else:
        grouped = encoded.groupBy("config_id", "words").agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("copies"))
        chosen = grouped.select("config_id", "id_a", "words", "copies", F.col("id_a").alias("ord"))
    stored = store(
        chosen, "filters", repeated=F.count_if(F.col("copies") > 1), words=F.max(F.size("words"))
    )
    return DistinctFilters(stored, encoded)


def last_per_id(encoded: DataFrame) -> DataFrame:
    """For tables whose ids repeat: the last record of an id, by ``ord``, stands for it.

    Records of an id with equal ``ord`` are told apart by their filters, so that a rerun keeps the same one.
    """
    last = F.max(F.struct("ord", "words")).alias("last")
    return encoded.groupBy("config_id", "id").agg(last).select("config_id", "id", "last.ord", "last.words")
