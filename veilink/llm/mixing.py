"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size.  Documents of a source stand
in a line (by size class, so that the sample is spread over all sizes, and by a hash of id within it); the expected copies
are summed along it, one random offset per source is added, and a document is emitted once for every integer that its
stretch of the line crosses.  So the copies of a source, and of each size class (sizes that differ by an eighth at most),
are right to within one document.

The prefix sum is taken in two steps: counts of (source, size class, first digits of the hash) are summed along the line
in a small written table, and rows are numbered within their cell only, so that a source with a third of all rows is no
single task.  The line does not depend on the number of digits; it grows with the rows, so that a cell of documents with
different ids holds some ``CELL_ROWS`` of them at any size.

Everything is DataFrame expressions.  Null text counts 0 words; a null source is a source of its own, last in order; a
source without words has target 0 and yields nothing; rows that repeat an id are separate documents.  ``plan`` sets the
columns ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` over ones of the input that are called so; other
columns pass, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilink.sources.store import store

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
CELL_ROWS = 1 << 18
HASH_DIGITS = 8


def _key(source: Column) -> Column:
    """A text that tells the null source from all others."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(_key, source_size) of all sources -> the same with ``target``: weighted shares of all words, each at most
    ``most`` times the source's size, what is cut off being shared again by weight among the rest.

    In order of cap / weight the capped sources come first, and a source is capped if its cap is at most its weight's
    share of what the ones before it leave.  One row per source: the window sees nothing larger.
    """
    by_name = Window.orderBy(F.substring("_key", 1, 1) == "n", "_key")
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    cap = F.lit(float(most)) * F.col("source_size")
    rows = sizes.withColumn("_weight", cycle.cast("double")).withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    whole = Window.partitionBy()
    until = Window.orderBy("_ratio", "_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(until), F.lit(0.0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(until), F.lit(0.0))
    )
    rows = rows.withColumn("_level", level)
    share = F.coalesce(F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(whole), F.lit(0.0))
    rows = rows.withColumn("_share", share)
    return rows.select("_key", "source_size", F.least("_cap", F.col("_share") * F.col("_weight")).alias("target"))


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """The input with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    clear = "_" * max(map(len, docs.columns))  # longer than any name in use
    results = ["size", "source_size", "target", "copies", "taken"]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    # the columns of the line, before the input's own names come in
    lined = docs.select(
        F.struct(*others).alias(f"{clear}row"), F.col(id_col).alias("_id"), _key(F.col(source_col)).alias("_key"), size.alias("size"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_DIGITS).alias("_hash"),
    )
    bits = F.bin("size")
    # more digits make more cells and leave every row's place as it is
    digits = min(HASH_DIGITS, max(1, math.ceil(math.log(max(1, docs.count()) / CELL_ROWS, 16))))
    sized = lined.withColumn("_class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)))
    sized = sized.withColumn("_slice", F.substring("_hash", 1, digits))
    cell = ["_key", "_class", "_slice"]
    counted = sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words"))
    cells = store(counted, "mix-cells").frame
    line = Window.partitionBy("_key").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(line), F.lit(0)))
    shares = targets(cells.groupBy("_key").agg(F.sum("_words").alias("source_size")))
    before = before.join(shares, "_key").select(*cell, "_before", "source_size", "target")
    within = Window.partitionBy(*cell).orderBy("_hash", "size", "_id")
    ranked = sized.withColumn("_rank", F.row_number().over(within)).join(before, cell)
    rank = (F.col("_rank") + F.col("_before")).cast("double")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    planned = ranked.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return planned.select(f"{clear}row.*", *results)


def mixed(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the input's columns."""
    planned = plan(docs.select(F.struct("*").alias("_row"), *_roles(docs, columns)), "_id", "_text", "_source")
    repeated = planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select("_row.*")


def _roles(docs: DataFrame, columns: str) -> list[Column]:
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns
    return [docs[names[f"{role}_col"]].alias(f"_{role}") for role in ("id", "text", "source")]


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS slice
  FROM documents),
sources AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap
  FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT k, source_size, least(cap, coalesce(max(CASE WHEN ratio > level THEN level END) OVER (), 0.0) * weight) AS target,
    ('0x' || substr(md5('mix-1' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM levels),
lined AS (
  SELECT doc_id, size, source_size, target, u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    (row_number() OVER (PARTITION BY k ORDER BY length(bin(size)), substr(bin(size), 1, 4), slice, size, doc_id))::DOUBLE AS n
  FROM sized JOIN goals USING (k))
SELECT doc_id, size, source_size, target,
  (floor(rate * n + u) - floor(rate * (n - 1) + u))::BIGINT * size AS taken
FROM lined
"""
