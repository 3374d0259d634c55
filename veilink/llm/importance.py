"""Importance resampling to a target distribution over hashed word features.

Two scans of the texts: the first sums, task by task, how often each bucket occurs in the corpus (the target's texts
likewise); from both comes one gain per bucket, an array of fixed length that travels with the plan.  The second scan
scores every document by it: its weight is the mean gain of its features.  A Gumbel draw from the id is added, so the
largest scores are a sample without replacement in proportion to exp(weight / 1000).

The k-th best score is found by quickselect on the table of scores.  Every round draws random pivot keys (score, id, ...),
counts the keys before, at and after each of them in one job, and keeps only the rows between the two pivots that enclose
the k-th.  Only counts and pivots reach the driver.  The rows up to the k-th key, and they alone, are then sorted and
ranked by range.

Defined results: a null text has no words, a text without features weight 0.  A null id has no score and is never drawn or
counted among those drawn from, its features count in the corpus.  Rows that repeat an id are separate documents; where
their scores tie, the one with fewer features comes first, then that of smaller weight; rows that tie even then are equal in
all that is returned.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veilink.llm import chunks
from veilink.operators.rows import with_ordinal
from veilink.sources.store import Stored, store

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
PIVOTS = 15
KEPT_FEATURES = 500_000
COUNTED = "bucket int, n long"
WEIGHED = "doc_id long, n_features long, n_words long, weight long"
KEY = ("below", "doc_id", "n_features", "weight")

# A-Z become a-z; all other ASCII but digits and a-z parts words
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b) in string.digits + string.ascii_lowercase else 32 for b in range(256))


class Buckets(dict):
    """Bucket of every feature, each worked out once; emptied when full."""

    def __init__(self, buckets: int, most_words: int) -> None:
        super().__init__()
        self.buckets, self.most_words = buckets, most_words

    def __missing__(self, feature: bytes) -> int:
        self[feature] = n = zlib.crc32(feature) % self.buckets
        return n

    def of(self, text: bytes) -> tuple[int, list[int]]:
        """Number of words, and the buckets of all runs of 1 to ``most_words`` words."""
        if len(self) > KEPT_FEATURES:
            self.clear()
        words = text.translate(_WORDS).split()
        found = list(map(self.__getitem__, words))
        for size in range(2, self.most_words + 1):
            found += [self[b" ".join(words[i : i + size])] for i in range(len(words) - size + 1)]
        return len(words), found


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """Occurrences of every bucket; each task sends its sums, the driver gets one number per bucket."""
    schema = chunks.arrow_schema(COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(buckets, np.int64), Buckets(buckets, most_words)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                total += np.bincount(names.of(text.as_py() or b"")[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], schema=schema)

    summed = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, COUNTED).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of every bucket, shares smoothed by one."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(source.tolist(), target.tolist(), strict=True)])


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_features, n_words, weight) with the floored mean gain of each document's features."""
    schema = chunks.arrow_schema(WEIGHED)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Buckets(len(gain), most_words)
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()):
                n_words, found = names.of(text.as_py() or b"")
                rows.append((len(found), n_words, int(gain[found].sum()) // len(found) if found else 0))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(weigh, WEIGHED)


def draw(seed: int = SEED) -> Column:
    """The Gumbel part of a score, in thousandths, from the checksum of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def kth_key(rows: DataFrame, k: int, key: Column, seed: int = SEED, pivots: int = PIVOTS):
    """The k-th smallest (1 to the number of rows) value of ``key``, by distributed quickselect; None if there is none."""
    part: Stored | None = None
    table, need, turn = rows.select(key.alias("_key")), k, 0
    while need:
        turn += 1
        drawn = [F.min_by("_key", F.xxhash64(F.lit(f"{seed} {turn} {j}"), "_key")).alias(f"p{j}") for j in range(pivots)]
        found = sorted({tuple(p) for p in table.agg(*drawn).first() if p is not None})
        if not found:
            return None
        kind = table.schema["_key"].dataType
        at = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(p, kind.fields, strict=True)]) for p in found]
        counts = table.agg(
            *[F.count_if(F.col("_key") < p).alias(f"b{j}") for j, p in enumerate(at)],
            *[F.count_if(F.col("_key") == p).alias(f"e{j}") for j, p in enumerate(at)],
        ).first()
        low = -1
        for j, p in enumerate(found):
            if counts[f"b{j}"] < need <= counts[f"b{j}"] + counts[f"e{j}"]:
                if part:
                    part.drop()
                return p
            if counts[f"b{j}"] < need:
                low = j
        within = F.lit(True)
        if low >= 0:
            need -= counts[f"b{low}"] + counts[f"e{low}"]
            within &= F.col("_key") > at[low]
        if low + 1 < len(at):
            within &= F.col("_key") < at[low + 1]
        narrowed = store(table.where(within), "between-pivots")
        if part:
            part.drop()
        part, table = narrowed, narrowed.frame
        if need > part.rows:
            return None
    return None


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, most_words: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document with its weight and score; ``rank`` 1, 2, 3... for the ``percent`` of the documents drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, most_words), bucket_counts(target, target_col, buckets, most_words))
    scored = weights(docs, gain, id_col, text_col, most_words).withColumn("score", F.col("weight") + draw(seed))
    open_ = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    table = store(scored.withColumn("open", open_), "scores", n=F.count_if(open_))
    key = F.struct((-F.col("score")).alias("below"), *KEY[1:])
    k = percent * table.seen["n"] // 100
    last = kth_key(table.frame.where("open"), k, key, seed)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return table.frame.select(*out, F.lit(None).cast("long").alias("rank"))
    bound = F.struct(*[F.lit(v).cast("long").alias(name) for name, v in zip(KEY, last, strict=True)])
    taken = F.col("open") & (key <= bound)
    winners = with_ordinal(table.frame.where(taken).select(*out), [F.col("score").desc(), "doc_id", "n_features", "weight"])
    rank = F.when(F.col("ordinal") < k, F.col("ordinal") + 1)  # rows equal to the k-th one may be more than are left
    return winners.select(*out, rank.cast("long").alias("rank")).unionByName(
        table.frame.where(~taken | F.col("score").isNull()).select(*out, F.lit(None).cast("long").alias("rank"))
    )


SQL = r"""
WITH steps AS (
    SELECT list(c ORDER BY i) AS crc FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS t(i))
), texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, 'd' AS side FROM documents
    UNION ALL SELECT row_number() OVER (), NULL, coalesce(text, ''), 'b' FROM benchmark
), split AS (
    SELECT r, doc_id, side, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), counted AS (
    SELECT r, side, word, count(*) AS n FROM (SELECT r, side, unnest(w) AS word FROM split) GROUP BY ALL
), named AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k:
        16 * (instr('0123456789ABCDEF', substr(h, 2 * k + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * k + 2, 1)) - 1)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted), steps
), buckets AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
    FROM counted JOIN named USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000) / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000)))) AS gain
    FROM buckets
), means AS (
    SELECT r, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM counted JOIN named USING (word) JOIN gains USING (bucket)
    WHERE side = 'd' GROUP BY r
), scored AS (
    SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        list_reduce(list_prepend(0, list_transform(range(8), lambda k: instr('0123456789abcdef', substr(sha256('2024:' || doc_id), k + 1, 1)) - 1)),
            lambda c, b: c * 16 + b) AS h
    FROM split LEFT JOIN means USING (r) WHERE side = 'd'
), final AS (
    SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score,
        doc_id IS NOT NULL AND n_features >= 20 AS open FROM scored
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id, n_features, weight) AS place FROM final
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN open AND place <= (SELECT count(*) FROM final WHERE open) * 10 // 100 THEN place END AS rank
FROM ranked
"""
