"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept.  All but the last return the columns of documents.  Defined results:
a null text is empty, a null id is kept and never counts as a copy; of rows that repeat an id those with near copies among
earlier rows go in the second stage, other texts of the id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilink.llm import jaccard, kneser, mixing, packing, substring
from veilink.sources.store import fresh_path, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    whole = docs.select(others.alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    kept = kneser.judged(whole, labels, "_id", "_text", "_lang", keep=["_row", "_text"]).where("kept")
    return kept.select("_row.*", F.col("_text").alias("text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each similarity class: the one with the smallest id; rows that repeat an id are told apart by their contents."""
    clear = "_" * max(map(len, docs.columns))  # longer than any name in use
    key, again = f"{clear}key", f"{clear}again"
    counts = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeats = store(counts.select("doc_id", F.lit(True).alias(again)), "repeated-ids")
    if repeats.rows:
        contents = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        met = docs.join(repeats.small_side(64), "doc_id", "left")
        keyed = met.withColumn(key, F.when(F.col(again), contents).otherwise(F.col("doc_id"))).drop(again)
        classes = jaccard.similarity_classes(keyed, id_col=key).withColumnRenamed("doc_id", key)
        ids = keyed.select(key, "doc_id").where(F.col(key).isNotNull()).distinct()
        order = F.struct("doc_id", key)
        first = classes.join(ids, key).groupBy("component_id").agg(F.min_by(key, order).alias(key)).select(key)
        kept = keyed.join(first, key, "left_semi").dropDuplicates([key]).drop(key).select(*docs.columns)
    else:
        first = jaccard.similarity_classes(docs).where("doc_id = component_id").select("doc_id")
        kept = docs.join(first, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


# to the last digit that the types hold
PRECISE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that an earlier document holds; ``n_chars`` follows."""
    others = [c for c in docs.columns if c != "text"]
    carried = F.to_json(F.struct(*others), PRECISE)
    found = substring.remove_repeats(docs, with_text=True, carry=carried)
    whole = docs.select(*others).schema
    rows = found.select(F.col("kept").alias("text"), F.from_json("carried", whole, PRECISE).alias("r")).select("text", "r.*")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that are trained on."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

# models, similarity classes and token ids have no SQL form; tests hold the stages to plain models
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
