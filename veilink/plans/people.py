"""Person tables derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Digits of the source names become letters, so that the spelling rules have work.
DIGITS, LETTERS = "0123456789", "AEIOSZKYWR"
UNPARTNERED_OF, UNPARTNERED_AT = 20, 19
GOLD_OFFSET = 1_000_000


def _letters(text: Column, tail: int) -> Column:
    return F.translate(F.right(text, F.lit(tail)), DIGITS, LETTERS)


def people_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, guardian, birth_date, city_code, state)."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    part = table("part").select("p_partkey", F.upper("p_name").alias("p_name"))
    supplier = table("supplier").select("s_suppkey", "s_name")
    nation = table("nation").select("n_nationkey", F.col("n_name").alias("state"))
    born = table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    # The two counts are scalar subqueries.
    n_part = part.agg(F.count(F.lit(1))).scalar()
    n_supplier = supplier.agg(F.count(F.lit(1))).scalar()
    customer = table("customer").select(
        F.col("c_custkey").alias("id"), "c_name", "c_nationkey", "c_mktsegment", n_part.alias("np"), n_supplier.alias("ns")
    )
    keyed = customer.select(
        "id", "c_name", "c_nationkey", "c_mktsegment",
        (F.col("id") % F.col("np")).alias("k1"),
        ((F.col("id") * 7 + 3) % F.col("np")).alias("k2"),
        (F.col("id") % F.col("ns")).alias("k3"),
    )
    joined = (
        keyed.join(part.toDF("k1", "first"), "k1")
        .join(part.toDF("k2", "second"), "k2")
        .join(supplier.toDF("k3", "s_name"), "k3")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(born, F.col("id") == F.col("o_custkey"), "left")
    )
    return joined.select(
        "id",
        F.concat_ws(" ", "first", "c_mktsegment", _letters(F.col("c_name"), 5)).alias("name"),
        F.concat(F.col("second"), F.lit(" DE "), _letters(F.col("s_name"), 4)).alias("guardian"),
        F.date_format("d", "dd/MM/yyyy").alias("birth_date"),
        (F.lit(100000) + F.col("c_nationkey") * 1000 + F.col("id") % 1000).cast("string").alias("city_code"),
        "state",
    )


def side_a(people: DataFrame) -> DataFrame:
    return people.where(F.col("id") % UNPARTNERED_OF != UNPARTNERED_AT)


def side_b(people: DataFrame) -> DataFrame:
    """All people, with the flag of those A does not hold; not yet damaged."""
    return people.withColumn("has_partner", F.col("id") % UNPARTNERED_OF != UNPARTNERED_AT)


GOLD_COLUMNS = ["nome", "data_nasc", "sexo", "mae", "municipio"]


def gold_sides(people: DataFrame, damaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A and B in the gold shape: five attributes, B damaged, with other ids and the true partner in ``check``."""

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select(
            "id",
            F.col("name").alias("nome"),
            F.col("birth_date").alias("data_nasc"),
            F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("sexo"),
            F.col("guardian").alias("mae"),
            F.col("city_code").alias("municipio"),
        )

    b = shaped(damaged).withColumn("check", F.col("id")).withColumn("id", F.col("id") + GOLD_OFFSET)
    return side_a(shaped(people)), b


def with_copies(people: DataFrame) -> DataFrame:
    """A with exact copies of some records under other ids."""
    copies = people.where(F.col("id") % UNPARTNERED_OF == 7).withColumn("id", F.col("id") + GOLD_OFFSET)
    return side_a(people).unionByName(copies)


def with_repeated_ids(people: DataFrame) -> DataFrame:
    """A with a second, later record (``ord``) under some ids: name and guardian exchanged."""
    first = side_a(people).withColumn("ord", F.col("id") * 2)
    later = first.where(F.col("id") % UNPARTNERED_OF == 3).withColumn("ord", F.col("ord") + 1)
    return first.unionByName(exchanged(later))


def exchanged(people: DataFrame) -> DataFrame:
    return people.withColumns({"name": F.col("guardian"), "guardian": F.col("name")})
