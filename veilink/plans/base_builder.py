"""Builds the synthetic person base from a register, a city lookup and a date sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.rows import zip_rows
from ..operators.sampling import stratified_sample
from ..operators.synth import with_synthetic_date
from ..sources.tables import normalise_columns

# Sampling fraction and seeds of the two samples.
FRACTION = 0.05
BASE_SEED, GUARDIAN_SEED = 1991, 312


def with_city_code(register: DataFrame, cities: DataFrame, city: str = "MUNICIPIO", code: str = "COD_MUNICIPIO") -> DataFrame:
    """Left join on the upper-cased city name; a name held by two states matches both."""
    lookup = normalise_columns(cities, {}, upper=[city]).select(city, code)
    return register.join(lookup, city, "left")


def synthetic_base(
    register: DataFrame,
    cities: DataFrame,
    dates: DataFrame,
    date: str,
    key: str,
    stratum: str = "UF",
    fraction: float = FRACTION,
) -> DataFrame:
    """(ID, COD_MUNICIPIO, NOME, NOME_RESPONSAVEL, data_nasc).

    Two independent samples of the register are paired by position; the second one's names become
    guardians.  Rows with any null are dropped; ID is the position before dropping.
    """
    coded = with_city_code(register, cities)
    base = stratified_sample(coded, stratum, fraction, key, BASE_SEED).select(key, "COD_MUNICIPIO", "NOME")
    guardians = stratified_sample(coded, stratum, fraction, key, GUARDIAN_SEED).select(
        F.col(key).alias("_key"), F.col("NOME").alias("NOME_RESPONSAVEL")
    )
    paired = zip_rows(base, guardians, [key], ["_key"]).select(
        F.col("ordinal").alias("ID"), "COD_MUNICIPIO", "NOME", "NOME_RESPONSAVEL"
    )
    dated = with_synthetic_date(paired, dates, date, "ID", BASE_SEED)
    return dated.select("ID", "COD_MUNICIPIO", "NOME", "NOME_RESPONSAVEL", "data_nasc").dropna()
