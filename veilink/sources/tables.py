"""Delimited-file and table readers and writers."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True
) -> DataFrame:
    """Delimited text in UTF-8.  Pass a schema at scale: inference costs a second pass over the files."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", by: str = "file") -> DataFrame:
    """All delimited files of a folder that share a schema, with their file's stem as ``table``.

    ``by='folder'`` names the table after the folder that holds the file, for tables of several part files.
    """
    if by == "folder":
        name = F.try_url_decode(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]*$", 1))
    else:
        name = F.regexp_replace(F.col("_metadata.file_name"), "[.][^.]*$", "")
    rows = read_delimited(spark, path, schema, sep).select("*", name.alias("table"))
    return rows


def folder_tables(spark: SparkSession, path: str, schema: T.StructType | str, names: list[str], sep: str = ",") -> dict[str, DataFrame]:
    """The named tables of a folder, each a part of the one scan: no file list reaches the driver."""
    rows = read_folder(spark, path, schema, sep)
    return {name: rows.where(F.col("table") == name).drop("table") for name in names}


def write_base(base: DataFrame, path: str, fmt: str = "csv") -> None:
    """The finished person base, with an explicit id column."""
    writer = base.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)


def append_results(results: DataFrame, path: str, by: str = "Tipo_erro", fmt: str = "csv", run: str | None = None) -> None:
    """Append reports or links, one folder per error type, in one job.

    With ``run`` the rows stand in a folder of that run, which is replaced as a whole: a run that is retried or repeated
    leaves its rows once, and those of other runs stay.  ``run`` comes back as a column where the path is read.
    """
    writer = results.write.partitionBy(by)
    if run is None:
        writer = writer.mode("append")
    else:
        path, writer = f"{path.rstrip('/')}/run={quote(run, safe='')}", writer.mode("overwrite").option("partitionOverwriteMode", "static")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def normalise_columns(df: DataFrame, names: dict[str, str], upper: list[str] = (), integers: list[str] = ()) -> DataFrame:
    """Rename columns, upper-case join keys, and read codes as integers (bad text becomes null)."""
    df = df.withColumnsRenamed(names)
    changed = {c: F.upper(c) for c in upper}
    changed |= {c: F.col(c).try_cast("double").try_cast("int") for c in integers}
    return df.withColumns(changed) if changed else df
