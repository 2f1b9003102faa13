"""Readers: parquet, csv, partitioned statements, text folders, report pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "ticker string, year int, item_code string, item_name string, value double"


def catalog(spark: SparkSession, parquet: str, csv: str | None = None) -> DataFrame:
    """The catalog from parquet, else from csv with a header."""
    try:
        return spark.read.parquet(parquet)
    except Exception:
        if csv is None:
            raise
        return spark.read.option("header", True).option("multiLine", True).csv(csv)


def statements(spark: SparkSession, root: str, statement: list[str] | None = None, exchange: list[str] | None = None, tickers: list[str] | None = None, years: tuple[int, int] | None = None, items: list[str] | None = None) -> DataFrame:
    """Facts below ``root``, partitioned by statement and exchange: partitions are pruned, the rest is pushed into the scan."""
    df = spark.read.option("basePath", root).parquet(root)
    for column, chosen in (("statement", statement), ("exchange", exchange), ("ticker", tickers), ("item_code", items)):
        if chosen:
            df = df.where(F.col(column).isin(*chosen))
    return df.where(F.col("year").between(*years)) if years else df


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A csv with a header, typed by ``schema`` where given (nothing is inferred)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every .txt file below a folder, whole texts."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def readable_page(text: Column) -> Column:
    """Whether a page's text layer can be used: 300 characters, 60 letters or digits, few glyph codes, a quarter of it alphanumeric."""
    alnum = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]", ""))
    return (F.length(text) >= 300) & (alnum >= 60) & (F.regexp_count(text, F.lit(r"\(cid:")) < 5) & (F.regexp_count(text, F.lit("�")) < 5) & (alnum / F.length(text) >= 0.25)
