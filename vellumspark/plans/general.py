"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_packed
from ..session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # The sector names are a fixed taxonomy of some dozens.
    known = [r[0] for r in table(spark, d, "icb_sectors").where("sector_name is not null").select("sector_name").distinct().collect()]
    firms = split_packed(table(spark, d, "hnx_companies"), F.col("ticker"), F.col("company_name_and_sector"), "hnx_companies.company_name_and_sector", known)
    variants = split_packed(table(spark, d, "keywords"), F.col("keyword_id"), F.col("variants"), "keywords.variants")
    return firms.unionByName(variants)


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
