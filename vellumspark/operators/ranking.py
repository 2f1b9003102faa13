"""Ranks and first rows that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one part of a ranked table is meant to hold.
PART_ROWS = 500_000


def one_per_key(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``, ties to the smaller hash of the row.

    An aggregation, not a window: rows are combined on the map side, so a hot key is never sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    rank = F.struct(order.alias("o"), (-tie if last else tie).alias("t"))
    pick = (F.max_by if last else F.min_by)(F.struct(*rest) if rest else F.struct(F.lit(1).alias("__one")), rank)
    out = df.groupBy(*keys).agg(pick.alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def rank_within(df: DataFrame, keys: list[str], order: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with the rank (from 1) of each row within its keys by the numeric column ``order``.

    Rows are ranked inside ranges of ``order`` and offset by the ranges before, so that a key with a third of all
    rows is ranked by many tasks.  Small tables have one range.
    """
    parts = max(1, -(-df.count() // part_rows))
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []  # as many as parts
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    rows = df.withColumn("__part", part)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    local = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order))
    if not bounds:
        return rows.withColumn(name, local).drop("__part")
    sizes = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), before.alias("__before"))
    cond = F.col("__part") == F.col("__p")
    for c in same:
        cond = cond & c
    out = rows.withColumn("__local", local).join(offsets, cond)
    return out.withColumn(name, F.col("__local") + F.col("__before")).select(*df.columns, name)
