"""Headcount extraction: candidates by pattern tables, native scoring, best pick.

The rule base is data: each pattern has an id, a strategy and a base confidence.  Candidates are drawn with built-in
regular expressions; scoring and picking are column arithmetic and one aggregation a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import headcount_number

LEAST, MOST = 1, 150_000
_N = r"(\d{1,3}(?:[.,]\d{3})+|\d{1,6})"
_UNIT = r"(?:người|nhân viên|lao động|cbcnv|employees|people|staff)"
#: (id, strategy, base confidence, pattern; group 1 is the figure, group 2 a year if there is one).
PATTERNS = (
    ("counted_at", "narrative", 0.98, rf"(?:biên chế thực tế|số nhân viên chính thức|tổng số (?:cán bộ|lao động|nhân viên))[^.\d]{{0,60}}(?:kỳ báo cáo \d{{4}} )?là {_N}"),
    ("average_of", "narrative", 0.95, rf"(?:lực lượng nhân sự bình quân|lao động bình quân)[^.]{{0,60}}?(?:ở mức|là|đạt) {_N} {_UNIT}"),
    ("has_working", "narrative", 0.96, rf"đơn vị có {_N} {_UNIT}"),
    ("size_equals", "group", 0.95, rf"quy mô lao động hợp nhất[^.]{{0,40}}?bằng {_N} {_UNIT}"),
    ("total_was", "narrative", 0.97, rf"total headcount was\W{{0,3}}{_N}"),
    ("stood_at", "narrative", 0.95, rf"(?:average )?workforce of[^.]{{0,60}}?stood at {_N}"),
    ("employed", "narrative", 0.96, rf"employed {_N} {_UNIT}"),
    ("table_total", "breakdown", 0.94, rf"(?:cộng|total) // {_N} // 100"),
)
TIER = {"breakdown": 0.30, "narrative": 0.45, "group": 0.45}


def valid(value: Column, has_unit: Column) -> Column:
    """Figures that can be a headcount: in range, 20 at least without a unit."""
    return value.between(LEAST, MOST) & (has_unit | (value >= 20))


def year_like(value: Column) -> Column:
    """Figures that rather are a year or a day of the month."""
    return value.between(2005, 2040) | value.isin(31, 30, 29, 28, 12)


def candidates(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, pattern, strategy, value, base, matched_year)``: every figure that a pattern finds."""
    low = F.lower(F.regexp_replace(F.col(text), r"\s+", " "))

    def drawn(pattern_id: str, strategy: str, base: float, pattern: str) -> Column:
        wide = "(" + pattern.replace(_N, r"(?:\d[\d.,]*)") + ")"
        figures = F.regexp_extract_all(low, F.lit(pattern), 1)
        return F.transform(figures, lambda x: F.struct(F.lit(pattern_id).alias("pattern"), F.lit(strategy).alias("strategy"), F.lit(base).alias("base"), x.alias("raw"), F.regexp_extract(low, wide, 1).alias("span")))

    found = F.concat(*[drawn(*p) for p in PATTERNS])
    rows = pages.select(*keys, F.explode(found).alias("c"))
    value = headcount_number(F.col("c.raw"))
    return rows.select(
        *keys, "c.pattern", "c.strategy", "c.base", "c.raw", value.alias("value"), F.regexp_extract(F.col("c.span"), r"((?:19|20)\d\d)", 1).try_cast("int").alias("span_year")
    ).where(valid(F.col("value"), F.lit(True)))


def scored(rows: DataFrame, year: str) -> DataFrame:
    """Candidates with ``matched`` (their year is the report's or unsaid) and a score."""
    matched = F.coalesce(F.col("span_year") == F.col(year), F.lit(True))
    tier = F.lit(0.1)
    for s, v in TIER.items():
        tier = F.when(F.col("strategy") == s, F.lit(v)).otherwise(tier)
    score = tier + F.when(F.col("span_year") == F.col(year), 0.35).when(F.col("span_year").isNull(), 0.20).otherwise(-0.15) + F.when(F.col("strategy") == "group", 0.1).otherwise(0.0) + F.col("base") * 0.2
    score = score - F.when(year_like(F.col("value")) & (F.col("strategy") != "breakdown"), 0.3).otherwise(0.0)
    return rows.withColumns({"matched": matched, "score": F.round(score, 4)})


def best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One headcount a document: matched candidates above 0.4 first, then the score; ties to the pattern's name, then the value.

    Two candidates that agree raise the confidence by 0.10, to 0.99 at most; 0.70 is a success, 0.50 ambiguous.
    """
    order = F.struct((F.col("matched") & (F.col("score") > 0.4)).alias("a"), "score", F.col("base"), (-F.col("value")).alias("v"))
    per = rows.groupBy(*keys, "value", "matched").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(order.alias("o"), "pattern", "strategy", "score")).alias("t"))
    top = per.groupBy(*keys).agg(F.max(F.struct(F.col("t.o").alias("o"), "value", "n", F.col("t.pattern").alias("pattern"), F.col("t.strategy").alias("strategy"), F.col("t.score").alias("score"))).alias("b"))
    confidence = F.round(F.least(F.lit(0.99), F.col("b.score") + F.when(F.col("b.n") >= 2, 0.10).otherwise(0.0)), 4)
    return top.select(
        *keys, F.col("b.value").alias("labor"), "b.pattern", "b.strategy", confidence.alias("confidence"),
        F.when(confidence >= 0.7, "SUCCESS").when(confidence >= 0.5, "AMBIGUOUS").otherwise("NOT_FOUND").alias("status"),
    )


def chunks(text: Column, size: int = 3000, stride: int = 2500) -> Column:
    """Overlapping windows of a long text: ``ARRAY<STRUCT<page, text>>``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.struct((F.floor(s / stride) + 1).cast("int").alias("page"), F.substring(text, s + 1, size).alias("text")))


def split_pages(text: Column) -> Column:
    """Pages of a text: at form feeds or page marks, else overlapping chunks."""
    marked = F.split(text, r"\f|---\s*\[Page \d+\]\s*---")
    return F.when(F.size(marked) > 1, F.transform(marked, lambda p, i: F.struct((i + 1).cast("int").alias("page"), p.alias("text")))).otherwise(chunks(text))
