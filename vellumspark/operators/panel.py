"""Panel assembly: merging frames on firm and year, dummies, descriptive statistics, correlations."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import one_per_key

KEYS = ["ticker", "year"]


def normal_keys(df: DataFrame, ticker: str = "ticker", year: str = "year") -> DataFrame:
    """Upper-case trimmed tickers, numeric years; rows without either key go."""
    out = df.withColumn("ticker", F.upper(F.trim(F.col(ticker).cast("string")))).withColumn("year", F.col(year).cast("string").try_cast("double").cast("int"))
    return out.where(F.col("ticker").isNotNull() & (F.col("ticker") != "") & F.col("year").isNotNull())


def dedup(df: DataFrame, keys: list[str], order: Column, keep: str = "first") -> DataFrame:
    """One row for each key: the first or last by ``order``."""
    return one_per_key(df, keys, order, last=keep == "last")


def merge_outer(left: DataFrame, *others: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Full outer merge on the keys; columns that the left side already has are dropped from the right."""
    out = left
    for o in others:
        out = out.join(o.drop(*[c for c in o.columns if c in out.columns and c not in keys]), keys, "full")
    return out


def merge_left(left: DataFrame, right: DataFrame, order_left: Column, order_right: Column, suffix: str = "_fin", keys: list[str] = KEYS) -> DataFrame:
    """Left merge of normalised, deduplicated sides (first left, last right row of a key); colliding right columns get the suffix."""
    a = dedup(normal_keys(left), keys, order_left)
    b = dedup(normal_keys(right), keys, order_right, "last")
    b = b.withColumnsRenamed({c: c + suffix for c in b.columns if c in a.columns and c not in keys})
    return a.join(b, keys, "left")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, pct): filled values of every column, in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("__n"))
    rows = counts.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in columns])).alias("x"))
    return rows.select("x.variable", "x.n", F.when(F.col("__n") > 0, F.round(F.col("x.n") / F.col("__n") * 100, 1)).otherwise(F.lit(0.0)).alias("pct"))


def dummies(df: DataFrame, column: str, values: list, prefix: str) -> DataFrame:
    """0/1 columns for an explicit list of values; null is 0 everywhere."""
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, missing_pct, mean, std, min, q25, median, q75, max), exact quantiles, one pass, four decimals."""
    one = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.when(F.count(F.lit(1)) > 0, F.round((F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1)) * 100, 2)).otherwise(F.lit(0.0)).alias("missing_pct"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"),
                F.round(F.min(c).cast("double"), 4).alias("min"), F.transform(F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), lambda x: F.round(x, 4)).alias("q"), F.round(F.max(c).cast("double"), 4).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s")) for c in columns])).alias("x"))
    q = F.col("x.s.q")
    return rows.select("x.variable", "x.s.n", "x.s.missing_pct", "x.s.mean", "x.s.std", "x.s.min", F.get(q, F.lit(0)).alias("q25"), F.get(q, F.lit(1)).alias("median"), F.get(q, F.lit(2)).alias("q75"), "x.s.max")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr): Pearson correlations of all pairs over the rows where both are filled, in one aggregation."""
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    both = lambda x, y: F.when(F.col(y).isNotNull(), F.col(x).cast("double"))
    one = df.agg(*[F.round(F.corr(both(a, b), both(b, a)), 4).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def research_variables(df: DataFrame, require_variance: bool = False) -> list[str]:
    """Names of numeric columns worth a statistic: core measures first, no keys, dummies or file facts."""
    skip = {"ticker", "year", "pages", "labor_page", "labor_confidence"}
    first = ["Frequency", "Log_Frequency", "Mention", "Density", "Unique_Keywords", "Word_Count", "Labor"]
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal") and f.name.lower() not in skip and not f.name.startswith(("year_", "ind_"))]
    chosen = [c for c in first if c in numeric] + [c for c in numeric if c not in first]
    if require_variance and chosen:
        row = df.agg(*[F.stddev_samp(c).alias(c) for c in chosen]).first()
        chosen = [c for c in chosen if row[c] is not None and row[c] > 0]
    return chosen


def int_or(c: Column, default: int = 1) -> Column:
    """A number rounded half to even, the default where it is none."""
    return F.coalesce(F.bround(c.cast("string").try_cast("double"), 0), F.lit(float(default))).cast("long")


def ordered(df: DataFrame, core: list[str]) -> DataFrame:
    """Core columns first, the rest behind."""
    have = [c for c in core if c in df.columns]
    return df.select(*have, *[c for c in df.columns if c not in have])


def nonempty_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with some value that is neither null nor zero (one aggregation)."""
    row = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def reconcile(reports: DataFrame, facts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(n_reports, n_matched, n_missing, match_rate): firm-years with reports against firm-years with statements."""
    a = reports.select(*keys).distinct()
    b = facts.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return a.join(b, keys, "left").agg(
        F.count(F.lit(1)).alias("n_reports"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("n_matched"), F.count_if(F.col("__hit").isNull()).alias("n_missing"),
        F.round(F.coalesce(F.sum("__hit"), F.lit(0)) / F.count(F.lit(1)) * 100, 2).alias("match_rate"),
    )


def codebook(columns: list[str]) -> list[tuple[str, str]]:
    """(column, description) of a panel's columns."""
    known = {
        "ticker": "Firm code", "year": "Report year", "Word_Count": "Words in the text", "Frequency": "Keyword matches", "Log_Frequency": "ln(1 + Frequency)",
        "Mention": "1 if any keyword occurs", "Density": "Matches per 100 words", "Unique_Keywords": "Distinct keywords found", "Labor": "Headcount",
    }
    kind = lambda c: "Matches of a category" if c.endswith("_Freq") else "Year dummy" if c.startswith("year_") else "Industry dummy" if c.startswith("ind_") else "Financial measure"
    return [(c, known.get(c, kind(c))) for c in columns]
