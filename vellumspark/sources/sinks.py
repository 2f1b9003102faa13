"""Writers: parquet, csv with a byte-order mark, Stata, upserts, a research pack."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel

#: Rows that a driver-side format (Stata, single csv) may have; a panel is an aggregate and stays far below.
MAX_DRIVER_ROWS = 5_000_000


def stata_names(columns: list[str]) -> dict[str, str]:
    """Column to a Stata name: 32 letters, digits or underscores, unique whatever the case (numbered on a base of 28)."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for c in columns:
        name = re.sub(r"[^A-Za-z0-9_]", "_", c)[:32] or "v"
        name = "_" + name[:31] if name[0].isdigit() else name
        base, n = name[:28], 1
        while name.lower() in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name.lower())
        out[c] = name
    return out


def excel_safe(df: DataFrame) -> DataFrame:
    """String cells without control characters and not read as formulas."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"^(?==)", "'")
    return df.withColumns({c: clean(F.col(c)) for c in text}) if text else df


def _local(df: DataFrame):
    n = df.limit(MAX_DRIVER_ROWS + 1).count()
    if n > MAX_DRIVER_ROWS:
        raise ValueError(f"more than {MAX_DRIVER_ROWS} rows: write parquet or csv parts instead")
    return df.toPandas()


def write(df: DataFrame, folder: str, name: str, formats: list[str], partition_by: list[str] | None = None) -> list[str]:
    """Writes ``df`` in every format: parquet and csv_parts in parallel, csv and stata (panels) through the driver."""
    out = []
    for f in formats:
        path = f"{folder.rstrip('/')}/{name}"
        if f == "parquet":
            w = df.write.mode("overwrite")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}.parquet")
            out.append(f"{path}.parquet")
        elif f == "csv_parts":
            df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}_csv")
            out.append(f"{path}_csv")
        elif f == "csv":
            _local(df).to_csv(f"{path}.csv", index=False, encoding="utf-8-sig")
            out.append(f"{path}.csv")
        elif f == "stata":
            pdf = _local(df).rename(columns=stata_names(df.columns))
            for c in pdf.columns[pdf.dtypes == object]:
                pdf[c] = pdf[c].fillna("").astype(str)
            pdf.to_stata(f"{path}.dta", write_index=False, version=118)
            out.append(f"{path}.dta")
        elif f == "excel":
            try:
                import openpyxl  # noqa: F401
            except ImportError as e:
                raise RuntimeError("the excel format needs openpyxl") from e
            _local(excel_safe(df)).to_excel(f"{path}.xlsx", index=False)
            out.append(f"{path}.xlsx")
        else:
            raise ValueError(f"unknown format {f!r}")
    return out


def upsert_partitions(new: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replaces only the partitions that ``new`` has rows for."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def research_pack(df: DataFrame, folder: str, order: str = "report_id") -> dict[str, str]:
    """A panel's files: the panel (one row per firm and year), its statistics, correlations, codebook and a summary."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    one = panel.dedup(df, panel.KEYS, F.col(order) if order in df.columns else F.lit(0)).orderBy(*panel.KEYS)
    names = panel.research_variables(one, require_variance=True)
    out = {"panel": write(one, folder, "panel", ["parquet", "csv"])[0]}
    if names:
        out["stats"] = write(panel.describe(one, names), folder, "descriptive_stats", ["csv"])[0]
        out["correlations"] = write(panel.correlations(one, names), folder, "correlations", ["csv"])[0]
    book = Path(folder, "codebook.csv")
    book.write_text("column,description\n" + "".join(f"{c},{d}\n" for c, d in panel.codebook(one.columns)), encoding="utf-8-sig")
    row = one.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("firms"), F.min("year").alias("a"), F.max("year").alias("b")).first()
    Path(folder, "REPORT.md").write_text(f"# Panel\n\n{row['n']} rows, {row['firms']} firms, {row['a']} to {row['b']}.\n", encoding="utf-8")
    return out | {"codebook": str(book), "report": str(Path(folder, "REPORT.md"))}
