"""Report catalog: search, company lookup, industry tree, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_tickers, strip_accents
from .ranking import one_per_key, rank_within

EXCHANGES = ("HSX", "HNX", "UPCOM")


def exchange_name(c: Column) -> Column:
    """One spelling of the exchanges."""
    u = F.upper(F.trim(c))
    return F.when(u.isin("HOSE", "HSX"), "HSX").when(F.contains(u, F.lit("UPCOM")), "UPCOM").otherwise(u)


def wanted_exchanges(names: list[str] | None) -> list[str]:
    """Exchanges of a filter; empty for no filter (none given, or all of them)."""
    out = {"HSX" if n.strip().upper() in ("HOSE", "HSX") else "UPCOM" if "UPCOM" in n.upper() else n.strip().upper() for n in names or [] if n.strip()}
    return [] if out >= set(EXCHANGES) else sorted(out)


def ticker_predicate(ticker: Column, company: Column, query: str | None) -> Column:
    """A typed list of tickers: equal or contained, any of them; or the whole query as a part of the company's name (4 letters or more)."""
    if not query or not query.strip():
        return F.lit(True)
    tokens = split_tickers(F.lit(query))
    hit = F.exists(tokens, lambda t: F.contains(ticker, t))
    q = query.strip()
    if len(q) >= 4:
        hit = hit | F.coalesce(F.contains(F.upper(company), F.upper(F.lit(q))), F.lit(False)) | F.coalesce(F.contains(F.lower(strip_accents(company)), F.lower(strip_accents(F.lit(q)))), F.lit(False))
    return hit


def search(
    records: DataFrame, query: str | None = None, exchanges: list[str] | None = None, sector: str | None = None, levels: dict[str, str] | None = None,
    year_from: int | None = None, year_to: int | None = None, limit: int = 0,
) -> DataFrame:
    """Catalog records that meet all filters, by ticker and falling year, with the number of all hits in ``total_matched``.

    ``records`` has ticker, company_name, exchange_code, icb_l1, sector_name and report_year.  ``sector`` meets any
    level.  A limit of 0 or less returns everything (a positive one is the feature: a page of hits).
    """
    cond = ticker_predicate(F.col("ticker"), F.col("company_name"), query)
    chosen = wanted_exchanges(exchanges)
    if chosen:
        cond = cond & exchange_name(F.col("exchange_code")).isin(*chosen)
    if sector:
        cond = cond & ((F.col("icb_l1") == sector) | (F.col("sector_name") == sector))
    for level, value in (levels or {}).items():
        cond = cond & (F.col(level) == value)
    cond = cond & F.col("report_year").between(year_from if year_from is not None else 1900, year_to if year_to is not None else 2100)
    hits = records.where(cond)
    total = hits.agg(F.count(F.lit(1)).alias("total_matched"))
    out = hits.join(F.broadcast(total)).orderBy("ticker", F.col("report_year").desc(), "report_id")
    return out.limit(limit) if limit > 0 else out


def with_company(records: DataFrame, companies: DataFrame, sectors: DataFrame) -> DataFrame:
    """Records with company name, exchange and industry; defaults where the firm is unknown.

    The sector list is a fixed taxonomy; companies grow with the data and are left to the optimizer's join choice.
    """
    firm = companies.select("ticker", "company_name", "exchange_code", F.col("industry").alias("sector_name"))
    return (
        records.join(firm, "ticker", "left").join(F.broadcast(sectors.select("sector_name", "icb_l1", "icb_code")), "sector_name", "left")
        .withColumns({"icb_l1": F.coalesce("icb_l1", F.lit("Khác")), "sector_name": F.coalesce("sector_name", F.lit("Chưa phân loại"))})
    )


def industry_tree(companies: DataFrame, sectors: DataFrame) -> DataFrame:
    """(level, icb_l1, sector_name, n_companies): companies per sector and per level-1 industry; level-1 names without firms stay."""
    firms = sectors.select("icb_l1", "sector_name").join(companies.select("ticker", F.col("industry").alias("sector_name")), "sector_name", "left")
    # Sectors are a partition of the industries, so the counts of one aggregation add up to the other.
    return firms.rollup("icb_l1", "sector_name").agg(F.countDistinct("ticker").alias("n_companies"), F.grouping_id().alias("g")).where("icb_l1 is not null").select(
        F.when(F.col("g") == 0, F.lit("sector")).otherwise("l1").alias("level"), "icb_l1", "sector_name", "n_companies"
    )


def nested_tree(companies: DataFrame, sectors: DataFrame) -> DataFrame:
    """(icb_l1, n_companies, sectors ARRAY<STRUCT>): the tree with sectors by falling count, then name."""
    per = sectors.join(companies.select("ticker", F.col("industry").alias("sector_name")), "sector_name", "left").groupBy("icb_l1", "sector_name").agg(F.min("icb_code").alias("icb_code"), F.countDistinct("ticker").alias("n"))
    return per.groupBy("icb_l1").agg(F.sum("n").alias("n_companies"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "sector_name", "icb_code", "n"))).alias("sectors"))


def year_summary(reports: DataFrame) -> DataFrame:
    """(ticker, years, n_years, first_year, last_year, n_records) of every ticker."""
    return reports.where("ticker is not null and report_year is not null").groupBy("ticker").agg(
        F.array_sort(F.collect_set("report_year")).alias("years"), F.countDistinct("report_year").alias("n_years"), F.min("report_year").alias("first_year"),
        F.max("report_year").alias("last_year"), F.count(F.lit(1)).alias("n_records"),
    )


def supplement(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows and those of ``extra`` whose keys the base lacks."""
    return base.unionByName(extra.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def override(base: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``newer`` and the base rows whose keys it lacks."""
    return supplement(newer, base, keys)


def first_file(files: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first file of each firm and year."""
    return one_per_key(files, keys, order)


def archive_names(files: DataFrame, folder: Column, name: Column) -> DataFrame:
    """Files with their place in an archive; repeated names get a running suffix."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    ranked = rank_within(files.withColumn("__path", F.concat_ws("/", folder, name)), ["__path"], "report_id", "__rank")
    rn = F.col("__rank")
    return ranked.withColumn("arcname", F.when(rn == 1, F.col("__path")).otherwise(F.concat(folder, F.lit("/"), stem, F.lit("_"), (rn - 1).cast("string"), ext))).drop("__path", "__rank")
