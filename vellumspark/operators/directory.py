"""Company directory, record selection, availability, coverage and the industry tree with all its levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_tickers
from .catalog import EXCHANGES, exchange_name, wanted_exchanges
from .ranking import one_per_key


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drops the columns with these names, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def company_info(companies: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """The company list without its last column, of the given tickers only."""
    out = companies.select(*companies.columns[:-1])
    return out if tickers is None else out.join(tickers.select("ticker"), "ticker", "left_semi")


def by_ids(records: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Records whose key is among ``ids``."""
    return records.join(ids.select(key), key, "left_semi")


def with_status(records: DataFrame, status: str, wanted: Sequence[str]) -> DataFrame:
    return records.where(F.col(status).isin(*wanted))


def preview(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by ``order``: one top-k pass, no full sort."""
    return df.orderBy(*order).limit(n)


def local_predicate(ticker: Column, query: str | None) -> Column:
    """Among local files one token may be a part of the ticker, and so may several if one is short; several long ones name tickers."""
    if not query or not query.strip():
        return F.lit(True)
    tokens = split_tickers(F.lit(query))
    part = F.exists(tokens, lambda t: F.contains(ticker, t))
    short = F.exists(tokens, lambda t: F.length(t) < 3)
    return F.when((F.size(tokens) == 1) | short, part).otherwise(F.array_contains(tokens, ticker))


def local_search(records: DataFrame, query: str | None = None, exchanges: list[str] | None = None, year_from: int | None = None, year_to: int | None = None, level_value: str | None = None, levels: Sequence[str] = ()) -> DataFrame:
    """Local records that meet all filters, by ticker and falling year; ``level_value`` may be the name of any of ``levels``."""
    cond = local_predicate(F.upper("ticker"), query)
    chosen = wanted_exchanges(exchanges)
    if chosen:
        cond = cond & exchange_name(F.col("exchange_code")).isin(*chosen)
    if year_from:
        cond = cond & (F.col("report_year") >= year_from)
    if year_to:
        cond = cond & (F.col("report_year") <= year_to)
    if level_value:
        any_level = F.lit(False)
        for level in levels:
            any_level = any_level | F.coalesce(F.col(level) == level_value, F.lit(False))
        cond = cond & any_level
    return records.where(cond).orderBy("ticker", F.col("report_year").desc())


def companies_like(companies: DataFrame, query: str | None = None, exchange: str | None = None, level: tuple[str, str] | None = None, has: str | None = None) -> DataFrame:
    """Companies by a part of ticker or name, exchange, industry level and a field that must be filled."""
    cond = F.lit(True)
    if query:
        q = F.lit(query.strip().lower())
        cond = F.contains(F.lower("ticker"), q) | F.coalesce(F.contains(F.lower("company_name"), q), F.lit(False))
    if exchange:
        cond = cond & F.contains(F.upper(F.coalesce("exchange_code", F.lit(""))), F.lit(exchange.upper()))
    if level:
        cond = cond & (F.col(level[0]) == level[1])
    if has:
        cond = cond & F.col(has).isNotNull() & (F.trim(has) != "")
    return companies.where(cond)


def availability(records: DataFrame, local: DataFrame, indexed: DataFrame, status: Column, period: Column, record_id: Column) -> DataFrame:
    """Records with ``is_local`` and ``origin``: a local file of firm and year, else one indexed by its name, else what the record says of itself."""
    files = one_per_key(local, ["ticker", "report_year"], F.col("local_path")).select("ticker", "report_year", F.col("local_path").alias("__file"))
    names = one_per_key(indexed, ["ticker", "report_year"], F.col("local_path")).select("ticker", "report_year", F.col("local_path").alias("__name"))
    both = records.join(files, ["ticker", "report_year"], "left").join(names, ["ticker", "report_year"], "left")
    own = (
        F.when((status == "gap_filler") | (period == "gap_filler") | F.contains(record_id, F.lit("GAP_")), "gap_filler")
        .when((period == "supplement") | F.contains(record_id, F.lit("SUPP_")), "supplement").otherwise("archive")
    )
    held = F.coalesce("__file", "__name")
    return both.select(*records.columns, held.isNotNull().alias("is_local"), held.alias("local_path"), F.when(held.isNotNull(), "local").otherwise(own).alias("origin"))


def ticker_summary(local: DataFrame, archive: DataFrame) -> DataFrame:
    """(ticker, years, total_reports, local_reports, has_local, year_range): the years of both sides together, in one pass over both."""
    both = local.select("ticker", "report_year", F.lit(True).alias("here")).unionAll(archive.select("ticker", "report_year", F.lit(False)))
    out = both.where("ticker is not null and report_year is not null").groupBy(F.upper("ticker").alias("ticker")).agg(
        F.array_sort(F.collect_set("report_year")).alias("years"), F.countDistinct("report_year").alias("total_reports"),
        F.countDistinct(F.when(F.col("here"), F.col("report_year"))).alias("local_reports"), F.concat_ws("-", F.min("report_year").cast("string"), F.max("report_year").cast("string")).alias("year_range"),
    )
    return out.withColumn("has_local", F.col("local_reports") > 0)


def active_years(*sources: DataFrame) -> DataFrame:
    """(ticker, years): the distinct years of every ticker over all sources with (ticker, year); rows without either are left out."""
    pairs = sources[0].select("ticker", "year")
    for s in sources[1:]:
        pairs = pairs.unionAll(s.select("ticker", "year"))
    return pairs.where("ticker is not null and year is not null").groupBy("ticker").agg(F.array_sort(F.collect_set("year")).alias("years"))


def coverage(reports: DataFrame) -> DataFrame:
    """One row: records, firms, years, first and last year, pages and records with text."""
    return reports.agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("report_year").alias("n_years"), F.min("report_year").alias("first_year"),
        F.max("report_year").alias("last_year"), F.sum("total_pages").alias("n_pages"), F.count("ocr_path").alias("n_with_text"),
    )


def levelled(sectors: DataFrame) -> DataFrame:
    """The sector list with its four levels: the industry, two and three digits of the code, the sector."""
    return sectors.select("icb_code", "icb_l1", F.substring("icb_code", 1, 2).alias("icb_l2"), F.substring("icb_code", 1, 3).alias("icb_l3"), F.col("sector_name").alias("icb_l4"))


LEVELS = ("icb_l1", "icb_l2", "icb_l3", "icb_l4")


def tree(firms: DataFrame, sectors: DataFrame, counted: Column, exchanges: list[str] | None = None, supported: DataFrame | None = None, keep_empty: bool = True) -> DataFrame:
    """(level, icb_l1..icb_l4, icb_code, n): counts at every level of the industry tree by one rollup, with the least code below.

    ``firms`` has ticker, exchange_code, industry and what ``counted`` sums.  ``supported`` keeps its tickers only;
    without ``keep_empty`` branches without firms are pruned.
    """
    chosen = wanted_exchanges(exchanges)
    kept = firms.where(exchange_name(F.col("exchange_code")).isin(*chosen)) if chosen else firms
    if supported is not None:
        kept = kept.join(supported.select("ticker"), "ticker", "left_semi")
    # A firm counts once, whatever the number of its rows.
    per_firm = kept.groupBy(F.col("industry").alias("icb_l4"), "ticker").agg(counted.alias("__n"))
    sums = per_firm.groupBy("icb_l4").agg(F.sum("__n").alias("__n"))
    out = levelled(sectors).join(sums, "icb_l4", "left" if keep_empty else "inner").rollup(*LEVELS).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.min("icb_code").alias("icb_code"), F.grouping_id().alias("__g"))
    return out.where("icb_l1 is not null").select((F.lit(4) - F.bit_count("__g")).cast("int").alias("level"), *LEVELS, "icb_code", "n")


def in_order(nodes: DataFrame) -> DataFrame:
    """Tree nodes with their place among their siblings: the larger count first, then the name."""
    name = F.coalesce("icb_l4", "icb_l3", "icb_l2", "icb_l1")
    # Siblings share all levels but their own; there are as many nodes as the fixed taxonomy has.
    parent = F.when(F.col("level") == 1, F.lit("")).when(F.col("level") == 2, F.col("icb_l1")).when(F.col("level") == 3, F.concat_ws("|", "icb_l1", "icb_l2")).otherwise(F.concat_ws("|", "icb_l1", "icb_l2", "icb_l3"))
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("level", parent).orderBy(F.col("n").desc(), name)))


def gap_order(targets: DataFrame) -> DataFrame:
    """Missing firm-years by exchange (HSX, HNX, UPCOM, others), the latest year first."""
    rank = F.array_position(F.array(*[F.lit(e) for e in EXCHANGES]), exchange_name(F.col("exchange_code")))
    rank = F.when(F.coalesce(rank, F.lit(0)) == 0, len(EXCHANGES) + 1).otherwise(rank).cast("int")
    return targets.withColumn("exchange_rank", rank).orderBy("exchange_rank", F.col("report_year").desc(), "ticker")


def indexed_files(files: DataFrame, keys: list[str], size: str, order: Column, least: int = 10_000) -> DataFrame:
    """The first file of each firm and year among those large enough to be a report."""
    return one_per_key(files.where(F.col(size) >= least), keys, order)


def repeated_next_year(files: DataFrame, content: str) -> DataFrame:
    """(ticker, report_year, next_year): firms whose file of one year has the same content as that of the year after."""
    known = files.where(f"ticker is not null and report_year is not null and {content} is not null").select("ticker", "report_year", F.md5(content).alias("h")).distinct()
    later = known.select("ticker", (F.col("report_year") - 1).alias("report_year"), "h")
    return known.join(later, ["ticker", "report_year", "h"]).select("ticker", "report_year", (F.col("report_year") + 1).alias("next_year")).distinct()
