"""Queries of catalog search, panels, statements, news and headcounts, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, finance, labor, labor_tables, news, panel
from ..session import spread, table

# The statement items that the order lines stand for in the financial queries.
ITEMS = {
    "bs_tong_tai_san": "sum(l_extendedprice)", "bs_von_chu_so_huu": "sum(l_extendedprice * (1 - l_discount)) / 2", "bs_no_phai_tra": "sum(l_extendedprice) / 3",
    "bs_tai_san_ngan_han": "sum(case when l_linestatus = 'O' then l_extendedprice else 0 end)", "bs_no_ngan_han": "sum(case when l_returnflag = 'R' then l_extendedprice else 0 end)",
    "bs_tien": "sum(l_tax * l_extendedprice)", "bs_hang_ton_kho": "sum(case when l_returnflag = 'A' then l_extendedprice end)", "is_doanh_thu_thuan": "sum(l_extendedprice * (1 - l_discount))",
    "is_gia_von_hang_ban": "-sum(l_extendedprice * 0.6)", "is_loi_nhuan_sau_thue": "sum(l_extendedprice * (0.2 - l_discount))", "is_tong_loi_nhuan_truoc_thue": "sum(l_extendedprice * (0.25 - l_discount))",
    "is_chi_phi_lai_vay": "sum(l_tax * l_extendedprice) / 10", "bs_loi_nhuan_chua_phan_phoi": "sum(l_discount * l_extendedprice)", "cf_luu_chuyen_tien_thuan_tu_hoat_dong_kinh_doanh": "sum(l_quantity * 10)",
}


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Long statements: a firm is a supplier, its years are the orders' years."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    wide = lines.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.year("o_orderdate").alias("year")).agg(*[F.expr(e).alias(c) for c, e in ITEMS.items()])
    return wide.select("ticker", "year", F.explode(F.array(*[F.struct(F.lit(c).alias("item_code"), F.col(c).cast("double").alias("value")) for c in ITEMS])).alias("x")).select("ticker", "year", "x.item_code", "x.value")


def statement_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = finance.pivot_facts(facts(spark, d), list(ITEMS))
    return wide.select("ticker", "year", *[F.round(c, 2).alias(c) for c in ITEMS])


def financial_ratios(spark: SparkSession, d: str) -> DataFrame:
    base = finance.base_items(finance.pivot_facts(facts(spark, d), list(ITEMS)))
    names = ["roa", "roe", "net_margin", "debt_to_assets", "current_ratio", "gross_margin", "interest_coverage", "rev_growth_yoy", "assets_growth_yoy", "altman_z_prime", "size_ln", "dio", "roic"]
    out = finance.ratios(base, names)
    return out.select("ticker", "year", *[F.round(c, 4).alias(c) for c in names])


def all_ratios(spark: SparkSession, d: str) -> DataFrame:
    out = finance.ratios(finance.base_items(finance.pivot_facts(facts(spark, d), list(ITEMS))))
    return out.select("ticker", "year", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def balance_identity(spark: SparkSession, d: str) -> DataFrame:
    wide = finance.pivot_facts(facts(spark, d), list(ITEMS)).withColumn("resources", F.lit(None).cast("double"))
    out = finance.identity_check(wide, "bs_tong_tai_san", "resources", "bs_no_phai_tra", "bs_von_chu_so_huu")
    return out.groupBy("balanced").agg(F.count(F.lit(1)).alias("n"))


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = finance.lookup(facts(spark, d).where("not (item_code = 'bs_hang_ton_kho' and value < 2000000)"), ["bs_hang_ton_kho", "bs_tien"], "stock")
    return out.select("ticker", "year", F.round("stock", 2).alias("stock"))


def firm_grid(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    tickers = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    revenue = f.where("item_code = 'is_doanh_thu_thuan'").select("ticker", "year", F.round("value", 2).alias("revenue"))
    return finance.grid(tickers, 1994, 2002).join(revenue, ["ticker", "year"], "left")


def item_groups(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("item_code").agg(F.count("value").alias("n")).select("item_code", "n", finance.item_group(F.col("item_code")).alias("accounting_group"))


def facts_upsert(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    new = f.where("ticker like '%5'").withColumn("value", F.col("value") * 2)
    return finance.upsert_facts(f, new.unionByName(new)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("total"))


def panel_merge(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "reports").select("ticker", F.col("report_year").alias("year"), "total_pages", "report_id")
    audits = table(spark, d, "multi_era_50_results").select("ticker", F.col("report_year").alias("year"), "labor", "pages", "audit_id")
    out = panel.merge_left(reports, audits, F.col("report_id"), F.col("audit_id"))
    return out.select("ticker", "year", "report_id", "total_pages", "audit_id", "labor")


def panel_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "reports").where("ticker is not null").groupBy("ticker", F.col("report_year").alias("year")).agg(F.count(F.lit(1)).alias("n_reports"))
    b = table(spark, d, "multi_era_50_results").where("ticker is not null").groupBy("ticker", F.col("report_year").alias("year")).agg(F.count(F.lit(1)).alias("n_audits"))
    c = table(spark, d, "labor_audit_50_results").where("ticker is not null").groupBy("ticker", F.col("report_year").alias("year")).agg(F.max("labor").alias("labor"))
    return panel.merge_outer(a, b, c)


def describe_reports(spark: SparkSession, d: str) -> DataFrame:
    return panel.describe(table(spark, d, "reports"), ["total_pages", "total_words", "report_year"])


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return panel.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def coverage_share(spark: SparkSession, d: str) -> DataFrame:
    return panel.coverage(table(spark, d, "reports"), ["ticker", "pdf_path", "ocr_path", "total_pages", "total_words", "company_id"])


def year_dummies(spark: SparkSession, d: str) -> DataFrame:
    out = panel.dummies(table(spark, d, "reports").select("report_id", "report_year", "record_source"), "report_year", [2008, 2015, 2023], "year")
    return panel.dummies(out, "record_source", ["issuer_site", "crawl_retry"], "src").drop("record_source", "report_year")


def reconcile_years(spark: SparkSession, d: str) -> DataFrame:
    return panel.reconcile(table(spark, d, "multi_era_50_results").where("ticker is not null"), table(spark, d, "labor_audit_50_results"), ["ticker", "report_year"])


def first_records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").where("ticker is not null and report_year is not null")
    return catalog.first_file(r, ["ticker", "report_year"], F.col("report_id")).select("ticker", "report_year", "report_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_company(table(spark, d, "reports").select("report_id", "ticker", "report_year", "total_pages"), table(spark, d, "companies"), table(spark, d, "icb_sectors"))


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.search(_records(spark, d), "v, XA; thép", ["HOSE", "HNX"], None, None, 2010, 2020)
    return out.select("report_id", "ticker", "report_year", "company_name", "sector_name", "total_matched")


def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(_records(spark, d), None, ["UPCOM"], sector="Tài chính", limit=50).select("report_id", "ticker", "report_year", "total_matched")


def industry_tree(spark: SparkSession, d: str) -> DataFrame:
    return catalog.industry_tree(table(spark, d, "companies"), table(spark, d, "icb_sectors"))


def ticker_years(spark: SparkSession, d: str) -> DataFrame:
    return catalog.year_summary(table(spark, d, "reports"))


def record_supplement(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "multi_era_50_results").select("ticker", "report_year", F.col("audit_id").alias("row_id"), F.lit("a").alias("side"))
    b = table(spark, d, "labor_audit_50_results").select("ticker", "report_year", F.col("row_index").alias("row_id"), F.lit("b").alias("side"))
    return catalog.supplement(a, b, ["ticker", "report_year"])


def archive_names(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").where("pdf_path is not null").withColumn("base", F.regexp_extract(F.replace("pdf_path", F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    return catalog.archive_names(r, F.col("report_year").cast("string"), F.col("base")).select("report_id", "arcname")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).where("doc_kind = 'news' and text is not null")
    title = F.substring_index("text", ".", 1)
    return docs.select(
        F.col("doc_id").alias("article_id"), "ticker", "source", F.year("published_at").alias("year"), F.weekofyear("published_at").alias("week"), F.length("source").alias("source_rank"), F.substring(title, 1, 200).alias("title"),
        F.substring("text", 1, 300).alias("sapo"), "text",
    )


def news_clusters(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).where("ticker is not null and year is not null")
    return news.cluster_articles(a, F.concat_ws("|", "ticker", F.col("year").cast("string"), F.col("week").cast("string")))


def news_panel(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).where("ticker is not null and year is not null")
    hits = F.regexp_count(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])(?:rủi ro|risk)(?![\p{L}\p{N}_])"))
    # How often a text was printed; counted by hash before it is joined.
    a = a.withColumn("h", F.md5("text"))
    printed = a.groupBy("h").agg(F.count(F.lit(1)).alias("reprints"))
    return news.firm_year(a.join(printed, "h"), hits, F.col("reprints"))


def news_gap_filled(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).where("ticker is not null and year is not null")
    counts = a.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("total_articles"))
    first = table(spark, d, "companies").select("ticker").join(a.groupBy("ticker").agg(F.min("year").alias("first_year")), "ticker", "left")
    return news.gap_filled(counts, first, 2014, 2023)


def company_mentions(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).join(table(spark, d, "companies").select("ticker", "company_name"), "ticker")
    return a.select("article_id", news.company_confirmed(F.col("ticker"), F.col("company_name"), F.col("title"), F.col("sapo"), F.col("text"), F.col("source"), F.split(F.col("company_name"), " ")).alias("confirmed"))


def shingle_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Bigram Jaccard of neighbouring articles of a firm and year (by id)."""
    from pyspark.sql import Window

    a = _articles(spark, d).where("ticker is not null and year is not null").select("ticker", "year", "article_id", news.word_shingles(F.substring("text", 1, 2500)).alias("s"))
    w = Window.partitionBy("ticker", "year").orderBy("article_id")
    return a.select("article_id", F.lag("article_id").over(w).alias("prev_id"), F.col("s"), F.lag("s").over(w).alias("p")).where("prev_id is not null").select("article_id", "prev_id", F.round(news.jaccard(F.col("s"), F.col("p")), 4).alias("jaccard"))


def article_years(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", tx.article_year(F.col("published_at").cast("date").cast("string"), F.col("source"), F.col("text")).alias("year"))


def headcount_candidates(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "multi_era_50_results")).where("raw_text is not null").select("audit_id", "report_year", "raw_text")
    return labor.scored(labor.candidates(a, ["audit_id", "report_year"], "raw_text"), "report_year").select("audit_id", "pattern", "value", "score")


def headcounts(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "multi_era_50_results")).where("raw_text is not null").select("audit_id", "report_year", "raw_text")
    return labor.best(labor.scored(labor.candidates(a, ["audit_id", "report_year"], "raw_text"), "report_year"), ["audit_id"])


def headcount_tables(spark: SparkSession, d: str) -> DataFrame:
    """Headcounts of tables, notes and callouts in both audits, the best by value for each record."""
    both = spread(table(spark, d, "multi_era_50_results")).select(F.lit("multi").alias("audit"), F.col("audit_id").alias("record_id"), "report_year", F.col("raw_text").alias("text")).unionAll(
        spread(table(spark, d, "labor_audit_50_results")).select(F.lit("labor"), F.col("row_index"), "report_year", F.col("snippet"))
    )
    found = labor_tables.candidates(both, ["audit", "record_id"], "text", "report_year")
    return found.groupBy("audit", "record_id", "value").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("strategy")).alias("strategies"))


def headcount_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "multi_era_50_results").where("raw_text is not null").select("audit_id", labor_tables.page_score(F.col("raw_text"), F.col("report_year")).alias("score")).where(F.col("score") >= labor_tables.PAGE_LEAST)


def headcount_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the headcount tables' cells (between the double slashes)."""
    a = table(spark, d, "labor_audit_50_results").where("snippet like '%//%'")
    cells = a.select("row_index", F.posexplode(F.transform(F.split("snippet", "//"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))).alias("i", "cell"))
    return cells.where(F.col("cell").rlike(r"^[0-9]{1,3}([.][0-9]{3})*$")).select("row_index", "i", tx.headcount_number(F.col("cell")).alias("value"))


QUERIES = {
    "statement_pivot": statement_pivot, "financial_ratios": financial_ratios, "all_ratios": all_ratios, "balance_identity": balance_identity, "alias_lookup": alias_lookup, "firm_grid": firm_grid,
    "item_groups": item_groups, "facts_upsert": facts_upsert, "panel_merge": panel_merge, "panel_outer": panel_outer, "describe_reports": describe_reports, "correlation_matrix": correlation_matrix,
    "coverage_share": coverage_share, "year_dummies": year_dummies, "reconcile_years": reconcile_years, "first_records": first_records, "catalog_search": catalog_search, "catalog_page": catalog_page,
    "industry_tree": industry_tree, "ticker_years": ticker_years, "record_supplement": record_supplement, "archive_names": archive_names, "news_clusters": news_clusters, "news_panel": news_panel,
    "news_gap_filled": news_gap_filled, "company_mentions": company_mentions, "shingle_overlap": shingle_overlap, "article_years": article_years, "headcount_candidates": headcount_candidates,
    "headcounts": headcounts, "headcount_numbers": headcount_numbers, "headcount_tables": headcount_tables, "headcount_pages": headcount_pages,
}

_WIDE = "WITH w AS (SELECT 'S' || l_suppkey AS ticker, CAST(year(o_orderdate) AS INT) AS year, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in ITEMS.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)\n"
_LONG = _WIDE + ", f AS (UNPIVOT w ON " + ", ".join(ITEMS) + " INTO NAME item_code VALUE value)\n"


def _group_sql(c: str) -> str:
    """The accounting groups as a CASE chain."""
    arms = [f"WHEN starts_with({c}, '{prefix}') AND (" + " OR ".join(f"contains({c}, '{x}')" for x in parts) + f") THEN '{name}'" for name, parts, prefix in finance.ITEM_GROUPS]
    return "CASE " + " ".join(arms) + " ELSE 'other' END"


def _ratios_sql() -> str:
    """All ratios by plain division: what is no finite number is null, as is what has a null part."""
    columns = list(ITEMS)
    items = []
    for item, patterns in finance.BASE_ITEMS.items():
        found = list(dict.fromkeys(c for p in patterns if p != "abs" for c in finance.codes_of(p, columns)))
        c = f"coalesce({', '.join(found)}, NULL)" if found else "CAST(NULL AS DOUBLE)"
        items.append((f"abs({c})" if patterns[0] == "abs" else c) + f" AS {item}")
    either = lambda a, b: f"CASE WHEN {a} IS NOT NULL OR {b} IS NOT NULL THEN coalesce({a}, 0) + coalesce({b}, 0) END"
    derived = {
        "ar_cust": "coalesce(ar_cust, receivables)", "gross_profit": "coalesce(gross_profit, revenue - cogs)", "eat_parent": "coalesce(eat_parent, eat)",
    }
    added = f"{either('st_debt', 'lt_debt')} AS fin_debt, {either('selling_exp', 'admin_exp')} AS sga, curr_assets - curr_liab AS nwc"

    def ratio(formula: str) -> str:
        if formula.startswith("yoy("):
            x = formula[4:-1]
            return f"({x} - lag({x}) OVER t) / abs(lag({x}) OVER t)"
        return re.sub(r"(\d)D\b", r"\1", re.sub(r"\bz\((\w+)\)", r"coalesce(\1, 0)", formula))

    rows = [f"CAST({ratio(f)} AS DOUBLE) AS {n}" for g in finance.RATIOS.values() for n, f in g.items()]
    names = [n for g in finance.RATIOS.values() for n in g]
    return (
        _WIDE + f", b AS (SELECT ticker, year, {', '.join(items)} FROM w), c AS (SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in derived.items())}), {added} FROM b), "
        "d AS (SELECT * REPLACE (coalesce(ebit, ebt + coalesce(interest_exp, 0), operating_profit, gross_profit - sga) AS ebit) FROM c), e AS (SELECT * REPLACE (coalesce(ebitda, ebit) AS ebitda) FROM d), "
        f"r AS (SELECT ticker, year, {', '.join(rows)} FROM e WINDOW t AS (PARTITION BY ticker ORDER BY year)) SELECT ticker, year, {', '.join(f'CASE WHEN isfinite({n}) THEN round({n}, 4) END AS {n}' for n in names)} FROM r"
    )


def _candidates_sql() -> str:
    """Figures of every headcount pattern, with the year of the pattern's first hit and their score."""
    arms = []
    for name, strategy, base, pattern in labor.PATTERNS:
        wide = "(" + pattern.replace(labor._N, r"(?:\d[\d.,]*)") + ")"
        arms.append(f"SELECT audit_id, report_year, '{name}' AS pattern, '{strategy}' AS strategy, {base}::DOUBLE AS base, unnest(regexp_extract_all(low, '{pattern}', 1)) AS raw, regexp_extract(regexp_extract(low, '{wide}', 1), '((?:19|20)\\d\\d)', 1) AS y FROM a".replace("\\\\", "\\"))
    tier = "CASE " + " ".join(f"WHEN strategy = '{s}' THEN {v}::DOUBLE" for s, v in labor.TIER.items()) + " ELSE 0.1::DOUBLE END"
    return (
        "WITH a AS (SELECT audit_id, report_year, lower(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS low FROM multi_era_50_results WHERE raw_text IS NOT NULL), c AS (".replace("\\\\", "\\") + " UNION ALL ".join(arms)
        + "), v AS (SELECT *, CAST(regexp_replace(raw, '[.,]', '', 'g') AS BIGINT) AS value, TRY_CAST(nullif(y, '') AS INT) AS span_year FROM c), k AS (SELECT *, "
        f"{tier} + CASE WHEN span_year = report_year THEN 0.35::DOUBLE WHEN span_year IS NULL THEN 0.20::DOUBLE ELSE -0.15::DOUBLE END + CASE WHEN strategy = 'group' THEN 0.1::DOUBLE ELSE 0 END + base * 0.2::DOUBLE"
        " - CASE WHEN (value BETWEEN 2005 AND 2040 OR value IN (31, 30, 29, 28, 12)) AND strategy <> 'breakdown' THEN 0.3::DOUBLE ELSE 0 END AS s, coalesce(span_year = report_year, TRUE) AS matched "
        f"FROM v WHERE value BETWEEN {labor.LEAST} AND {labor.MOST})\n"
    )


_NEWS = r"""WITH a AS (SELECT doc_id AS article_id, ticker, CAST(year(published_at) AS INT) AS year, text FROM documents WHERE doc_kind = 'news' AND text IS NOT NULL AND ticker IS NOT NULL AND published_at IS NOT NULL)
"""
_CANDIDATES = _candidates_sql()
_UNITS = "(" + " OR ".join(f"contains(low, '{w}')" for w in labor_tables.UNITS) + ")"
SQL = {
    "headcount_pages": "WITH a AS (SELECT audit_id, CAST(report_year AS VARCHAR) AS y, lower(raw_text) AS low FROM multi_era_50_results WHERE raw_text IS NOT NULL), p AS (SELECT audit_id, CAST("
    + " + ".join(f"15 * CAST(contains(low, '{w}') AS INT)" for w in labor_tables.LABELS)
    + f" + CASE WHEN {_UNITS} THEN 10 ELSE 0 END + CASE WHEN contains(low, '31/12/' || y) OR contains(low, '31 tháng 12 năm ' || y) THEN 25 WHEN contains(low, y) THEN 5 ELSE 0 END AS INT) AS score FROM a) SELECT * FROM p WHERE score >= 10",
    "all_ratios": _ratios_sql(),
    "headcount_candidates": _CANDIDATES + "SELECT audit_id, pattern, value, round(s, 4) AS score FROM k",
    "headcounts": _CANDIDATES
    + """, p AS (SELECT audit_id, value, count(*) OVER (PARTITION BY audit_id, value, matched) AS n, matched AND round(s, 4) > 0.4 AS a, round(s, 4) AS score, base, pattern, strategy FROM k),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY a DESC, score DESC, base DESC, value, n DESC, pattern DESC, strategy DESC) = 1)
SELECT audit_id, value AS labor, pattern, strategy, round(least(0.99::DOUBLE, score + CASE WHEN n >= 2 THEN 0.10::DOUBLE ELSE 0 END), 4) AS confidence,
CASE WHEN round(least(0.99::DOUBLE, score + CASE WHEN n >= 2 THEN 0.10::DOUBLE ELSE 0 END), 4) >= 0.7 THEN 'SUCCESS' WHEN round(least(0.99::DOUBLE, score + CASE WHEN n >= 2 THEN 0.10::DOUBLE ELSE 0 END), 4) >= 0.5 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status FROM t""",
    "statement_pivot": _WIDE + "SELECT ticker, year, " + ", ".join(f"round({c}, 2) AS {c}" for c in ITEMS) + " FROM w",
    "financial_ratios": _WIDE + """, b AS (SELECT ticker, year, bs_tong_tai_san AS ta, bs_von_chu_so_huu AS eq, bs_no_phai_tra AS td, bs_tai_san_ngan_han AS ca, bs_no_ngan_han AS cl, bs_tien AS cash,
coalesce(bs_hang_ton_kho, NULL) AS inv, is_doanh_thu_thuan AS rev, abs(is_gia_von_hang_ban) AS cogs, is_loi_nhuan_sau_thue AS eat, is_tong_loi_nhuan_truoc_thue AS ebt, abs(is_chi_phi_lai_vay) AS ie,
bs_loi_nhuan_chua_phan_phoi AS re FROM w), c AS (SELECT *, rev - cogs AS gp, ebt + coalesce(ie, 0) AS ebit, ca - cl AS nwc, lag(rev) OVER t AS prev, lag(ta) OVER t AS pta FROM b WINDOW t AS (PARTITION BY ticker ORDER BY year))
SELECT ticker, year, round(eat / nullif(ta, 0), 4) AS roa, round(eat / nullif(eq, 0), 4) AS roe, round(eat / nullif(rev, 0), 4) AS net_margin, round(td / nullif(ta, 0), 4) AS debt_to_assets,
round(ca / nullif(cl, 0), 4) AS current_ratio, round(gp / nullif(rev, 0), 4) AS gross_margin, round(ebit / nullif(ie, 0), 4) AS interest_coverage, round((rev - prev) / nullif(abs(prev), 0), 4) AS rev_growth_yoy,
round((ta - pta) / nullif(abs(pta), 0), 4) AS assets_growth_yoy,
round(0.717 * (nwc / nullif(ta, 0)) + 0.847 * (re / nullif(ta, 0)) + 3.107 * (ebit / nullif(ta, 0)) + 0.42 * (eq / nullif(td, 0)) + 0.998 * (rev / nullif(ta, 0)), 4) AS altman_z_prime,
round(CASE WHEN ta > 0 THEN ln(ta) END, 4) AS size_ln, round(inv * 365 / nullif(cogs, 0), 4) AS dio, round(ebit * (1 - 0.2) / nullif(eq - coalesce(cash, 0), 0), 4) AS roic FROM c""",
    "balance_identity": _WIDE + "SELECT (abs(bs_tong_tai_san - (bs_no_phai_tra + bs_von_chu_so_huu)) < 1.0 OR abs(bs_tong_tai_san - (bs_no_phai_tra + bs_von_chu_so_huu)) < 0.001 * abs(bs_tong_tai_san)) AS balanced, count(*) AS n FROM w GROUP BY 1",
    "alias_lookup": _WIDE + "SELECT ticker, year, round(coalesce(CASE WHEN bs_hang_ton_kho >= 2000000 THEN bs_hang_ton_kho END, bs_tien), 2) AS stock FROM w WHERE coalesce(CASE WHEN bs_hang_ton_kho >= 2000000 THEN bs_hang_ton_kho END, bs_tien) IS NOT NULL",
    "firm_grid": _WIDE + "SELECT 'S' || s_suppkey AS ticker, CAST(y AS INT) AS year, round(is_doanh_thu_thuan, 2) AS revenue FROM supplier CROSS JOIN range(1994, 2003) r(y) LEFT JOIN w ON w.ticker = 'S' || s_suppkey AND w.year = y",
    "item_groups": _WIDE + "SELECT item_code, count(value) AS n, " + _group_sql("item_code") + " AS accounting_group FROM (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR item_code IN (" + ", ".join(ITEMS) + "))) GROUP BY 1",
    "article_years": r"""WITH y AS (SELECT doc_id, CAST(year(published_at) AS VARCHAR) AS p, regexp_extract(source, '/((?:19|20)\d\d)/', 1) AS a, regexp_extract(source, '(?:^|\D)((?:19|20)\d\d)(?:\D|$)', 1) AS b, regexp_extract(substring(text, 1, 600), '\d{1,2}[/.-]\d{1,2}[/.-]((?:19|20)\d\d)', 1) AS c,
regexp_extract(substring(text, 1, 300), '(?:^|\D)((?:19|20)\d\d)(?:\D|$)', 1) AS d FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(coalesce(p, nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(d, '')) AS INT) AS year FROM y""",
    "company_mentions": r"""WITH a AS (SELECT doc_id AS article_id, d.ticker, company_name, substring(split_part(text, '.', 1), 1, 200) || ' ' || substring(text, 1, 300) || ' ' || substring(text, 1, 4000) AS body, source FROM documents d JOIN companies c ON d.ticker = c.ticker WHERE doc_kind = 'news' AND text IS NOT NULL),
b AS (SELECT *, lower(trim(regexp_replace(regexp_replace(company_name, '(?i)^\s*(?:tổng\s+công\s+ty|công\s+ty|ctcp|ngân\s+hàng|tập\s+đoàn)\s*(?:cổ\s+phần|tnhh|mtv|tm)?\s*(?:mtv)?\s*', ''), '(?i)\s*[-–]\s*(?:ctcp|công\s+ty\s+cổ\s+phần)\s*$|\s*\([^)]*\)\s*$', ''))) AS brand FROM a)
SELECT article_id, (source = 'company_website' OR contains(source, 'custom') OR coalesce(list_bool_or(list_transform(string_split(company_name, ' '), lambda t: length(t) >= 4 AND contains(lower(body), lower(t)))), false) OR regexp_matches(lower(body), '(?:^|[^\p{L}\p{N}_])(?:mã(?: chứng khoán| ck)?|cổ phiếu|hose:|hnx:|upcom:)\s*' || lower(ticker) || '(?:[^\p{L}\p{N}_]|$)') OR regexp_matches(body, '(?:^|[^A-Za-z0-9])' || ticker || '(?:[^A-Za-z0-9]|$)') OR coalesce(length(company_name) > 6 AND contains(lower(body), lower(company_name)), false) OR coalesce(length(brand) >= 4 AND contains(lower(body), brand), false)) AS confirmed FROM b""",
    "facts_upsert": _LONG + "SELECT ticker, count(*) AS n, round(sum(CASE WHEN ticker LIKE '%5' THEN value * 2 ELSE value END), 1) AS total FROM (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR item_code IN (" + ", ".join(ITEMS) + "))) GROUP BY 1",
    "panel_merge": """WITH a AS (SELECT upper(trim(ticker)) AS ticker, report_year AS year, total_pages, report_id FROM reports WHERE trim(ticker) <> '' AND report_year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), report_year ORDER BY report_id) = 1),
b AS (SELECT upper(trim(ticker)) AS ticker, report_year AS year, labor, audit_id FROM multi_era_50_results WHERE trim(ticker) <> '' AND report_year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), report_year ORDER BY audit_id DESC) = 1)
SELECT a.ticker, CAST(a.year AS INT) AS year, report_id, total_pages, audit_id, labor FROM a LEFT JOIN b USING (ticker, year)""",
    "panel_outer": """WITH a AS (SELECT ticker, report_year AS year, count(*) AS n_reports FROM reports WHERE ticker IS NOT NULL GROUP BY 1, 2), b AS (SELECT ticker, report_year AS year, count(*) AS n_audits FROM multi_era_50_results WHERE ticker IS NOT NULL GROUP BY 1, 2),
c AS (SELECT ticker, report_year AS year, max(labor) AS labor FROM labor_audit_50_results WHERE ticker IS NOT NULL GROUP BY 1, 2) SELECT * FROM a FULL JOIN b USING (ticker, year) FULL JOIN c USING (ticker, year)""",
    "describe_reports": " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM reports"
        for c in ("total_pages", "total_words", "report_year")
    ),
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "coverage_share": " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(count({c}) / count(*) * 100, 1) AS pct FROM reports" for c in ("ticker", "pdf_path", "ocr_path", "total_pages", "total_words", "company_id")),
    "year_dummies": "SELECT report_id, " + ", ".join(f"CAST(coalesce(report_year = {y}, false) AS INT) AS year_{y}" for y in (2008, 2015, 2023)) + ", " + ", ".join(f"CAST(coalesce(record_source = '{s}', false) AS INT) AS src_{s}" for s in ("issuer_site", "crawl_retry")) + " FROM reports",
    "reconcile_years": """WITH a AS (SELECT DISTINCT ticker, report_year FROM multi_era_50_results WHERE ticker IS NOT NULL), b AS (SELECT DISTINCT ticker, report_year, 1 AS hit FROM labor_audit_50_results)
SELECT count(*) AS n_reports, count(hit) AS n_matched, count(*) - count(hit) AS n_missing, round(count(hit) / count(*) * 100, 2) AS match_rate FROM a LEFT JOIN b USING (ticker, report_year)""",
    "first_records": "SELECT ticker, report_year, min(report_id) AS report_id FROM reports WHERE ticker IS NOT NULL AND report_year IS NOT NULL GROUP BY 1, 2",
    "catalog_search": """WITH r AS (SELECT report_id, r.ticker, report_year, company_name, upper(trim(exchange_code)) AS x, industry FROM reports r LEFT JOIN companies c USING (ticker)),
h AS (SELECT *, CASE WHEN x IN ('HOSE', 'HSX') THEN 'HSX' WHEN contains(x, 'UPCOM') THEN 'UPCOM' ELSE x END AS e FROM r)
SELECT report_id, ticker, report_year, company_name, CASE WHEN s.sector_name IS NULL THEN coalesce(industry, 'Chưa phân loại') ELSE industry END AS sector_name, count(*) OVER () AS total_matched FROM h LEFT JOIN icb_sectors s ON industry = s.sector_name
WHERE (contains(ticker, 'V') OR contains(ticker, 'XA') OR contains(ticker, 'THÉP') OR contains(upper(company_name), upper('v, XA; thép')) OR contains(replace(strip_accents(lower(company_name)), 'đ', 'd'), 'v, xa; thep'))
AND e IN ('HSX', 'HNX') AND report_year BETWEEN 2010 AND 2020""",
    "catalog_page": """WITH h AS (SELECT report_id, r.ticker, report_year FROM reports r JOIN companies c USING (ticker) LEFT JOIN icb_sectors s ON industry = s.sector_name
WHERE contains(upper(trim(exchange_code)), 'UPCOM') AND (icb_l1 = 'Tài chính' OR industry = 'Tài chính') AND report_year BETWEEN 1900 AND 2100)
SELECT report_id, ticker, report_year, count(*) OVER () AS total_matched FROM h ORDER BY ticker, report_year DESC, report_id LIMIT 50""",
    "industry_tree": """WITH f AS (SELECT icb_l1, sector_name, ticker FROM icb_sectors LEFT JOIN companies ON industry = sector_name)
SELECT 'sector' AS level, icb_l1, sector_name, count(DISTINCT ticker) AS n_companies FROM f GROUP BY 2, 3 UNION ALL SELECT 'l1', icb_l1, NULL, count(DISTINCT ticker) FROM f GROUP BY 2""",
    "ticker_years": "SELECT ticker, list_sort(list(DISTINCT report_year)) AS years, count(DISTINCT report_year) AS n_years, min(report_year) AS first_year, max(report_year) AS last_year, count(*) AS n_records FROM reports WHERE ticker IS NOT NULL AND report_year IS NOT NULL GROUP BY 1",
    "record_supplement": """SELECT ticker, report_year, audit_id AS row_id, 'a' AS side FROM multi_era_50_results UNION ALL
SELECT ticker, report_year, row_index, 'b' FROM labor_audit_50_results b WHERE NOT EXISTS (SELECT 1 FROM multi_era_50_results a WHERE a.ticker = b.ticker AND a.report_year = b.report_year)""",
    "archive_names": r"""WITH b AS (SELECT report_id, CAST(report_year AS VARCHAR) AS folder, regexp_extract(replace(pdf_path, '\', '/'), '([^/]*)$', 1) AS base FROM reports WHERE pdf_path IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY folder || '/' || base ORDER BY report_id) AS rn FROM b)
SELECT report_id, CASE WHEN rn = 1 THEN folder || '/' || base ELSE folder || '/' || regexp_extract(base, '^(.*?)(\.[^.]*)?$', 1) || '_' || (rn - 1) || regexp_extract(base, '(\.[^.]*)$', 1) END AS arcname FROM n""",
    "news_panel": _NEWS + r""", p AS (SELECT ticker, year, count(*) OVER (PARTITION BY md5(text)) AS r, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS w,
len(list_filter(regexp_split_to_array(replace(replace(lower(text), 'rủi ro', '¤rr¤'), '', ''), '[^\p{L}\p{N}_¤]+'), lambda x: x = '¤rr¤' OR x = 'risk')) AS h FROM a)
SELECT ticker, year, count(*) AS total_articles, CAST(sum(r) AS BIGINT) AS total_articles_full, CAST(sum(w) AS BIGINT) AS total_words, CAST(sum(w * r) AS BIGINT) AS total_words_full, CAST(sum(h) AS BIGINT) AS total_hits, CAST(sum(h * r) AS BIGINT) AS total_hits_full,
count(*) FILTER (h > 0) AS articles_with_hits, round(count(*) FILTER (h > 0) / count(*) * 100, 2) AS hit_ratio_pct, round(sum(h) * 1000.0 / nullif(sum(w), 0), 4) AS density_per_1000, round(ln(1 + sum(h)), 6) AS log_hits FROM p GROUP BY 1, 2""",
    "news_gap_filled": _NEWS + """, c AS (SELECT ticker, year, count(*) AS n FROM a GROUP BY 1, 2), s AS (SELECT ticker, min(year) AS fy FROM a GROUP BY 1)
SELECT k.ticker, CAST(y AS INT) AS year, coalesce(n, 0) AS total_articles FROM companies k LEFT JOIN s USING (ticker) CROSS JOIN range(2014, 2024) r(y) LEFT JOIN c ON c.ticker = k.ticker AND c.year = y WHERE y >= greatest(coalesce(fy, 2014), 2014)""",
    "shingle_overlap": r"""WITH a AS (SELECT ticker, year(published_at) AS yr, doc_id AS article_id, list_filter(regexp_split_to_array(lower(substring(text, 1, 2500)), '[^\p{L}\p{N}\p{M}_]+'), lambda x: x <> '') AS w FROM documents WHERE doc_kind = 'news' AND text IS NOT NULL AND ticker IS NOT NULL AND published_at IS NOT NULL),
s AS (SELECT ticker, yr, article_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE list_distinct(w) END AS s FROM a),
p AS (SELECT article_id, lag(article_id) OVER t AS prev_id, s, lag(s) OVER t AS q FROM s WINDOW t AS (PARTITION BY ticker, yr ORDER BY article_id))
SELECT article_id, prev_id, round(CASE WHEN len(s) > 0 AND len(q) > 0 THEN len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q))) ELSE 0.0 END, 4) AS jaccard FROM p WHERE prev_id IS NOT NULL""",
    "headcount_numbers": r"""WITH c AS (SELECT row_index, string_split(snippet, '//') AS cells FROM labor_audit_50_results WHERE snippet LIKE '%//%'),
e AS (SELECT row_index, unnest(range(0, len(cells))) AS i, unnest(list_transform(cells, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS cell FROM c)
SELECT row_index, CAST(i AS INT) AS i, CAST(replace(cell, '.', '') AS BIGINT) AS value FROM e WHERE regexp_matches(cell, '^[0-9]{1,3}([.][0-9]{3})*$')""",
}
