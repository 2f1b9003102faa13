"""Queries of the company directory, the industry tree, availability, and further statement and news operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corrections
from ..operators import contexts, directory, finance, metrics, news
from ..session import spread, table
from . import panel_queries, text_queries
from .panel_queries import _WIDE, ITEMS
from .text_queries import _HITS

FACTS = "(SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR item_code IN (" + ", ".join(ITEMS) + ")))"


def _firms(spark: SparkSession, d: str) -> DataFrame:
    """Reports with what the directory knows of their firms."""
    firm = table(spark, d, "companies").select("ticker", "company_name", "exchange_code", "industry")
    return table(spark, d, "reports").select("report_id", "ticker", "report_year", "ocr_path", "ocr_status", "mining_status", "record_source", "total_pages").join(firm, "ticker")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return _firms(spark, d).join(directory.levelled(table(spark, d, "icb_sectors")).withColumnRenamed("icb_l4", "industry"), "industry", "left").withColumn("icb_l4", F.col("industry"))


def industry_levels(spark: SparkSession, d: str) -> DataFrame:
    out = directory.tree(table(spark, d, "companies"), table(spark, d, "icb_sectors"), F.lit(1))
    return directory.in_order(out)


def industry_reports(spark: SparkSession, d: str) -> DataFrame:
    return directory.tree(_firms(spark, d), table(spark, d, "icb_sectors"), F.count(F.lit(1)), ["HOSE", "HNX"])


def industry_supported(spark: SparkSession, d: str) -> DataFrame:
    supported = table(spark, d, "multi_era_50_results").where("labor is not null").select("ticker").distinct()
    return directory.tree(table(spark, d, "companies"), table(spark, d, "icb_sectors"), F.lit(1), supported=supported, keep_empty=False)


def local_reports(spark: SparkSession, d: str) -> DataFrame:
    local = _levels(spark, d).where("ocr_status = 'done'")
    one = directory.local_search(local, "A", ["HSX"], 2012, None).select("report_id", F.lit("one").alias("kind"))
    short = directory.local_search(local, "AB, XYZ4", None, None, 2018).select("report_id", F.lit("short").alias("kind"))
    level = directory.local_search(local, None, None, None, None, "Tài chính", directory.LEVELS).select("report_id", F.lit("level").alias("kind"))
    return one.unionAll(short).unionAll(level)


def records_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "snippets").where("match_type = 'fuzzy'").select("report_id")
    return directory.by_ids(table(spark, d, "reports"), ids, "report_id").select("report_id", "ticker", "report_year")


def company_directory(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "companies").join(directory.levelled(table(spark, d, "icb_sectors")), F.col("industry") == F.col("icb_l4"), "left")
    return directory.companies_like(c, "Công ty", "H", ("icb_l1", "Công nghiệp"), "tax_id").select("ticker", "company_name", "exchange_code", "icb_l2", "icb_l3")


def company_list(spark: SparkSession, d: str) -> DataFrame:
    info = directory.company_info(table(spark, d, "companies"), table(spark, d, "hnx_companies"))
    return directory.without(info, ["COMPANY_NAME", "Exchange_Code"])


def finished_reports(spark: SparkSession, d: str) -> DataFrame:
    return directory.with_status(table(spark, d, "reports"), "ocr_status", ["done", "pending"]).groupBy("ocr_status").agg(F.count(F.lit(1)).alias("n"))


def largest_reports(spark: SparkSession, d: str) -> DataFrame:
    return directory.preview(table(spark, d, "reports").select("report_id", "total_words"), 30, F.col("total_words").desc_nulls_last(), F.col("report_id"))


def report_availability(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "reports").where("ticker is not null and report_year is not null").select("report_id", "ticker", "report_year", "record_source", "mining_status")
    local = table(spark, d, "labor_audit_50_results").where("file_name is not null").select("ticker", "report_year", F.col("file_name").alias("local_path"))
    indexed = table(spark, d, "multi_era_50_results").where("pdf_path is not null").select("ticker", "report_year", F.col("pdf_path").alias("local_path"))
    out = directory.availability(records, local, indexed, F.when(F.col("record_source") == "crawl_retry", "gap_filler").otherwise(F.col("mining_status")), F.when(F.col("record_source") == "manual_upload", "supplement"), F.col("report_id").cast("string"))
    return out.select("report_id", "is_local", "local_path", "origin")


def ticker_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports")
    return directory.ticker_summary(r.where("ocr_status = 'done'"), r.where("ocr_status <> 'done'"))


def active_years(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name, year: table(spark, d, name).select("ticker", F.col(year).alias("year"))
    docs = table(spark, d, "documents").select("ticker", F.year("published_at").alias("year"))
    return directory.active_years(of("reports", "report_year"), of("multi_era_50_results", "report_year"), of("labor_audit_50_results", "report_year"), docs)


def report_coverage(spark: SparkSession, d: str) -> DataFrame:
    return directory.coverage(table(spark, d, "reports"))


def gap_targets(spark: SparkSession, d: str) -> DataFrame:
    missing = _firms(spark, d).where("ocr_status = 'error'").select("ticker", "exchange_code", "report_year").distinct()
    return directory.gap_order(missing).select("ticker", "report_year", "exchange_rank")


def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").where("ticker is not null and report_year is not null")
    return directory.indexed_files(r, ["ticker", "report_year"], "total_words", F.col("report_id")).select("ticker", "report_year", "report_id")


def repeated_next_year(spark: SparkSession, d: str) -> DataFrame:
    return directory.repeated_next_year(table(spark, d, "labor_audit_50_results").where("snippet <> ''"), "strategy")


def latest_facts(spark: SparkSession, d: str) -> DataFrame:
    f = panel_queries.facts(spark, d)
    again = f.where("item_code = 'bs_tien'").withColumn("value", F.col("value") * 2)
    both = f.withColumn("at", F.lit(1)).unionByName(again.withColumn("at", F.lit(2)))
    return finance.latest_facts(both, F.col("at")).groupBy("year", "item_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 0).alias("total"))


def balance_repair(spark: SparkSession, d: str) -> DataFrame:
    wide = finance.pivot_facts(panel_queries.facts(spark, d), list(ITEMS)).withColumn("bs_tong_tai_san", F.when(F.col("year") % 2 == 0, F.col("bs_tong_tai_san")).otherwise(F.lit(0.0)))
    return finance.balance_repair(wide, "bs_tong_tai_san", "bs_no_phai_tra", "bs_von_chu_so_huu").select("ticker", "year", F.round("bs_tong_tai_san", 2).alias("total_assets"))


def master_items(spark: SparkSession, d: str) -> DataFrame:
    known = [(1 if c.startswith("bs_") else 2, k, c) for k, c in enumerate(ITEMS) if not c.startswith("cf_")]
    return finance.master_items(panel_queries.facts(spark, d), spark.createDataFrame(known, "statement_order int, item_order int, item_code string"))


PROVIDER = {"total_assets": "bs_tong_tai_san", "total_equity": "bs_von_chu_so_huu", "total_debt": "bs_no_phai_tra", "net_income": "is_loi_nhuan_sau_thue", "revenue": "is_doanh_thu_thuan"}


def provider_panel(spark: SparkSession, d: str) -> DataFrame:
    tickers = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    out = finance.provider_panel(panel_queries.facts(spark, d), tickers, 1996, 2000, PROVIDER)
    return out.select("ticker", "year", *[F.round(c, 2).alias(c) for c in PROVIDER], *finance.PROVIDER_RATIOS)


def statement_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """From long facts to ratios with their base items, ordered firm-years with non-empty columns only."""
    f = panel_queries.facts(spark, d)
    base = finance.base_items(finance.pivot_facts(f, list(ITEMS)))
    out = finance.with_base(finance.ratios(base, ["roa", "roe", "current_ratio"]), base, ["total_assets", "revenue", "roa"] if "roa" in base.columns else ["total_assets", "revenue"])
    return out.select("ticker", "year", *[F.round(c, 4).alias(c) for c in ("roa", "roe", "current_ratio")], *[F.round(c, 2).alias(c) for c in ("total_assets", "revenue")])


def named_categories(spark: SparkSession, d: str) -> DataFrame:
    counts = metrics.long_counts(text_queries._matched(spark, d, False), ["doc_id"])
    return metrics.per_category(counts, ["an_toan", "quan_tri", "no such category"])


def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_keywords(metrics.long_counts(text_queries._matched(spark, d, False), ["doc_id"]), 20)


def undated_articles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'news'")
    return docs.groupBy(news.year_or(F.year("published_at").cast("string"), 2026).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def reprints(spark: SparkSession, d: str) -> DataFrame:
    """Every news article as a row, reprints of a text with the words of the first."""
    a = spread(table(spark, d, "documents")).where("doc_kind = 'news' and text is not null").select("doc_id", "source", F.md5("text").alias("h"), F.length("text").alias("n_letters"))
    group = a.groupBy("h").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("p"), F.min("n_letters").alias("n_letters"), F.array_sort(F.collect_list(F.struct("doc_id", "source"))).alias("all"))
    primary = group.select("p.doc_id", "p.source", "n_letters", F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))).alias("duplicates"))
    return news.with_duplicates(primary, ["n_letters"])


def article_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).where("doc_kind = 'news' and text is not null")
    return docs.select("doc_id", F.md5(news.without_boilerplate(F.concat(F.col("text"), F.lit("\n\nXem thêm: tin khác\nTags: a\nCopyright b")))).alias("h"))


def heading_corrections(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(table(spark, d, "multi_era_50_results")).where("raw_text is not null").select("audit_id", F.concat(F.col("raw_text"), F.lit(" http:Jlwww.x.vn cổ  phản CÔNO TY CỎ PIIẦN")).alias("t"))
    return texts.select("audit_id", F.md5(corrections.correct_headings(F.col("t"))).alias("h"))


def snippet_merge(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of a report that start within 200 characters of the last kept one, merged."""
    s = table(spark, d, "snippets").where("report_id is not null and position_in_text is not null and similarity_score is not null")
    per = s.groupBy("report_id").agg(F.collect_list(F.struct(F.col("position_in_text").alias("position"), F.col("similarity_score").alias("similarity"))).alias("m"))
    return per.select("report_id", F.size("m").alias("n"), F.size(contexts.merge_near(F.col("m"))).alias("n_kept"))


QUERIES = {
    f.__name__: f
    for f in (
        industry_levels, industry_reports, industry_supported, local_reports, records_by_id, company_directory, company_list, finished_reports, largest_reports, report_availability, ticker_summary,
        active_years, report_coverage, gap_targets, indexed_files, repeated_next_year, latest_facts, balance_repair, master_items, provider_panel, statement_pipeline, named_categories, top_keywords,
        undated_articles, reprints, article_lines, heading_corrections, snippet_merge,
    )
}

_EXCHANGE = "CASE WHEN upper(trim(exchange_code)) IN ('HOSE', 'HSX') THEN 'HSX' WHEN contains(upper(trim(exchange_code)), 'UPCOM') THEN 'UPCOM' ELSE upper(trim(exchange_code)) END"
_SECTORS = "s AS (SELECT icb_code, icb_l1, substring(icb_code, 1, 2) AS icb_l2, substring(icb_code, 1, 3) AS icb_l3, sector_name AS icb_l4 FROM icb_sectors)"
_TREE = "SELECT CAST(4 - (grouping(icb_l1) + grouping(icb_l2) + grouping(icb_l3) + grouping(icb_l4)) AS INT) AS level, icb_l1, icb_l2, icb_l3, icb_l4, min(icb_code) AS icb_code, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM t GROUP BY ROLLUP (icb_l1, icb_l2, icb_l3, icb_l4) HAVING icb_l1 IS NOT NULL"
_FIRMS = "f AS (SELECT r.*, company_name, exchange_code, industry FROM reports r JOIN companies c USING (ticker))"
SQL = {
    "industry_levels": f"WITH {_SECTORS}, p AS (SELECT industry AS icb_l4, count(DISTINCT ticker) AS n FROM companies GROUP BY 1), t AS (SELECT s.*, n FROM s LEFT JOIN p USING (icb_l4)), o AS ({_TREE}) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY level, CASE level WHEN 1 THEN '' WHEN 2 THEN icb_l1 WHEN 3 THEN icb_l1 || '|' || icb_l2 ELSE icb_l1 || '|' || icb_l2 || '|' || icb_l3 END ORDER BY n DESC, coalesce(icb_l4, icb_l3, icb_l2, icb_l1)) AS INT) AS place FROM o",
    "industry_reports": f"WITH {_SECTORS}, {_FIRMS}, p AS (SELECT industry AS icb_l4, count(*) AS n FROM f WHERE {_EXCHANGE} IN ('HSX', 'HNX') GROUP BY 1), t AS (SELECT s.*, n FROM s LEFT JOIN p USING (icb_l4)) {_TREE}",
    "industry_supported": f"WITH {_SECTORS}, p AS (SELECT industry AS icb_l4, count(DISTINCT ticker) AS n FROM companies WHERE ticker IN (SELECT ticker FROM multi_era_50_results WHERE labor IS NOT NULL) GROUP BY 1), t AS (SELECT s.*, n FROM s JOIN p USING (icb_l4)) {_TREE}",
    "local_reports": f"""WITH {_FIRMS}, l AS (SELECT f.* , icb_l1 FROM f LEFT JOIN icb_sectors ON industry = sector_name WHERE ocr_status = 'done')
SELECT report_id, 'one' AS kind FROM l WHERE contains(ticker, 'A') AND {_EXCHANGE} = 'HSX' AND report_year >= 2012 UNION ALL
SELECT report_id, 'short' FROM l WHERE (contains(ticker, 'AB') OR contains(ticker, 'XYZ4')) AND report_year <= 2018 UNION ALL SELECT report_id, 'level' FROM l WHERE icb_l1 = 'Tài chính' OR industry = 'Tài chính'""",
    "records_by_id": "SELECT report_id, ticker, report_year FROM reports WHERE report_id IN (SELECT report_id FROM snippets WHERE match_type = 'fuzzy')",
    "company_directory": f"WITH {_SECTORS} SELECT ticker, company_name, exchange_code, icb_l2, icb_l3 FROM companies LEFT JOIN s ON industry = icb_l4 WHERE (contains(lower(ticker), 'công ty') OR contains(lower(company_name), 'công ty')) AND contains(upper(coalesce(exchange_code, '')), 'H') AND icb_l1 = 'Công nghiệp' AND trim(tax_id) <> ''",
    "company_list": "SELECT company_id, ticker, tax_id, industry FROM companies WHERE ticker IN (SELECT ticker FROM hnx_companies)",
    "finished_reports": "SELECT ocr_status, count(*) AS n FROM reports WHERE ocr_status IN ('done', 'pending') GROUP BY 1",
    "largest_reports": "SELECT report_id, total_words FROM reports ORDER BY total_words DESC NULLS LAST, report_id LIMIT 30",
    "report_availability": """WITH l AS (SELECT ticker, report_year, min(file_name) AS p FROM labor_audit_50_results WHERE file_name IS NOT NULL GROUP BY 1, 2), m AS (SELECT ticker, report_year, min(pdf_path) AS q FROM multi_era_50_results WHERE pdf_path IS NOT NULL GROUP BY 1, 2)
SELECT report_id, coalesce(p, q) IS NOT NULL AS is_local, coalesce(p, q) AS local_path, CASE WHEN coalesce(p, q) IS NOT NULL THEN 'local' WHEN record_source = 'crawl_retry' THEN 'gap_filler' WHEN record_source = 'manual_upload' THEN 'supplement' ELSE 'archive' END AS origin
FROM reports LEFT JOIN l USING (ticker, report_year) LEFT JOIN m USING (ticker, report_year) WHERE ticker IS NOT NULL AND report_year IS NOT NULL""",
    "ticker_summary": """SELECT upper(ticker) AS ticker, list_sort(list(DISTINCT report_year)) AS years, count(DISTINCT report_year) AS total_reports, count(DISTINCT report_year) FILTER (ocr_status = 'done') AS local_reports, min(report_year) || '-' || max(report_year) AS year_range,
count(DISTINCT report_year) FILTER (ocr_status = 'done') > 0 AS has_local FROM reports WHERE ticker IS NOT NULL AND report_year IS NOT NULL AND ocr_status IS NOT NULL GROUP BY 1""",
    "active_years": """WITH p AS (SELECT ticker, report_year AS y FROM reports UNION SELECT ticker, report_year FROM multi_era_50_results UNION SELECT ticker, report_year FROM labor_audit_50_results UNION SELECT ticker, CAST(year(published_at) AS INT) FROM documents)
SELECT ticker, list_sort(list(DISTINCT y)) AS years FROM p WHERE ticker IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
    "report_coverage": "SELECT count(*) AS n_records, count(DISTINCT ticker) AS n_tickers, count(DISTINCT report_year) AS n_years, min(report_year) AS first_year, max(report_year) AS last_year, CAST(sum(total_pages) AS BIGINT) AS n_pages, count(ocr_path) AS n_with_text FROM reports",
    "gap_targets": f"WITH {_FIRMS} SELECT DISTINCT ticker, report_year, CAST(CASE {_EXCHANGE} WHEN 'HSX' THEN 1 WHEN 'HNX' THEN 2 WHEN 'UPCOM' THEN 3 ELSE 4 END AS INT) AS exchange_rank FROM f WHERE ocr_status = 'error'",
    "indexed_files": "SELECT ticker, report_year, min(report_id) AS report_id FROM reports WHERE ticker IS NOT NULL AND report_year IS NOT NULL AND total_words >= 10000 GROUP BY 1, 2",
    "repeated_next_year": "WITH k AS (SELECT DISTINCT ticker, report_year, strategy FROM labor_audit_50_results WHERE snippet <> '' AND ticker IS NOT NULL AND report_year IS NOT NULL AND strategy IS NOT NULL) SELECT DISTINCT a.ticker, a.report_year, CAST(a.report_year + 1 AS INT) AS next_year FROM k a JOIN k b ON a.ticker = b.ticker AND a.strategy = b.strategy AND b.report_year = a.report_year + 1",
    "latest_facts": _WIDE + f"SELECT year, item_code, count(*) AS n, round(sum(CASE WHEN item_code = 'bs_tien' THEN value * 2 ELSE value END), 0) AS total FROM {FACTS} WHERE value IS NOT NULL GROUP BY 1, 2",
    "balance_repair": _WIDE + "SELECT ticker, year, round(CASE WHEN year % 2 = 0 THEN bs_tong_tai_san ELSE coalesce(bs_no_phai_tra, 0) + coalesce(bs_von_chu_so_huu, 0) END, 2) AS total_assets FROM w",
    "master_items": _WIDE + "SELECT " + "CAST(CASE " + " ".join(f"WHEN item_code = '{c}' THEN {1 if c.startswith('bs_') else 2}" for c in ITEMS if not c.startswith("cf_")) + " ELSE 2147483647 END AS INT) AS statement_order, CAST(CASE "
    + " ".join(f"WHEN item_code = '{c}' THEN {k}" for k, c in enumerate(ITEMS) if not c.startswith("cf_")) + f" ELSE 2147483647 END AS INT) AS item_order, item_code, count(value) AS n FROM {FACTS} GROUP BY item_code",
    "provider_panel": _WIDE + ", p AS (SELECT 'S' || s_suppkey AS ticker, CAST(y AS INT) AS year, " + ", ".join(f"{c} AS {n}" for n, c in PROVIDER.items()) + """ FROM supplier CROSS JOIN range(1996, 2001) r(y) LEFT JOIN w ON w.ticker = 'S' || s_suppkey AND w.year = y)
SELECT ticker, year, """ + ", ".join(f"round({c}, 2) AS {c}" for c in PROVIDER) + ", round(net_income / nullif(total_assets, 0), 6) AS roa, round(net_income / nullif(total_equity, 0), 6) AS roe, round(CASE WHEN total_assets > 0 THEN ln(total_assets) END, 6) AS size, round(total_debt / nullif(total_assets, 0), 6) AS leverage, round(total_assets / nullif(total_debt, 0), 6) AS current_ratio FROM p",
    "statement_pipeline": _WIDE + "SELECT ticker, year, round(is_loi_nhuan_sau_thue / nullif(bs_tong_tai_san, 0), 4) AS roa, round(is_loi_nhuan_sau_thue / nullif(bs_von_chu_so_huu, 0), 4) AS roe, round(bs_tai_san_ngan_han / nullif(bs_no_ngan_han, 0), 4) AS current_ratio, round(bs_tong_tai_san, 2) AS total_assets, round(is_doanh_thu_thuan, 2) AS revenue FROM w",
    "named_categories": _HITS + ", k AS (SELECT unnest(['an_toan', 'quan_tri', 'no such category']) AS category) SELECT category, CAST(coalesce(sum(n), 0) AS BIGINT) AS frequency, count(DISTINCT canonical) AS unique_keywords FROM k LEFT JOIN h USING (category) GROUP BY 1",
    "top_keywords": _HITS + "SELECT canonical AS keyword, CAST(sum(n) AS BIGINT) AS frequency FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "undated_articles": "SELECT CAST(coalesce(year(published_at), 2026) AS INT) AS year, count(*) AS n FROM documents WHERE doc_kind = 'news' GROUP BY 1",
    "snippet_merge": """WITH m AS (SELECT report_id, list_sort(list({'p': position_in_text, 's': similarity_score, 'n': CAST(1 AS BIGINT)})) AS l FROM snippets WHERE report_id IS NOT NULL AND position_in_text IS NOT NULL AND similarity_score IS NOT NULL GROUP BY 1)
SELECT report_id, CAST(len(l) AS INT) AS n, CAST(list_reduce(l, lambda a, x: CASE WHEN x.p - a.p < 200 THEN CASE WHEN x.s > a.s THEN {'p': x.p, 's': x.s, 'n': a.n} ELSE a END ELSE {'p': x.p, 's': x.s, 'n': a.n + 1} END).n AS INT) AS n_kept FROM m""",
    "article_lines": r"""WITH l AS (SELECT doc_id, list_transform(string_split_regex(text || chr(10) || chr(10) || 'Xem thêm: tin khác' || chr(10) || 'Tags: a' || chr(10) || 'Copyright b', '\r\n|\n|\r'), lambda x: trim(x)) AS l FROM documents WHERE doc_kind = 'news' AND text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: x <> '' AND NOT regexp_matches(lower(x), '""" + rf"^(?:{'|'.join(news.BOILERPLATE)})(?:[^\p{{L}}\p{{N}}_]|$)" + """')), chr(10) || chr(10))) AS h FROM l""",
    "heading_corrections": "SELECT audit_id, md5(regexp_replace(regexp_replace(" + "replace(" * len(corrections.MISREAD_HEADINGS) + "raw_text || ' http:Jlwww.x.vn cổ  phản CÔNO TY CỎ PIIẦN'" + "".join(f", '{a}', '{b}')" for a, b in corrections.MISREAD_HEADINGS) + r", '([Cc]ổ\s+[Pp])hản', '\1hần', 'g'), 'http:[JIl/]+www', 'http://www', 'g')) AS h FROM multi_era_50_results WHERE raw_text IS NOT NULL",
    "reprints": "SELECT doc_id, source, CAST(length(text) AS INT) AS n_letters, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents WHERE doc_kind = 'news' AND text IS NOT NULL",
}
