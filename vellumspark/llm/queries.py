"""Queries of the llm operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import chars, encoding, leakage, packing, scanned, survivors, truncation

Query = Callable[[SparkSession, str], DataFrame]
RAW, SNIPPET, CONTEXT, KEYWORD = "multi_era_50_results.raw_text", "labor_audit_50_results.snippet", "snippets.context_text", "snippets.keyword_found"



def _scanned(spark: SparkSession, d: str, only_found: bool) -> DataFrame:
    raw, labor, snippets = table(spark, d, "multi_era_50_results"), table(spark, d, "labor_audit_50_results"), table(spark, d, "snippets")
    know = scanned.learn(raw.select("raw_text"), labor.select("snippet"), snippets.select("context_text"))
    return (
        scanned.continuous(raw, "audit_id", {"raw_text": RAW}, know, only_found)
        .unionAll(scanned.continuous(labor, "row_index", {"snippet": SNIPPET}, know, only_found))
        .unionAll(scanned.continuous(snippets, "snippet_id", {"context_text": CONTEXT}, know, only_found))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, True).select("field_name", "record_id").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, False)


def _consistent(spark: SparkSession, d: str, only_changed: bool) -> DataFrame:
    snippets, raw = table(spark, d, "snippets"), table(spark, d, "multi_era_50_results")
    return chars.consistent(snippets, "snippet_id", {"keyword_found": KEYWORD, "context_text": CONTEXT}, only_changed).unionAll(
        chars.consistent(raw, "audit_id", {"raw_text": RAW}, only_changed)
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _consistent(spark, d, True).select("field_name", "record_id").distinct()


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    return _consistent(spark, d, False)


def _restored(spark: SparkSession, d: str) -> DataFrame:
    raw, snippets = table(spark, d, "multi_era_50_results"), table(spark, d, "snippets")
    maps = encoding.mapping(raw.select("raw_text"), snippets.select("context_text"))
    return encoding.repaired(raw, "audit_id", {"raw_text": RAW}, maps).unionAll(encoding.repaired(snippets, "snippet_id", {"context_text": CONTEXT}, maps))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("field_name", "record_id").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.duplicate_pairs(table(spark, d, "reports"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "reports"), table(spark, d, "sources"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d), table(spark, d, "pack_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_documents(table(spark, d, "documents")).select("doc_id").distinct()


def p8_share_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.share_by_source(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_consistent": p2_consistent,
        "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_survivors": p4_survivors,
        "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_share_by_source": p8_share_by_source,
    }


_FIRMS = r"""
WITH a AS (SELECT *, upper(regexp_replace(translate(ticker, '{wide}', '{narrow}'), '[\s\p{{Z}}\p{{Cf}}]+', '', 'g')) AS t0 FROM reports),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(translate(t0, '{look}', '{latin}'), '^(?:HSX|HOSE|HNX|UPCOM|UPC|OTC)[:._/-]', ''), '[._:](?:VN|HM|HN|HO|HNX|HSX|UPCOM|UP|HOSE)$', ''), '[-_./](?:19|20)\d\d$', '') AS t1,
 replace(upper(replace(translate(pdf_path, '{wide}', '{narrow}'), '\', '/')), '%20', ' ') AS p FROM a),
c AS (SELECT *, nullif(regexp_replace(t1, '[^A-Z0-9]', '', 'g'), '') AS t, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.[A-Z0-9]+$', '') AS stem, regexp_extract(p, '/([A-Z][A-Z0-9]{{2,4}})/[^/]*$', 1) AS folder FROM b),
d AS (SELECT *, regexp_extract(' ' || regexp_replace(regexp_replace(stem, '(?:BAO CAO THUONG NIEN|BCTN|ANNUAL REPORT|SCAN|_V\d+|\(\d+\))', ' ', 'g'), '(^|[^0-9])(?:19|20)\d\d([^0-9A-Z]|$)', '\1 \2', 'g') || ' ', '[^A-Z0-9]([A-Z][A-Z0-9]{{2,5}})[^A-Z0-9]', 1) AS code FROM c),
e AS (SELECT *, coalesce(CASE WHEN code NOT IN ({stop}) THEN code END, CASE WHEN folder NOT IN ({stop}) THEN folder END) AS path_firm,
 list_filter(regexp_split_to_array(replace(pdf_path, '%20', ' '), '\D+'), lambda x: regexp_matches(x, '^(19|20)\d\d$'))[-1] AS path_year FROM d),
f AS (SELECT *, coalesce(t, path_firm) AS firm FROM e)
"""
_P4 = _FIRMS + "SELECT DISTINCT x.report_id AS report_id_a, y.report_id AS report_id_b FROM f x JOIN f y ON x.firm = y.firm AND x.report_year = y.report_year AND x.report_id < y.report_id"
# Every choice of firm, file and content row of a group is weighed; ties fall to the better placed row of each.
_SURVIVORS = _FIRMS + r"""
, g AS (SELECT f.*, 1.0::DOUBLE / (1.0::DOUBLE + coalesce(s.r, 99)) AS trust FROM f LEFT JOIN (SELECT source, min(trust_rank) AS r FROM sources WHERE trust_rank IS NOT NULL GROUP BY 1) s ON s.source = f.record_source),
m AS (SELECT firm, company_id AS known FROM (SELECT firm, company_id, row_number() OVER (PARTITION BY firm ORDER BY sum(CAST(round(trust * 1000000) AS BIGINT)) DESC, company_id) AS k FROM g WHERE firm IS NOT NULL AND company_id IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
h AS (SELECT g.*, known, CASE WHEN g.firm IS NULL OR report_year IS NULL THEN '#' || report_id ELSE g.firm || '|' || report_year END AS gid,
 coalesce(path_firm = g.firm, TRUE) AND coalesce(CAST(path_year AS INT) = report_year, TRUE) AS file_ok, coalesce(company_id = known, TRUE) AS company_ok,
 trust + CASE WHEN t = ticker THEN 2 ELSE 0 END + CASE WHEN company_id IS NOT NULL THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS wf,
 trust * 2 + CASE WHEN total_pages > 0 THEN 2 ELSE 0 END + CASE WHEN pdf_path IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN path_firm IS NOT NULL THEN 1 ELSE 0 END AS wp,
 trust + CASE WHEN total_words IS NOT NULL THEN 1 ELSE 0 END AS wc FROM g LEFT JOIN m ON m.firm = g.firm),
r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY wf DESC, updated_at DESC NULLS LAST, report_id) AS i, row_number() OVER (PARTITION BY gid ORDER BY wp DESC, updated_at DESC NULLS LAST, report_id) AS j, row_number() OVER (PARTITION BY gid ORDER BY wc DESC, updated_at DESC NULLS LAST, report_id) AS k,
 count(*) OVER (PARTITION BY gid) AS n_rows, max(updated_at) OVER (PARTITION BY gid) AS last_at FROM h),
o AS (SELECT x.gid, x.i, y.j, z.k, row_number() OVER (PARTITION BY x.gid ORDER BY x.wf + y.wp + z.wc DESC, x.i, y.j, z.k) AS place
 FROM r x JOIN r y ON y.gid = x.gid JOIN r z ON z.gid = x.gid WHERE x.company_ok AND y.file_ok AND coalesce(y.is_scanned = z.is_scanned, TRUE)),
w AS (SELECT DISTINCT r.gid, coalesce(o.i, 1) AS i, coalesce(o.j, 1) AS j, coalesce(o.k, 1) AS k FROM r LEFT JOIN o ON o.gid = r.gid AND o.place = 1)
SELECT x.firm, x.report_year, x.n_rows, coalesce(x.t, x.firm) AS ticker, coalesce(x.company_id, x.known) AS company_id, y.pdf_path, y.ocr_path, y.total_pages, y.is_scanned,
 z.total_words, z.ocr_status, z.mining_status, y.report_id AS file_report_id, x.last_at AS updated_at
FROM w JOIN r x ON x.gid = w.gid AND x.i = w.i JOIN r y ON y.gid = w.gid AND y.j = w.j JOIN r z ON z.gid = w.gid AND z.k = w.k"""


def oracle_sql() -> dict[str, str]:
    quote = lambda t: t.replace("'", "''")
    fixed = {"wide": survivors._WIDE, "narrow": quote(survivors._NARROW), "look": survivors._LOOK, "latin": survivors._LATIN, "stop": "'', " + ", ".join(f"'{x}'" for x in survivors._STOP)}
    return {"p4_found": _P4.format(**fixed), "p4_survivors": _SURVIVORS.format(**fixed)}
