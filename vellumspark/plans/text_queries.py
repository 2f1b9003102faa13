"""Queries of dictionary mining over documents, and their SQL.

The queries search every form of the dictionary, variants included.  Those in ``WITH_SQL`` are also registered under the
name that their SQL fixes, over the canonical keywords alone, as that SQL does not unpack the variants; the query of the
whole dictionary has the suffix ``_all_forms``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contexts, dictionary, matching, metrics
from ..session import spread, table





def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """The keyword contexts as documents: the corpus in which the dictionary's terms occur."""
    return spread(table(spark, d, "snippets").select("snippet_id", "match_type", "report_id", "created_at", "context_text")).select(F.col("snippet_id").alias("doc_id"), F.col("match_type").alias("source"), "report_id", F.col("created_at").alias("published_at"), F.col("context_text").alias("text"))


def _forms(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    return dictionary.forms(dictionary.from_table(table(spark, d, "keywords")), include_variants=variants)


def _matched(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    return matching.search(_passages(spark, d), "text", _forms(spark, d, variants))


def keyword_panel(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    """Flagship: matches of the dictionary in whole texts, by source and category; of its canonical keywords alone without ``variants``."""
    m = _matched(spark, d, variants).select("source", "doc_id", F.explode("matches").alias("m"))
    return m.groupBy("source", F.col("m.category").alias("category")).agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("m.keyword_canonical").alias("unique_keywords"))


def keyword_counts(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    return metrics.long_counts(_matched(spark, d, variants).where("report_id is not null and published_at is not null").withColumn("year", F.year("published_at")), ["report_id", "year"])


def core_variables(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    return metrics.core_variables(_matched(spark, d, variants), ["doc_id"], F.coalesce(tx.word_count(F.col("text")), F.lit(0)))


def category_columns(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    counts = metrics.long_counts(_matched(spark, d, variants), ["doc_id"])
    return metrics.category_frequencies(counts, ["doc_id"], ["an_toan", "chuoi_cung_ung", "cong_nghe", "moi_truong", "quan_tri", "tai_chinh_so"], "topic")


def category_scores(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    docs = _matched(spark, d, variants)
    totals = docs.select("doc_id", F.coalesce(tx.word_count(F.col("text")), F.lit(0)).alias("Word_Count"))
    return metrics.normalised_scores(metrics.long_counts(docs, ["doc_id"]), totals, ["doc_id"])


def match_summary(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    return metrics.summary(metrics.long_counts(_matched(spark, d, variants), ["doc_id"]))


def match_spans(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).select("doc_id", F.explode("matches").alias("m"))
    return m.select("doc_id", "m.keyword_found", "m.keyword_canonical", "m.category", "m.position", "m.end_position")


def match_contexts(spark: SparkSession, d: str) -> DataFrame:
    return contexts.context_rows(_matched(spark, d).withColumn("text", tx.tone_normal(F.col("text"))), "doc_id", "text")


def char_snippets(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).select("doc_id", tx.tone_normal(F.col("text")).alias("t"), F.explode("matches").alias("m"))
    return m.select("doc_id", F.col("m.position").alias("position"), tx.snippet(F.col("t"), F.col("m.position"), F.col("m.end_position") - F.col("m.position"), 70).alias("snippet"))


def fuzzy_keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = _passages(spark, d).where("text is not null")
    return matching.fuzzy_matches(docs, "doc_id", "text", _forms(spark, d))


def search_spans(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches and near misses of the whole dictionary together, with positions, overlaps resolved."""
    m = matching.search(_passages(spark, d), "text", _forms(spark, d), fuzzy=True).select("doc_id", F.explode("matches").alias("m"))
    return m.select("doc_id", "m.keyword_found", "m.keyword_canonical", "m.category", "m.position", "m.end_position", "m.match_type", "m.similarity", "m.levenshtein_distance")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(contexts.sentences(F.col("text"))).alias("n_sentences"))


def variables(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    spec = [
        {"name": "ai_freq", "type": "frequency"}, {"name": "ai_div", "type": "diversity"}, {"name": "safe_score", "type": "normalized_score", "categories": ["an_toan"]},
        {"name": "invests", "type": "classification", "triggers": ["đầu tư", "invest"], "text": "text"}, {"name": "long_text", "type": "custom", "formula": "length(text) > 1000"},
    ]
    return metrics.build_variables(_matched(spark, d, variants).where("text is not null"), ["doc_id"], spec, tx.word_count(F.col("text")))


def rule_labels(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    rules = spark.createDataFrame([("plan", 0, "mục tiêu"), ("plan", 0, "target"), ("risk", 1, "rủi ro"), ("risk", 1, "risk"), ("act", 2, "hoàn tất"), ("act", 2, "completed")], "rule string, rule_order int, trigger string")
    return metrics.classify_by_rules(_matched(spark, d, variants).where("text is not null"), "doc_id", "text", rules)


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


def plain_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("company_id", tx.strip_accents(F.lower("company_name")).alias("plain"))


def tone_places(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(tx.tone_normal(tx.nfc("text"))).alias("h"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "reports").where("pdf_path is not null").select("report_id", tx.parse_filename(F.col("pdf_path")).alias("p"))
    return p.select("report_id", "p.ticker", "p.year")


def dictionary_forms(spark: SparkSession, d: str, variants: bool = True) -> DataFrame:
    return _forms(spark, d, variants)


def dictionary_stats(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.stats(dictionary.from_table(table(spark, d, "keywords"))).where("level in (1, 3)").select("category", "n_keywords", "n_ambiguous")


def dictionary_merge(spark: SparkSession, d: str) -> DataFrame:
    k = dictionary.from_table(table(spark, d, "keywords"))
    again = k.select((F.col("seq") + 10_000).alias("seq"), "category", F.upper("keyword").alias("keyword"), "variants", "lang", (F.col("weight") + 1).alias("weight"), "is_ambiguous")
    return dictionary.merge(k, again).select("seq", "keyword", "category", "weight", F.size("variants").alias("n_variants"))


def fingerprint_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("text is not null").select("doc_id", tx.file_fingerprint(F.col("text")).alias("fp"))
    return docs.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1").select("first_doc", "n")


#: Queries whose SQL searches the canonical keywords only.
WITH_SQL = {
    "keyword_panel": keyword_panel, "keyword_counts": keyword_counts, "core_variables": core_variables, "category_columns": category_columns, "category_scores": category_scores,
    "match_summary": match_summary, "build_variables": variables, "rule_labels": rule_labels, "dictionary_forms": dictionary_forms,
}
QUERIES = {name: partial(query, variants=False) for name, query in WITH_SQL.items()} | {f"{name}_all_forms": query for name, query in WITH_SQL.items()} | {
    "match_spans": match_spans, "match_contexts": match_contexts, "char_snippets": char_snippets, "fuzzy_keywords": fuzzy_keywords, "search_spans": search_spans, "sentence_counts": sentence_counts,
    "word_counts": word_counts, "strip_accents": plain_letters, "tone_places": tone_places, "parse_filename": file_names,
    "dictionary_stats": dictionary_stats, "dictionary_merge": dictionary_merge, "fingerprint_groups": fingerprint_groups,
}


def _tone_sql(c: str) -> str:
    for a, b in tx.TONE_PAIRS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


# Words parted by two blanks and other signs by '¦': ' kw ' then counts whole phrases whose words only blanks part.
_PADDED = rf"' ' || regexp_replace(regexp_replace(lower({_tone_sql('text')}), '[^\p{{L}}\p{{N}}_\-\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ' ¦ ', 'g'), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', '  ', 'g') || ' '"
_HITS = rf"""
WITH c AS (SELECT snippet_id AS doc_id, match_type AS source, report_id, created_at AS published_at, context_text AS text FROM snippets),
d AS (SELECT doc_id, source, report_id, published_at, text, {_PADDED} AS t FROM c WHERE text IS NOT NULL),
f AS (SELECT lower({_tone_sql("trim(keyword)")}) AS form, arg_max(keyword, keyword_id) AS canonical, arg_max(category, keyword_id) AS category FROM keywords
      WHERE lower(trim(keyword)) NOT IN ('phân quyền', 'phan quyen', 'phân cấp', 'together') GROUP BY 1),
p AS (SELECT form, canonical, category, ' ' || replace(form, ' ', '  ') || ' ' AS q0 FROM f),
q AS (SELECT form, canonical, category, ' ' || regexp_replace(trim(q0), '\s+', '  ', 'g') || ' ' AS q FROM p),
h AS (SELECT doc_id, source, report_id, published_at, canonical, category, (length(t) - length(replace(t, q, ''))) / length(q) AS n
      FROM d JOIN q ON contains(t, q))
"""
_WORDS = r"len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> ''))"
# A full stop behind a figure or an abbreviation is hidden ('¤'; twice, as neighbours share a blank), the other ends are marked.
_ABBREVIATED = rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(contexts.ABBREVIATIONS)})\.([\s\p{{Z}}\x0b\x85])"
_HIDDEN = rf"regexp_replace(regexp_replace(regexp_replace(text, '(\d)\.([\s\p{{Z}}\x0b\x85])', '\1¤\2', 'g'), '{_ABBREVIATED}', '\1\2¤\3', 'gi'), '{_ABBREVIATED}', '\1\2¤\3', 'gi')"
SQL = {
    "sentence_counts": rf"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace({_HIDDEN}, '([.!?][\s\p{{Z}}\x0b\x85]|\n[\s\p{{Z}}\x0b\x85]*\n)', '\1' || chr(57344), 'g'), chr(57344)), lambda x: regexp_matches(x, '[^\s\p{{Z}}\x0b\x85]'))) AS INT) AS n_sentences FROM documents WHERE text IS NOT NULL",
    "keyword_panel": _HITS + "SELECT source, category, CAST(sum(n) AS BIGINT) AS frequency, count(DISTINCT doc_id) AS documents, count(DISTINCT canonical) AS unique_keywords FROM h GROUP BY 1, 2",
    "keyword_counts": _HITS + "SELECT report_id, CAST(year(published_at) AS INT) AS year, category, canonical AS keyword, CAST(sum(n) AS BIGINT) AS frequency FROM h WHERE report_id IS NOT NULL AND published_at IS NOT NULL GROUP BY 1, 2, 3, 4",
    "core_variables": _HITS + f""", s AS (SELECT doc_id, CAST(sum(n) AS INT) AS n, CAST(count(DISTINCT canonical) AS INT) AS u FROM h GROUP BY 1),
w AS (SELECT doc_id, coalesce({_WORDS}, 0) AS wc FROM c)
SELECT w.doc_id, CAST(wc AS INT) AS "Word_Count", coalesce(n, 0) AS "Frequency", round(ln(1 + coalesce(n, 0)), 6) AS "Log_Frequency", CASE WHEN n > 0 THEN 1 ELSE 0 END AS "Mention",
CASE WHEN wc > 0 THEN round(coalesce(n, 0) / wc * 100, 4) ELSE 0.0 END AS "Density", coalesce(u, 0) AS "Unique_Keywords" FROM w LEFT JOIN s USING (doc_id)""",
    "category_columns": _HITS + "SELECT doc_id, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (category = '{c}'), 0) AS BIGINT) AS \"{c}_Freq\"" for c in ("an_toan", "chuoi_cung_ung", "cong_nghe", "moi_truong", "quan_tri", "tai_chinh_so")) + " FROM h GROUP BY 1",
    "category_scores": _HITS + f""", w AS (SELECT doc_id, {_WORDS} AS wc FROM c WHERE text IS NOT NULL)
SELECT doc_id, category, CAST(sum(n) AS BIGINT) AS frequency, count(DISTINCT canonical) AS diversity, round(sum(n) / any_value(wc) * 10000, 6) AS normalized_score FROM h JOIN w USING (doc_id) GROUP BY 1, 2""",
    "match_summary": _HITS + "SELECT CAST(sum(n) AS BIGINT) AS total, count(DISTINCT canonical) AS unique_keywords, count(DISTINCT category) AS categories FROM h",
    "parse_filename": r"""WITH f AS (SELECT report_id, upper(regexp_replace(regexp_extract(replace(pdf_path, '\', '/'), '([^/]*)$', 1), '(?i)\.(?:pdf|txt|docx?)$', '')) AS s FROM reports WHERE pdf_path IS NOT NULL),
g AS (SELECT report_id, regexp_extract(s, '^([A-Z][A-Z0-9]{2,5})[ _-]+((?:19|20)\d\d)(?:\D|$)', 1) AS t1, regexp_extract(s, '^([A-Z][A-Z0-9]{2,5})[ _-]+((?:19|20)\d\d)(?:\D|$)', 2) AS y1,
regexp_extract(s, '(?:^|[^0-9A-Z])((?:19|20)\d\d)[ _-]+(?:[A-Z]+[ _-]+)*?([A-Z][A-Z0-9]{2,5})$', 2) AS t2, regexp_extract(s, '(?:^|[^0-9A-Z])((?:19|20)\d\d)[ _-]+(?:[A-Z]+[ _-]+)*?([A-Z][A-Z0-9]{2,5})$', 1) AS y2,
regexp_extract(s, '^([A-Z][A-Z0-9]{2,5})[ _-]+(\d\d)(?:[ _-]|$)', 1) AS t3, regexp_extract(s, '^([A-Z][A-Z0-9]{2,5})[ _-]+(\d\d)(?:[ _-]|$)', 2) AS y3 FROM f)
SELECT report_id, coalesce(nullif(t1, ''), nullif(t2, ''), nullif(t3, '')) AS ticker, CAST(coalesce(CAST(nullif(y1, '') AS INT), CAST(nullif(y2, '') AS INT), CASE WHEN CAST(nullif(y3, '') AS INT) < 50 THEN 2000 + CAST(nullif(y3, '') AS INT) ELSE 1900 + CAST(nullif(y3, '') AS INT) END) AS INT) AS year FROM g""",
    "build_variables": _HITS + r""", s AS (SELECT doc_id, sum(n) AS n, count(DISTINCT canonical) AS u, coalesce(sum(n) FILTER (category = 'an_toan'), 0) AS a FROM h GROUP BY 1), w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS wc FROM c WHERE text IS NOT NULL)
SELECT w.doc_id, CAST(coalesce(n, 0) AS DOUBLE) AS ai_freq, CAST(coalesce(u, 0) AS DOUBLE) AS ai_div, CASE WHEN wc > 0 THEN round(coalesce(a, 0) / wc * 10000, 6) ELSE 0.0 END AS safe_score,
CASE WHEN contains(lower(text), 'đầu tư') OR contains(lower(text), 'invest') THEN 1.0::DOUBLE ELSE 0.0 END AS invests, CASE WHEN length(text) > 1000 THEN 1.0::DOUBLE ELSE 0.0 END AS long_text FROM w LEFT JOIN s USING (doc_id)""",
    "rule_labels": _HITS + r""", s AS (SELECT doc_id, sum(n) AS n FROM h GROUP BY 1), t AS (SELECT doc_id, lower(text) AS t FROM c WHERE text IS NOT NULL),
r AS (SELECT t.doc_id, coalesce(n, 0) AS n, CAST(contains(t, 'mục tiêu') AS INT) + CAST(contains(t, 'target') AS INT) AS p, CAST(contains(t, 'rủi ro') AS INT) + CAST(contains(t, 'risk') AS INT) AS k, CAST(contains(t, 'hoàn tất') AS INT) + CAST(contains(t, 'completed') AS INT) AS a FROM t LEFT JOIN s USING (doc_id))
SELECT doc_id, CASE WHEN n = 0 THEN 'none' WHEN greatest(p, k, a) = 0 THEN 'talk' WHEN p = greatest(p, k, a) THEN 'plan' WHEN k = greatest(p, k, a) THEN 'risk' ELSE 'act' END AS label, greatest(p, k, a) AS n_triggers,
CASE WHEN greatest(p, k, a) > 0 THEN round(least(1.0, greatest(p, k, a) / 3), 2) ELSE 0.5 END AS confidence FROM r""",
    "word_counts": f"SELECT doc_id, CAST({_WORDS} AS INT) AS n_words FROM documents WHERE text IS NOT NULL",
    "strip_accents": "SELECT company_id, replace(strip_accents(lower(company_name)), 'đ', 'd') AS plain FROM companies",
    "tone_places": f"SELECT doc_id, md5({_tone_sql('nfc_normalize(text)')}) AS h FROM documents WHERE text IS NOT NULL",
    "dictionary_forms": """SELECT lower(trim(keyword)) AS form, arg_max(keyword, keyword_id) AS canonical, arg_max(category, keyword_id) AS category FROM keywords
WHERE lower(trim(keyword)) NOT IN ('phân quyền', 'phan quyen', 'phân cấp', 'together') GROUP BY 1""",
    "dictionary_stats": "SELECT category, count(*) AS n_keywords, count(*) FILTER (is_ambiguous) AS n_ambiguous FROM keywords GROUP BY ROLLUP (category)",
    "fingerprint_groups": "SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(left(text, 8192) || right(text, 8192) || CAST(length(text) AS VARCHAR)) HAVING count(*) > 1",
}
