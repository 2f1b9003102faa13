"""Best representative of each duplicate group (problem 4).

Rows of ``reports`` are grouped by the firm they mean and the report year.
Fields that depend on each other form bundles (the file: pdf_path, ocr_path,
total_pages, is_scanned; the firm: ticker, company_id; the content: total_words
and the states), and one survivor takes whole bundles.  The choice maximises
trust under functional dependencies (firm determines company_id; the path of the
chosen file must name the chosen firm and year; file and content agree on
is_scanned) by branch and bound.

Candidates are pre-aggregated per (group, bundle, signature): the constraints
see only a bundle's signature, a handful of flags (``is_scanned`` among those of
file and content, which must agree), so a group reaches the
search as at most ``MAX_SIGNATURES`` candidates per bundle, however many rows it
has: the signatures are so many by construction.  No group is ever collected whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Firms up to this number are broadcast with their companies; more are joined by a shuffle.
BROADCAST_FIRMS = 200_000
#: Signatures of a bundle at most: the file's four flags and its is_scanned (true, false, null).
MAX_SIGNATURES = 48
#: Full-width capitals, digits and signs and their ASCII forms.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: Look-alike Cyrillic and Greek capitals and their Latin forms.
_LOOK = "АВЕКМНОРСТУХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_LATIN = "ABEKMHOPCTYXISJABEZHIKMNOPTYX"
_STOP = ("SCAN", "BCTN", "DATA", "FILE", "BAOCAO", "INCOMING", "ARCHIVE", "REPORTS")


def plain_ticker(ticker: Column) -> Column:
    """The firm code meant by a ticker, however written; null for none.

    Width and look-alike letters are folded, blanks and invisible signs dropped, then an exchange
    prefix (``HSX:``), a market suffix (``.VN``) and a year suffix (``-2018``) go.
    """
    t = F.translate(ticker, _WIDE, _NARROW)
    t = F.upper(F.regexp_replace(t, r"(?U)[\s\p{Cf}]+", ""))
    t = F.translate(t, _LOOK, _LATIN)
    t = F.regexp_replace(t, r"^(?:HSX|HOSE|HNX|UPCOM|UPC|OTC)[:._/-]", "")
    t = F.regexp_replace(t, r"[._:](?:VN|HM|HN|HO|HNX|HSX|UPCOM|UP|HOSE)$", "")
    t = F.regexp_replace(t, r"[-_./](?:19|20)\d\d$", "")
    t = F.regexp_replace(t, r"[^A-Z0-9]", "")
    return F.when(t != "", t)


def ticker_of_path(path: Column, known: Column | None = None) -> Column:
    """The firm code named in a path, or null: the code beside the year in the file name, else the folder's."""
    p = F.upper(F.replace(F.translate(path, _WIDE, _NARROW), F.lit("\\"), F.lit("/")))
    p = F.regexp_replace(p, "%20", " ")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[A-Z0-9]+$", "")
    stem = F.regexp_replace(stem, r"(?:BAO CAO THUONG NIEN|BCTN|ANNUAL REPORT|SCAN|_V\d+|\(\d+\))", " ")
    stem = F.regexp_replace(stem, r"(?<!\d)(?:19|20)\d\d(?![0-9A-Z])", " ")
    code = F.regexp_extract(stem, r"(?<![A-Z0-9])([A-Z][A-Z0-9]{2,5})(?![A-Z0-9])", 1)
    folder = F.regexp_extract(p, r"/([A-Z][A-Z0-9]{2,4})/[^/]*$", 1)
    ok = lambda c: F.when((c != "") & ~c.isin(*_STOP), c)
    return F.coalesce(ok(code), ok(folder))


def year_of_path(path: Column) -> Column:
    """The last year named in a path, or null."""
    p = F.regexp_replace(path, "%20", " ")
    return F.try_element_at(
        F.transform(F.regexp_extract_all(p, F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)"), 1), lambda y: y.cast("int")), F.lit(-1)
    )


def firm_years(reports: DataFrame) -> DataFrame:
    """``reports`` with ``firm``, ``path_firm``, ``path_year``.

    A row whose ticker and path name no firm has a null firm and stands for itself; so does a row without year.
    """
    firm = F.coalesce(plain_ticker(F.col("ticker")), ticker_of_path(F.col("pdf_path")))
    return reports.select(
        "*",
        firm.alias("firm"),
        ticker_of_path(F.col("pdf_path")).alias("path_firm"),
        year_of_path(F.col("pdf_path")).alias("path_year"),
    )


def duplicate_pairs(reports: DataFrame) -> DataFrame:
    """Every pair of rows of one firm and year: the form that the found query fixes.

    Only ids and keys are shuffled; a hot firm-year is split by the join's skew handling and each row
    is met by its partners as a stream, never as a collected list.
    """
    rows = firm_years(reports.select("report_id", "ticker", "report_year", "pdf_path")).where(
        F.col("firm").isNotNull() & F.col("report_year").isNotNull() & F.col("report_id").isNotNull()
    )
    a = rows.select("firm", "report_year", F.col("report_id").alias("report_id_a"))
    b = rows.select("firm", "report_year", F.col("report_id").alias("report_id_b"))
    return (
        a.join(b.hint("merge"), ["firm", "report_year"])
        .where(F.col("report_id_a") < F.col("report_id_b"))
        .select("report_id_a", "report_id_b")
        .distinct()
    )


def _best(order: tuple[Column, ...], *fields: str) -> Column:
    """The fields of the row that leads by ``order`` (a max over a struct: combined on the map side)."""
    return F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(f) for f in fields]))


def _search(firm: list[dict], file: list[dict], content: list[dict]) -> tuple[int, int, int]:
    """Indexes of the chosen candidates: branch and bound over firm x file x content.

    Lists are sorted by weight, falling; a branch is cut when its weight plus the best that the rest can
    add does not exceed the best full choice.  Feasible choices beat infeasible ones; ties fall to the earlier.
    """
    best, found = (-1e18, 0, 0, 0), False
    top_file = file[0]["w"] if file else 0.0
    top_content = content[0]["w"] if content else 0.0
    for i, a in enumerate(firm):
        if found and a["w"] + top_file + top_content <= best[0]:
            break
        if not a["company_ok"]:
            continue
        for j, b in enumerate(file):
            if found and a["w"] + b["w"] + top_content <= best[0]:
                break
            if not (b["firm_ok"] and b["year_ok"]):
                continue
            for k, c in enumerate(content):
                total = a["w"] + b["w"] + c["w"]
                if found and total <= best[0]:
                    break
                if c["scanned"] is not None and b["scanned"] is not None and c["scanned"] != b["scanned"]:
                    continue
                best, found = (total, i, j, k), True
                break
    return best[1:]


def companies(rows: DataFrame) -> DataFrame:
    """``(firm, __company)``: the company that a firm determines, by all its rows' trust; ties fall to the lower id.

    Trusts are summed by firm and company before they are compared, so a hot firm reaches one task as a few sums.
    """
    # Millionths of trust, so that the sums don't depend on the order of the rows.
    sums = rows.where("firm is not null and company_id is not null").groupBy("firm", "company_id").agg(F.sum(F.round(F.col("__trust") * 1_000_000).cast("long")).alias("t"))
    best = sums.groupBy("firm").agg(F.max(F.struct("t", (-F.col("company_id")).alias("c"))).alias("m"))
    return best.select("firm", (-F.col("m.c")).alias("__company"))


def survivors(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """One surviving row per firm and year.

    Columns: firm, report_year, n_rows, ticker, company_id, pdf_path, ocr_path, total_pages, is_scanned,
    total_words, ocr_status, mining_status, file_report_id, updated_at.  Rows that name no firm or no year
    survive as themselves (firm null).  A bundle whose company_id contradicts the firm's loses to any that doesn't; a
    missing company_id is the firm's.  Ties fall to the later updated_at, then the lower report_id.  Extra
    columns are left aside; a record_source absent from ``sources`` ranks last; empty input gives an empty result.
    """
    trust = sources.where("trust_rank is not null").groupBy(F.col("source").alias("record_source")).agg(F.min("trust_rank").alias("__rank"))
    fields = ["report_id", "company_id", "ticker", "report_year", "pdf_path", "ocr_path", "total_pages", "total_words", "is_scanned", "ocr_status", "mining_status", "record_source", "updated_at"]
    rows = firm_years(reports.select(*fields)).join(trust, "record_source", "left")
    rows = rows.withColumn("__trust", 1.0 / (1.0 + F.coalesce(F.col("__rank"), F.lit(99))))
    known = cut_lineage(companies(rows))
    rows = rows.join(F.broadcast(known) if known.count() <= BROADCAST_FIRMS else known, "firm", "left")
    lone = F.col("firm").isNull() | F.col("report_year").isNull()
    rows = rows.select(
        "*",
        F.when(lone, F.concat(F.lit("#"), F.col("report_id").cast("string"))).otherwise(F.concat_ws("|", "firm", F.col("report_year").cast("string"))).alias("gid"),
        F.coalesce(F.col("company_id") == F.col("__company"), F.lit(True)).alias("company_ok"),
        (plain_ticker(F.col("ticker")) == F.col("ticker")).alias("__clean"),
        (F.col("path_firm").isNotNull()).alias("__named"),
        F.coalesce(F.col("path_firm") == F.col("firm"), F.lit(True)).alias("firm_ok"),
        F.coalesce(F.col("path_year") == F.col("report_year"), F.lit(True)).alias("year_ok"),
        (F.col("total_pages") > 0).alias("__paged"),
        F.coalesce(F.unix_micros("updated_at"), F.lit(-1)).alias("__at"),
    )
    none_false = lambda c: F.coalesce(F.col(c), F.lit(False))
    # Signatures: what the constraints and the completeness of a bundle depend on.
    rows = rows.select(
        "*",
        (none_false("__clean").cast("int") + 2 * F.col("company_id").isNotNull().cast("int") + 4 * F.col("company_ok").cast("int")).alias("__sf"),
        (F.col("firm_ok").cast("int") + 2 * F.col("year_ok").cast("int") + 4 * none_false("__paged").cast("int") + 8 * F.col("pdf_path").isNotNull().cast("int") + 16 * F.coalesce(F.col("is_scanned").cast("int"), F.lit(2))).alias("__sp"),
        (F.coalesce(F.col("is_scanned").cast("int"), F.lit(2)) + 3 * F.col("total_words").isNotNull().cast("int")).alias("__sc"),
    )
    wf = F.col("__trust") + none_false("__clean").cast("int") * 2 + F.col("company_id").isNotNull().cast("int") * 0.5
    wp = F.col("__trust") * 2 + none_false("__paged").cast("int") * 2 + F.col("pdf_path").isNotNull().cast("int") * 2 + none_false("__named").cast("int")
    wc = F.col("__trust") + F.col("total_words").isNotNull().cast("int")
    rows = rows.select("*", wf.alias("wf"), wp.alias("wp"), wc.alias("wc"))
    late = (F.col("__at"), -F.col("report_id"))
    # One row per (group, kind, signature): three kinds from each input row, combined before the shuffle.
    kinds = rows.select(
        "gid", "firm", "report_year", "report_id", "updated_at", "firm_ok", "year_ok", "company_ok", "__company", "wf", "wp", "wc", "__at", "ticker", "company_id",
        "pdf_path", "ocr_path", "total_pages", "is_scanned", "total_words", "ocr_status", "mining_status",
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("__sf").alias("sig")), F.struct(F.lit(1).alias("kind"), F.col("__sp").alias("sig")), F.struct(F.lit(2).alias("kind"), F.col("__sc").alias("sig")))).alias("ks"),
    )
    weight = F.when(F.col("ks.kind") == 0, F.col("wf")).when(F.col("ks.kind") == 1, F.col("wp")).otherwise(F.col("wc"))
    keep = ["firm_ok", "year_ok", "company_ok", "__company", "ticker", "company_id", "pdf_path", "ocr_path", "total_pages", "is_scanned", "total_words", "ocr_status", "mining_status", "report_id"]
    best = kinds.groupBy("gid", "firm", "report_year", "ks").agg(
        _best((weight, *late), *keep).alias("c"), F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("at")
    )
    # At most MAX_SIGNATURES candidates of each kind remain in a group.
    listed = best.groupBy("gid", "firm", "report_year").agg(
        F.sum(F.when(F.col("ks.kind") == 0, F.col("n"))).alias("n_rows"),
        F.max("at").alias("updated_at"),
        *[F.sort_array(F.collect_list(F.when(F.col("ks.kind") == k, F.col("c"))), asc=False).alias(f"c{k}") for k in (0, 1, 2)],
    )
    light = lambda c: F.transform(F.col(c), lambda x: F.struct(x["o0"].alias("w"), x["firm_ok"].alias("firm_ok"), x["year_ok"].alias("year_ok"), x["company_ok"].alias("company_ok"), x["is_scanned"].alias("scanned")))
    listed = listed.select("*", light("c0").alias("firms"), light("c1").alias("files"), light("c2").alias("contents"))
    pick = F.pandas_udf(
        lambda a, b, c: pd.DataFrame([_search(list(x), list(y), list(z)) for x, y, z in zip(a, b, c, strict=True)], columns=["i", "j", "k"]).astype("int32"),
        "i int, j int, k int",
    )
    chosen = listed.select("firm", "report_year", "n_rows", "updated_at", "c0", "c1", "c2", pick("firms", "files", "contents").alias("p"))
    a, b, c = F.get("c0", F.col("p.i")), F.get("c1", F.col("p.j")), F.get("c2", F.col("p.k"))
    return chosen.select(
        "firm", "report_year", "n_rows",
        F.coalesce(plain_ticker(a["ticker"]), F.col("firm")).alias("ticker"), F.coalesce(a["company_id"], a["__company"]).alias("company_id"),
        b["pdf_path"].alias("pdf_path"), b["ocr_path"].alias("ocr_path"), b["total_pages"].alias("total_pages"), b["is_scanned"].alias("is_scanned"),
        c["total_words"].alias("total_words"), c["ocr_status"].alias("ocr_status"), c["mining_status"].alias("mining_status"),
        b["report_id"].alias("file_report_id"), "updated_at",
    )
