"""News articles: extraction, confirmation, near-duplicate clusters, gap-filled panels."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, word_count

# Shares of common parts from which on titles, leads and texts are alike, and the sizes that count.
TITLE_ALIKE, LEAD_ALIKE, TEXT_ALIKE = 0.68, 0.60, 0.28
LEAD_LEAST, TEXT_LEAST, TEXT_USED = 30, 150, 2500


class _Page(HTMLParser):
    """Title, description, paragraphs, captions and date of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.paragraphs, self.captions, self.stack = "", {}, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            a = dict(attrs)
            key = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if key and a.get("content"):
                self.meta.setdefault(key, a["content"].strip())
        elif tag in ("p", "h1", "h2", "title", "figcaption", "script", "style", "li", "nav", "footer"):
            self.stack.append([tag, []])
            self.captions += tag == "figcaption"

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1][0] == tag:
            name, parts = self.stack.pop()
            text = re.sub(r"\s+", " ", "".join(parts)).strip()
            if name == "title" or name == "h1":
                self.title = text if name == "h1" or not self.title else self.title
            elif name in ("p", "h2", "figcaption") and text and not any(t in ("nav", "footer") for t, _ in self.stack):
                self.paragraphs.append(text)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] not in ("script", "style"):
            self.stack[-1][1].append(data)


def extract(html: str | None) -> tuple[str, str, str, str, int, int]:
    """(title, sapo, text, published_date, word_count, captions_count) of a page; empty parts for an empty page."""
    page = _Page()
    if html:
        page.feed(html)
        page.close()
    text = "\n".join(page.paragraphs)
    date = next((page.meta[k] for k in ("article:published_time", "datepublished", "pubdate", "date") if k in page.meta), "")
    return page.meta.get("og:title") or page.title, page.meta.get("og:description") or page.meta.get("description", ""), text, date[:25], len(text.split()), page.captions


ARTICLE = T.StructType([T.StructField(n, t) for n, t in (("title", T.StringType()), ("sapo", T.StringType()), ("text", T.StringType()), ("published_date", T.StringType()), ("word_count", T.IntegerType()), ("captions_count", T.IntegerType()))])


@F.pandas_udf(ARTICLE)
def parse_html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h) for h in html], columns=[f.name for f in ARTICLE.fields])


def strip_branding(title: Column) -> Column:
    """A title without the site's name behind a bar or dash."""
    return F.trim(F.regexp_replace(title, r"\s+[|–—-]\s+[^|–—-]{2,30}$", ""))


def brand_name(name: Column) -> Column:
    """The distinctive part of a company name: legal forms before and after it go."""
    t = F.regexp_replace(name, r"(?iu)^\s*(?:tổng\s+công\s+ty|công\s+ty|ctcp|ngân\s+hàng|tập\s+đoàn)\s*(?:cổ\s+phần|tnhh|mtv|tm)?\s*(?:mtv)?\s*", "")
    return F.trim(F.regexp_replace(t, r"(?iu)\s*[-–]\s*(?:ctcp|công\s+ty\s+cổ\s+phần)\s*$|\s*\([^)]*\)\s*$", ""))


# What stands before a firm's code, whatever the case of both; lines that are no part of an article.
CODE_AHEAD = r"(?:mã(?: chứng khoán| ck)?|cổ phiếu|hose:|hnx:|upcom:)"
BOILERPLATE = (
    r"(?:tin|bài|video|ảnh)\s+(?:liên quan|cùng chuyên mục|khác|tương tự)", r"(?:xem|đọc|tham khảo|theo dõi|bấm vào đây để xem)\s+(?:thêm|tiếp|ngay|chi tiết)", r"có thể bạn quan tâm", r"(?:từ khóa|tags?):",
    r"link\s+(?:gốc|bài viết):", r"(?:bản quyền thuộc về|copyright)", r"mọi thắc mắc,?\s+vui lòng liên hệ",
    r"theo\s+(?:cafef|cafebiz|vietstock|vneconomy|tin nhanh chứng khoán|báo đầu tư|doanh nghiệp & tiếp thị|vietnamnet|vnexpress)", r"việt nam hàng ngày$",
)


def without_boilerplate(text: Column) -> Column:
    """An article's lines without blank ones and those that only lead elsewhere, an empty line between them."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).rlike(rf"^(?:{'|'.join(BOILERPLATE)})(?![\p{{L}}\p{{N}}_])"))
    return F.array_join(lines, "\n\n")


def own_source(source: Column) -> Column:
    """Whether an article comes from the firm's own site or a source named for it."""
    return F.coalesce((source == "company_website") | F.contains(source, F.lit("custom")), F.lit(False))


def company_confirmed(ticker: Column, company: Column, title: Column, sapo: Column, text: Column, source: Column | None = None, brands: Column | None = None) -> Column:
    """Whether an article names the firm: its code as a word of its own or behind what announces a code, its name (over 6
    letters) or a brand (4 or more); articles of the firm's own sources are taken as they are."""
    body = F.concat_ws(" ", title, sapo, F.substring(text, 1, 4000))
    code = F.regexp_like(body, F.concat(F.lit(r"(?<![A-Za-z0-9])"), ticker, F.lit(r"(?![A-Za-z0-9])")))
    low, name, brand = F.lower(body), F.lower(company), F.lower(brand_name(company))
    code = code | F.regexp_like(low, F.concat(F.lit(rf"(?<![\p{{L}}\p{{N}}_]){CODE_AHEAD}\s*"), F.lower(ticker), F.lit(r"(?![\p{L}\p{N}_])")))
    named = (F.length(name) > 6) & F.contains(low, name)
    branded = (F.length(brand) >= 4) & F.contains(low, brand)
    if brands is not None:
        branded = branded | F.exists(brands, lambda b: (F.length(b) >= 4) & F.contains(low, F.lower(b)))
    found = F.coalesce(code, F.lit(False)) | F.coalesce(named, F.lit(False)) | F.coalesce(branded, F.lit(False))
    return found if source is None else own_source(source) | found


def keyword_confirmed(texts: list[Column], keywords: Column) -> Column:
    """Whether any keyword occurs; an empty or null list lets every article pass."""
    body = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(F.size(keywords) <= 0, F.lit(True)) | F.coalesce(F.exists(keywords, lambda k: F.contains(body, F.lower(k))), F.lit(False)) | keywords.isNull()


def year_passes(year: Column, first: int | None, last: int | None) -> Column:
    """An unknown year passes."""
    return year.isNull() | year.between(first if first is not None else 1900, last if last is not None else 2100)


def word_shingles(text: Column, n: int = 2) -> Column:
    """Distinct runs of n words; the words themselves where there are fewer."""
    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(w))

    return let(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda x: x != ""), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def _alike(a: dict, b: dict) -> bool:
    if a["title"] and b["title"]:
        m = difflib.SequenceMatcher(None, a["title"], b["title"])
        if m.real_quick_ratio() > TITLE_ALIKE and m.quick_ratio() > TITLE_ALIKE and m.ratio() > TITLE_ALIKE:
            return True
    if len(a["sapo"]) > LEAD_LEAST and len(b["sapo"]) > LEAD_LEAST:
        m = difflib.SequenceMatcher(None, a["sapo"], b["sapo"])
        if m.quick_ratio() > LEAD_ALIKE and m.ratio() > LEAD_ALIKE:
            return True
    if a["pairs"] and b["pairs"]:
        return len(a["pairs"] & b["pairs"]) / len(a["pairs"] | b["pairs"]) > TEXT_ALIKE
    return False


def _features(title: str | None, sapo: str | None, text: str | None) -> dict:
    text = (text or "").lower()
    w = [x for x in re.split(r"\W+", text) if x]
    return {"title": (title or "").lower().strip(), "sapo": (sapo or "").lower().strip(), "pairs": set(zip(w, w[1:], strict=False)) if len(text) > TEXT_LEAST else set()}


def _cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy clusters of articles that stream in by block and rank: each joins the first earlier primary that it resembles.

    Only the primaries of the block at hand are held, never its articles.
    """
    block, primaries = None, []
    for rows in batches:
        owner = []
        for b, article, title, sapo, text in rows[["__b", "article_id", "title", "sapo", "text"]].itertuples(index=False):
            if b != block:
                block, primaries = b, []
            one = _features(title, sapo, text)
            hit = next((pid for pid, p in primaries if _alike(one, p)), None)
            if hit is None:
                primaries.append((article, one))
                hit = article
            owner.append(hit)
        yield pd.DataFrame({"article_id": rows["article_id"], "primary_id": owner})


def cluster_articles(articles: DataFrame, block: Column) -> DataFrame:
    """``(article_id, primary_id)``: near-duplicates within a block get one primary (the earliest by source rank, then id).

    ``articles`` has article_id, source_rank, title, sapo, text, of which the first TEXT_USED characters are compared, as the
    definition of a reprint asks for.  ``block`` is a firm and publication window: its distinct articles pass one task in
    their order, since each is compared with the primaries before it.
    """
    rows = articles.select(block.alias("__b"), "article_id", "source_rank", "title", "sapo", F.substring("text", 1, TEXT_USED).alias("text"))
    # Exact copies are one article to the clustering; an aggregation, combined on the map side.
    same = ["__b", "title", "sapo", "text"]
    lead = F.min(F.struct("source_rank", "article_id"))
    distinct = rows.groupBy(*same).agg(lead.alias("m")).select("__b", "m.article_id", "m.source_rank", "title", "sapo", "text")
    streamed = distinct.repartition("__b").sortWithinPartitions("__b", "source_rank", "article_id")
    found = streamed.mapInPandas(_cluster, "article_id long, primary_id long").withColumnRenamed("article_id", "__lead")
    leads = distinct.select(*[F.col(c).alias(f"__{c}") for c in same], F.col("article_id").alias("__lead"))
    cond = F.lit(True)
    for c in same:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.select("article_id", *same).join(leads, cond).join(found, "__lead").select("article_id", "primary_id")


def syndication(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Primaries with reprint_count and the distinct sources that carried them."""
    joined = clusters.join(articles.select("article_id", "source"), "article_id")
    carried = joined.groupBy("primary_id").agg(F.count(F.lit(1)).alias("reprint_count"), F.array_sort(F.collect_set("source")).alias("syndicated_sources"))
    return articles.join(carried, articles["article_id"] == carried["primary_id"]).drop("primary_id")


def firm_year(articles: DataFrame, hits: Column, reprints: Column, words: Column | None = None) -> DataFrame:
    """Firm-year measures, each article once and weighted by its reprints (``_full``)."""
    words = word_count(F.col("text")) if words is None else words
    rows = articles.select("ticker", "year", words.alias("w"), hits.alias("h"), reprints.alias("r"))
    return rows.groupBy("ticker", "year").agg(
        F.count(F.lit(1)).alias("total_articles"), F.sum("r").alias("total_articles_full"), F.sum("w").alias("total_words"), F.sum(F.col("w") * F.col("r")).alias("total_words_full"),
        F.sum("h").alias("total_hits"), F.sum(F.col("h") * F.col("r")).alias("total_hits_full"), F.count_if(F.col("h") > 0).alias("articles_with_hits"),
        F.round(F.count_if(F.col("h") > 0) / F.count(F.lit(1)) * 100, 2).alias("hit_ratio_pct"),
        F.round(F.try_divide(F.sum("h") * 1000.0, F.sum("w")), 4).alias("density_per_1000"), F.round(F.log1p(F.sum("h").cast("double")), 6).alias("log_hits"),
    )


def gap_filled(panel: DataFrame, first_active: DataFrame, year_from: int, year_to: int) -> DataFrame:
    """Every firm with every year from its first active one (the request's first at least) to the last; zeros where nothing was found.

    ``first_active`` has (ticker, first_year); a null first year stands for the whole span.
    """
    measures = [c for c in panel.columns if c not in ("ticker", "year")]
    start = F.greatest(F.coalesce(F.col("first_year"), F.lit(year_from)), F.lit(year_from))
    grid = first_active.select("ticker", F.explode(F.when(start <= year_to, F.sequence(start, F.lit(year_to))).otherwise(F.array().cast("array<int>"))).alias("year"))
    return grid.join(panel, ["ticker", "year"], "left").select("ticker", "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in measures])


def interleave(links: DataFrame) -> DataFrame:
    """Links of several sources in turn (first of each, second of each, ...), each address once."""
    w = Window.partitionBy("source").orderBy("position")
    turned = links.withColumn("turn", F.row_number().over(w))
    first = F.row_number().over(Window.partitionBy("url").orderBy("turn", "source"))
    return turned.withColumn("__n", first).where("__n = 1").drop("__n")


def with_duplicates(primary: DataFrame, inherited: list[str]) -> DataFrame:
    """Every article as a row: the primary ones and, with their measures, the duplicates in ``duplicates`` (an array of structs)."""
    fields = [f.name for f in primary.schema["duplicates"].dataType.elementType.fields]
    first = primary.select(*fields, *inherited, F.lit(False).alias("is_duplicate"))
    return first.unionByName(primary.select(F.explode("duplicates").alias("d"), *inherited).select(*[F.col(f"d.{f}").alias(f) for f in fields], *inherited, F.lit(True).alias("is_duplicate")))


def year_or(year: Column, default: int) -> Column:
    """A year, or the default where none is known."""
    return F.coalesce(year.try_cast("int"), F.lit(default))


def brand_order(brands: Column) -> Column:
    """Distinct brand tokens, the longest first, ties by name."""
    keyed = F.transform(F.array_distinct(brands), lambda b: F.struct((-F.length(b)).alias("l"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda x: x["b"])
