"""Text expressions: all built-in columns, evaluated inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pairs of the two places of a tone mark; the left one is turned into the right one.
TONE_PAIRS = (
    ("oà", "òa"), ("oá", "óa"), ("oả", "ỏa"), ("oã", "õa"), ("oạ", "ọa"),
    ("Oà", "Òa"), ("Oá", "Óa"), ("Oả", "Ỏa"), ("Oã", "Õa"), ("Oạ", "Ọa"),
    ("oè", "òe"), ("oé", "óe"), ("oẻ", "ỏe"), ("oẽ", "õe"), ("oẹ", "ọe"),
    ("Oè", "Òe"), ("Oé", "Óe"), ("Oẻ", "Ỏe"), ("Oẽ", "Õe"), ("Oẹ", "Ọe"),
    ("uỳ", "ùy"), ("uý", "úy"), ("uỷ", "ủy"), ("uỹ", "ũy"), ("uỵ", "ụy"),
    ("Uỳ", "Ùy"), ("Uý", "Úy"), ("Uỷ", "Ủy"), ("Uỹ", "Ũy"), ("Uỵ", "Ụy"),
)
BLANK = r"[\s\p{Z}]+"


def _accents() -> tuple[str, str]:
    """Composed Latin letters and their plain forms, by rule over the code points."""
    letters, plain = [], []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isascii():
            letters.append(chr(c))
            plain.append(base)
    return "".join(letters) + "đĐ", "".join(plain) + "dD"


ACCENTED, PLAIN = _accents()


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``c`` computed once: an expression named inside a lambda would else be computed for every element."""
    return F.element_at(F.transform(F.array(c), body), 1)


def replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Literal replacements in their order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def tone_normal(c: Column) -> Column:
    """One place for the tone mark (both sides of a comparison need it; it also rewrites words like 'quý')."""
    return replace_all(c, TONE_PAIRS)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark SQL has no function."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def strip_accents(c: Column) -> Column:
    """Plain letters for accented Latin ones, đ included; combining marks go."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), ACCENTED, PLAIN)


def words(c: Column) -> Column:
    """Tokens between blanks; none for a blank text, null for null."""
    return F.filter(F.split(c, BLANK), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def clean_text(c: Column) -> Column:
    """Ligatures, soft hyphens and invisible signs out, one tone place, no control characters, squeezed blanks."""
    c = replace_all(c, (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")))
    c = F.regexp_replace(c, "[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", "")
    c = tone_normal(c)
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(c, r"\n{4,}", "\n\n\n")


def snippet(text: Column, position: Column, length: Column, around: int) -> Column:
    """Characters around a span (position counts from 0), with dots where text was left out."""
    start = F.greatest(position - around, F.lit(0))
    end = F.least(position + length + around, F.length(text))
    return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(text, start + 1, end - start), F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))


def year_of_two_digits(c: Column) -> Column:
    """yy to a year: below 50 the 2000s, else the 1900s."""
    n = c.cast("int")
    return F.when(n < 50, 2000 + n).otherwise(1900 + n)


def parse_filename(name: Column) -> Column:
    """``STRUCT<ticker, year>`` of a report's file name: ticker_year, year_ticker, ticker with a two-digit year; null parts otherwise."""
    stem = F.upper(F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"(?i)\.(?:pdf|txt|docx?)$", ""))
    a = r"^([A-Z][A-Z0-9]{2,5})[ _-]+((?:19|20)\d\d)(?!\d)"
    b = r"(?:^|[^0-9A-Z])((?:19|20)\d\d)[ _-]+(?:[A-Z]+[ _-]+)*?([A-Z][A-Z0-9]{2,5})$"
    c = r"^([A-Z][A-Z0-9]{2,5})[ _-]+(\d\d)(?:[ _-]|$)"
    got = lambda p, i: F.nullif(F.regexp_extract(stem, p, i), F.lit(""))
    ticker = F.coalesce(got(a, 1), got(b, 2), got(c, 1))
    year = F.coalesce(got(a, 2).cast("int"), got(b, 1).cast("int"), year_of_two_digits(got(c, 2)))
    return F.struct(ticker.alias("ticker"), year.alias("year"))


def parse_cell_number(c: Column) -> Column:
    """Number of a statement cell: dots part thousands, the comma is decimal, parentheses negate, dashes are null."""
    t = F.regexp_replace(c, BLANK, "")
    negative = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(t, r"[()]", "")
    v = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(t.isin("", "-", "–", "—"), F.lit(None)).when(negative, -v).otherwise(v)


def normal_item_name(c: Column) -> Column:
    """Statement item names without numbering (roman, arabic or letter) and parentheses, lower case, squeezed."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"^\s*(?:[ivxlc]+|\d+(?:\.\d+)*|[a-zđ])\s*[.)\-/]\s*", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def headcount_number(c: Column) -> Column:
    """Integer of a headcount figure: O read for 0, blanks, dots or commas between thousands, a footnote digit glued on."""
    t = F.trim(c)
    t = F.when(t.rlike(r"\d[oO]|[oO]\d"), F.translate(t, "Oo", "00")).otherwise(t)
    digits = F.regexp_replace(t, r"[^0-9]", "")
    single = lambda v: F.floor(v.try_cast("double"))
    return F.coalesce(
        F.when(t.rlike(r"^\d+(?: \d+)+$"), digits.try_cast("long"))
        .when(t.rlike(r"^\d+(?:\.\d{3})+$") | t.rlike(r"^\d+(?:,\d{3})+$"), digits.try_cast("long"))
        .when(t.rlike(r"^\d+\.\d{4}$"), F.substring(digits, F.lit(1), F.length(digits) - 1).try_cast("long"))
        .when(t.rlike(r"^[\d,]+\.\d+$"), single(F.replace(t, F.lit(","), F.lit(""))).cast("long"))
        .when(t.rlike(r"^[\d.]+,\d+$"), single(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).cast("long"))
        .otherwise(F.nullif(digits, F.lit("")).try_cast("long")),
        F.lit(0).cast("long"),
    )


def split_tickers(c: Column) -> Column:
    """Distinct upper-case tickers of a typed list, in their order."""
    return F.array_distinct(F.filter(F.split(F.upper(F.trim(c)), r"[,;\s]+"), lambda x: x != ""))


def clean_date(c: Column) -> Column:
    """ISO or day-month-year dates inside a string as ``YYYY-MM-DD``; other strings cut to 12 characters."""
    iso = r"((?:19|20)\d\d)-(\d{1,2})-(\d{1,2})"
    vn = r"(\d{1,2})[/.-](\d{1,2})[/.-]((?:19|20)\d\d)"
    put = lambda p, y, m, d: F.concat_ws("-", F.regexp_extract(c, p, y), F.lpad(F.regexp_extract(c, p, m), 2, "0"), F.lpad(F.regexp_extract(c, p, d), 2, "0"))
    return F.when(c.rlike(iso), put(iso, 1, 2, 3)).when(c.rlike(vn), put(vn, 3, 2, 1)).otherwise(F.substring(c, 1, 12))


def article_year(date: Column, url: Column, text: Column) -> Column:
    """Year of an article: from its date, the path of its address, the address, dates in the lead, a year in the lead."""
    y = r"((?:19|20)\d\d)"
    got = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    return F.coalesce(
        got(date, y), got(url, f"/{y}/"), got(url, rf"(?<!\d){y}(?!\d)"),
        got(F.substring(text, 1, 600), rf"\d{{1,2}}[/.-]\d{{1,2}}[/.-]{y}"), got(F.substring(text, 1, 300), rf"(?<!\d){y}(?!\d)"),
    )


def file_fingerprint(text: Column, edge: int = 8192) -> Column:
    """Hash of a content's head, tail and size: equal contents share it."""
    return F.md5(F.concat(F.left(text, F.lit(edge)), F.right(text, F.lit(edge)), F.length(text).cast("string")))
