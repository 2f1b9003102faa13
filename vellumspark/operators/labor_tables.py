"""Headcounts in tables, notes and callouts: candidates from windows of lines.

A page is a list of lines (line ends, or the double slashes of flattened tables, part them).  A strategy is data: where its
label stands, the window of lines around it, and how the figure is chosen there.  Pages are read in one Arrow pass; those
without a label or a unit are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labor import LEAST, MOST

# Labels of headcount rows, units, words of breakdown tables, and words that speak against a headcount.
LABELS = ("tổng số lao động", "tổng số nhân viên", "tổng số cbcnv", "tổng số cán bộ", "tổng số người lao động", "số lượng lao động", "số lượng nhân viên", "số lượng nhân sự", "số lao động", "lao động bình quân", "nhân sự bình quân", "quy mô nhân sự", "quy mô lao động", "tổng nhân sự", "nguồn nhân lực", "total employees", "total workforce", "number of employees")
UNITS = ("người", "nhân viên", "lao động", "cbcnv", "cbnv", "employees", "people", "staff")
CATEGORIES = ("đại học", "cao đẳng", "trung cấp", "phổ thông", "hợp đồng lao động", "không xác định thời hạn", "có thời hạn", "lao động trực tiếp", "lao động gián tiếp", "cơ cấu lao động")
TOTALS = ("tổng cộng", "tổng số", "tổng", "tổng cộng / total", "cộng", "total")
SUBSETS = ("thuê mới", "tuyển mới", "tuyển dụng", "nghỉ việc", "thôi việc", "sa thải", "trình độ", "độ tuổi", "giới tính", "thời vụ", "tỷ lệ", "tỷ trọng", "lao động nữ", "lao động nam")
MONEY = ("thu nhập", "lương", "đồng", "triệu", "tỷ", "vnd", "usd")
OTHER_TABLES = ("cổ đông", "cổ phần", "vốn điều lệ", "biểu quyết", "nghị quyết", "doanh thu", "lợi nhuận", "tổng tài sản", "phải thu", "phải trả", "nhiệm kỳ", "thù lao", "cổ phiếu", "thai sản", "kỷ luật")
DISQUALIFY = (*SUBSETS, "trực tiếp:", "gián tiếp:", "suất ăn", "kwh", "thành viên hđqt", "ban kiểm soát", "khen thưởng", "bổ nhiệm", "tài trợ", "xuất khẩu lao động", "tai nạn lao động", "lớp đào tạo", "mục lục")
GROUP = ("công ty con", "tập đoàn", "toàn hệ thống", "hợp nhất", "nhóm công ty")
#: What a strategy adds to a candidate's confidence.
TIERS = {"note": 0.45, "callout": 0.30, "year_run": 0.15, "year_columns": 0.15, "beside_year": 0.15, "plan_actual": 0.15, "whole": 0.10, "total_row": 0.10}
#: Weights of a page's words.
PAGE_LABEL, PAGE_UNIT, PAGE_DATE, PAGE_YEAR, PAGE_LEAST = 15, 10, 25, 5, 10
TAIL = 300

_YEAR = re.compile(r"(?<!\d)20[12]\d(?!\d)")
_FIGURE = re.compile(r"(?<![\d.,/])(?:\d{1,3}(?:[.,]\d{3})+|\d{1,6})(?![\d/]|[.,]\d)")
_SHARE = re.compile(r"\d+(?:[.,]\d+)?\s*%")
_DAY = r"(?:31[/. ]*(?:12|tháng 12)[/. ]*(?:năm )?|31 december )"
_NEW_YEAR = r"0?1[/. ]*(?:0?1|tháng 1)[/. ]*(?:năm )?"
_COUNT = r"(\d{1,3}(?:[.,]\d{3})+|\d{2,6})"
#: A dated count in the notes of a statement, and the count of the other year in brackets behind it.
_NOTE = re.compile(rf"{_DAY}(20[12]\d)[^0-9]{{0,60}}?(?:là|có|was|had|:|=) ?{_COUNT}(?: ?(?:{'|'.join(UNITS)}))?(?:[^0-9]{{0,30}}?\([^0-9]{{0,20}}(?:{_DAY}(20[12]\d)|{_NEW_YEAR}(20[12]\d))[^0-9]{{0,30}}?{_COUNT})?")
_CALLOUT = re.compile(rf"(?<![\d.,])(\d{{1,3}}(?:[.,]\d{{3}})+|\d{{4,6}}) (?:{'|'.join(UNITS)})(?!\w)")


def has_any(text: str, words: tuple[str, ...]) -> bool:
    return any(w in text for w in words)


def number(figure: str) -> int:
    return int(re.sub(r"[.,]", "", figure))


def plausible(value: int, unit: bool = True) -> bool:
    """In a headcount's range, and rather no year or day of a month."""
    return LEAST <= value <= MOST and (unit or value >= 20) and not 2005 <= value <= 2040 and value not in (12, 28, 29, 30, 31)


@dataclass(frozen=True)
class Found:
    strategy: str
    value: int
    matched: bool
    base: float
    snippet: str


class Page:
    """Lines of a page in lower case, with their figures and years."""

    def __init__(self, text: str):
        parts = (re.sub(r"\s+", " ", x).strip().lower() for x in re.split(r"[\r\n]+|//", text))
        self.lines = [x for x in parts if x]
        self.text = " ".join(self.lines)

    def around(self, i: int, before: int, behind: int) -> range:
        return range(max(0, i - before), min(len(self.lines), i + behind))

    def figures(self, i: int) -> list[int]:
        """Counts in a line: shares, row numbers and codes left aside."""
        return [number(x) for x in _FIGURE.findall(re.sub(r"^\d{1,2}\s*[.)=-]\s+", "", _SHARE.sub(" ", self.lines[i])))]

    def years(self, i: int) -> list[int]:
        return [int(y) for y in _YEAR.findall(self.lines[i])]

    def labelled(self) -> Iterator[int]:
        return (i for i, line in enumerate(self.lines) if has_any(line, LABELS) and not has_any(line, SUBSETS))

    def join(self, where: range) -> str:
        return " // ".join(self.lines[k] for k in where)


def year_columns(page: Page, year: int) -> Iterator[Found]:
    """A line of several years near a label; a line of as many counts gives the one of the report's year."""
    for i in page.labelled():
        where = page.around(i, 4, 7)
        heads = [y for k in where if len(y := page.years(k)) > 1 and not re.search(r"20[12]\d\s*[-–—]\s*20[12]\d|giai đoạn|kế hoạch", page.lines[k])]
        if not heads or year not in heads[0]:
            continue
        for k in where:
            counts = page.figures(k)
            if len(counts) == len(heads[0]) and counts != heads[0] and not has_any(page.lines[k], SUBSETS + MONEY):
                value = counts[heads[0].index(year)]
                if plausible(value, has_any(page.lines[k], UNITS)):
                    yield Found("year_columns", value, True, 0.85, page.join(where))


def year_run(page: Page, year: int) -> Iterator[Found]:
    """Lines that are years and nothing else, one below the other; as many counts below a label belong to them in order."""
    run: list[int] = []
    for i, line in enumerate([*page.lines, ""]):
        if _YEAR.fullmatch(line):
            run.append(int(line))
            continue
        if len(run) > 1 and year in run:
            for k in page.around(i, 0, 25):
                if not has_any(page.lines[k], LABELS) or has_any(page.lines[k], SUBSETS):
                    continue
                below = [number(m.group()) for j in page.around(k + 1, 0, 3 * len(run)) if (m := _FIGURE.match(page.lines[j]))]
                below = [v for v in below if plausible(v)][: len(run)]
                if len(below) == len(run):
                    yield Found("year_run", below[run.index(year)], True, 0.98, page.lines[k] + " // " + " // ".join(f"{y}: {v}" for y, v in zip(run, below, strict=True)))
        run = []


def beside_year(page: Page, year: int) -> Iterator[Found]:
    """A line near a label that pairs the report's year with a count."""
    pair = re.compile(rf"(?<!\d){year}[^0-9]{{0,30}}?({_FIGURE.pattern})(?!\s*%)")
    for i in page.labelled():
        for k in page.around(i, 4, 7):
            line = page.lines[k]
            m = None if has_any(line, SUBSETS + MONEY) or re.search(r"báo cáo thường niên|annual report|trang|[«»]", line) else pair.search(line)
            if m:
                value, unit = number(m.group(1)), has_any(line, UNITS)
                if plausible(value, unit) and (value >= 100 or unit):
                    yield Found("beside_year", value, True, 0.94, page.lines[i] + " // " + line)


def whole(page: Page, year: int) -> Iterator[Found]:
    """Counts near a line of 100 % in a breakdown of the workforce."""
    for i, line in enumerate(page.lines):
        if not re.search(r"(?<!\d)100(?:[.,]00?)?\s*%?$|(?<!\d)100(?:[.,]00?)?\s*%", line):
            continue
        where = page.around(i, 8, 4)  # flattened tables hold a cell a line
        window = page.join(where)
        if has_any(window, OTHER_TABLES) or not has_any(window, CATEGORIES + TOTALS[:1]) or not has_any(window, UNITS + CATEGORIES):
            continue
        for k in where:
            counts = [v for v in page.figures(k) if v not in (100, year) and v > 5]
            for n, value in enumerate(counts):
                if plausible(value) and (value >= 50 or has_any(window, UNITS)) and (k == i or has_any(page.lines[k - 1] if k else "", TOTALS)):
                    matched = n == len(counts) - 1 and str(year) in page.text
                    yield Found("whole", value, matched, 0.93 if matched else 0.70, window)


def total_row(page: Page, year: int) -> Iterator[Found]:
    """The count in or below a line 'total' under the categories of a workforce."""
    for i, line in enumerate(page.lines):
        if line.strip(" :") not in TOTALS:
            continue
        above = page.join(page.around(i, 15, 0))
        if has_any(above, OTHER_TABLES) or not has_any(above, CATEGORIES):
            continue
        for k in page.around(i, 0, 3):
            for value in page.figures(k):
                if value >= 50 and plausible(value) and not has_any(page.lines[k], MONEY):
                    yield Found("total_row", value, str(year) in page.text, 0.92, above[-120:] + f" // {line}: {page.lines[k]}")


def note(page: Page, year: int) -> Iterator[Found]:
    """Dated counts of a statement's notes; a count at the first of January is that of the year before."""
    for m in _NOTE.finditer(page.text):
        around = page.text[max(0, m.start() - 80) : m.end() + 20]
        if not has_any(around, UNITS):
            continue
        pairs = [(int(m.group(1)), m.group(2)), (int(m.group(3)) if m.group(3) else int(m.group(4)) - 1 if m.group(4) else None, m.group(5))]
        for n, (of, figure) in enumerate(pairs):
            if of and figure and plausible(number(figure)):
                yield Found("note", number(figure), of == year, (0.99 - n / 100) if of == year else 0.15, around)


def plan_actual(page: Page, year: int) -> Iterator[Found]:
    """A row label and its counts below: the one of the report's year by the header's years, else the last before a share."""
    for i in page.labelled():
        if len(page.lines[i]) > 80 or page.figures(i) or re.search(r" (?:là|was|đạt) |ngày|địa chỉ", page.lines[i]):
            continue
        counts: list[int] = []
        for k in page.around(i + 1, 0, 9):
            line = page.lines[k]
            if "%" in line or counts and (len(line) > 35 or line[0] in "-+•*" or not re.search(r"\d", line) and not has_any(line, UNITS)):
                break
            if not has_any(line, MONEY) and not re.search(r"\d+/[a-z]|\d[.,]\d{1,2}(?!\d)", line):
                counts += [v for v in page.figures(k)[:1] if v >= 10 and plausible(v, has_any(line, UNITS))]
        while len(counts) > 1 and counts[-1] < 50 and counts[-1] < 0.25 * counts[-2]:
            counts.pop()  # a column of notes
        steps = {a - b for a, b in zip(counts, counts[1:], strict=False)}
        if not counts or len(counts) > 3 and len(steps) == 1 and steps.pop() > 0:
            continue  # nothing, or the ticks of a chart
        heads = next((y for k in range(i) if len(y := page.years(k)) > 1), [])
        dated = len(heads) == len(counts) and year in heads
        matched = dated or str(year) in page.join(range(i))
        yield Found("plan_actual", counts[heads.index(year)] if dated else counts[-1], matched, 0.96 if matched else 0.72, page.lines[i] + " // " + " // ".join(map(str, counts)))


def callout(page: Page, year: int) -> Iterator[Found]:
    """A large count with its unit within four lines of a label."""
    for i in page.labelled():
        where = page.around(i, 4, 5)
        for k in where:
            m = _CALLOUT.search(page.lines[k])
            if m and not has_any(page.lines[k], MONEY) and 100 <= (value := number(m.group(1))) and plausible(value):
                yield Found("callout", value, str(year) in page.text, 0.95, page.join(where))


STRATEGIES = (year_columns, year_run, beside_year, whole, total_row, note, plan_actual, callout)


def excluded(snippet: str) -> bool:
    return has_any(snippet, DISQUALIFY)


def page_score(text: Column, year: Column) -> Column:
    """How much a page speaks of headcounts: labels, units, and the closing day or number of the report's year."""
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    labels = F.size(F.filter(F.array(*[F.lit(w) for w in LABELS]), lambda w: F.contains(low, w)))
    y = year.cast("string")
    dated = F.contains(low, F.concat(F.lit("31/12/"), y)) | F.contains(low, F.concat(F.lit("31 tháng 12 năm "), y))
    return (labels * PAGE_LABEL + F.when(any_of(UNITS), PAGE_UNIT).otherwise(0) + F.when(dated, PAGE_DATE).when(F.contains(low, y), PAGE_YEAR).otherwise(0)).cast("int")


def with_tails(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """Pages with ``context``: their text between the end of the page before and the begin of the page behind, for split sentences."""
    w = Window.partitionBy(*keys).orderBy(page)
    joined = F.concat_ws(" ", F.right(F.lag(text).over(w), F.lit(TAIL)), F.col(text), F.left(F.lead(text).over(w), F.lit(TAIL)))
    return pages.withColumn("context", joined)


def candidates(pages: DataFrame, keys: list[str], text: str, year: str) -> DataFrame:
    """``(keys, strategy, value, matched, base, snippet, score)``: counts that the strategies find and nothing disqualifies.

    Null texts and years give none; repeated rows give repeated output; extra columns are left aside.
    """
    labelled = F.lower(F.col(text)).rlike("|".join(re.escape(w) for w in (*LABELS, *CATEGORIES, *UNITS)))
    rows = pages.where(F.col(year).isNotNull() & labelled).select(F.col(year).cast("int").alias("__year"), F.col(text).alias("__text"), *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for n, (y, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                page = Page(t)
                for f in dict.fromkeys(f for s in STRATEGIES for f in s(page, y)):
                    if not excluded(f.snippet):
                        at.append(n)
                        out.append(f)
            columns = [pa.array([getattr(f, name) for f in out], t) for name, t in (("strategy", pa.string()), ("value", pa.int64()), ("matched", pa.bool_()), ("base", pa.float64()), ("snippet", pa.string()))]
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(2 + i) for i in range(len(keys))), *columns], names=[*keys, "strategy", "value", "matched", "base", "snippet"])

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    found = rows.mapInArrow(run, f"{key_types}, strategy string, value long, matched boolean, base double, snippet string")
    tier = F.lit(0.0)
    for s, v in TIERS.items():
        tier = F.when(F.col("strategy") == s, v).otherwise(tier)
    group = F.exists(F.array(*[F.lit(w) for w in GROUP]), lambda w: F.contains(F.col("snippet"), w))
    score = F.col("base") + tier + F.when(F.col("matched"), 0.35).otherwise(0.0) + F.when(group, 0.35).otherwise(0.0) - F.when((F.col("value") < 50) & ~F.col("snippet").rlike("|".join(UNITS)), 0.85).otherwise(0.0)
    return found.withColumn("score", F.round(score, 4))
