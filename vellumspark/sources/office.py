"""Small office files and databases as rows: workbooks, word documents, SQLite tables.

These hold dictionaries and lists, not data at scale: a file is read on the driver and becomes a DataFrame.
"""

from __future__ import annotations

import re
import sqlite3
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def workbook_rows(path: str | Path, sheet: int = 1) -> list[list[str]]:
    """Cells of a sheet of an .xlsx file as strings; missing cells are empty."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(row.iter(f"{_SHEET}c")):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = n if letters is None else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters.group()))) - 1
                value = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if value is None else value.text or ""
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def document_rows(path: str | Path) -> list[list[str]]:
    """Rows of a .docx file: the cells of its tables' rows, each paragraph outside of them as a row of one cell; empty ones left out."""
    with zipfile.ZipFile(path) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    rows = []
    for part in body if body is not None else []:
        if part.tag == f"{_WORD}tbl":
            rows += [[text(c) for c in r.findall(f"{_WORD}tc")] for r in part.iter(f"{_WORD}tr")]
        elif part.tag == f"{_WORD}p":
            rows.append([text(part)])
    return [r for r in rows if any(r)]


def as_sheet(rows: list[list[str]]) -> str:
    """Rows as a tab-parted sheet, as ``dictionary.from_sheet`` reads it."""
    return "\n".join("\t".join(re.sub(r"\s+", " ", c) for c in r) for r in rows)


def database_table(spark: SparkSession, path: str | Path, table: str) -> DataFrame:
    """A table of an SQLite file, all columns as strings."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError(f"no table name: {table}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cursor = db.execute(f"select * from {table}")
        names = [c[0] for c in cursor.description]
        rows = [tuple(None if v is None else str(v) for v in r) for r in cursor]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def local_first(local: str | Path, remote: str, least: int = 10_000) -> str:
    """The local file where it is larger than ``least`` bytes, else the remote one."""
    local = Path(local)
    return str(local) if local.is_file() and local.stat().st_size > least else remote
