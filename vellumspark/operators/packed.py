"""Several values packed in one field (problem 5).

Quoted spans are swapped for indexed placeholders, the rest is split at the
delimiters, spans come back by array lookup and the pieces are exploded with
their positions.  Everything is built-in expressions: one narrow stage, no
shuffle and no Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholder marks: open, close, escape (private use area).
OPEN, CLOSE, ESC = "\ue000", "\ue001", "\ue002"
#: Delimiters that stand anywhere (a comma between two digits is a decimal sign).
HARD = r"[|;\t\r\n]+|(?<!\d),|,(?!\d)"
#: Delimiters that count only between blanks, since they also occur inside words.
SPACED = r"(?<=\s)[/\-–—](?=[\s\ue000])"
#: A quoted span fills a whole place: it starts at the beginning or after a delimiter and ends before one.
_START = r"(?:^|(?<=[|;,\t\r\n])|(?<=\s[/\-–—])|(?<=^[\-*•]))[  ]*"
_END = r"(?=[  ]*(?:$|[|;,\t\r\n]|\s[/\-–—](?:\s|$)))"
_QUOTED = rf'"(?:[^"]++|"")*+"{_END}|“[^”]*”{_END}|\'[^\']*\'{_END}|«[^»]*»{_END}'


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(ESC + "a"))
    c = F.replace(c, F.lit(OPEN), F.lit(ESC + "b"))
    return F.replace(c, F.lit(CLOSE), F.lit(ESC + "c"))


def _unescape(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC + "c"), F.lit(CLOSE))
    c = F.replace(c, F.lit(ESC + "b"), F.lit(OPEN))
    return F.replace(c, F.lit(ESC + "a"), F.lit(ESC))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s ]+|[\s ]+$", "")


def _unquote(c: Column) -> Column:
    """Strips one pair of quotes and halves doubled ones."""
    body = F.substring(c, F.lit(2), F.length(c) - 2)
    return (
        F.when(c.rlike(r'(?s)^"(?:[^"]++|"")*+"$'), F.replace(body, F.lit('""'), F.lit('"')))
        .when(c.rlike(r"(?s)^(?:“[^”]*”|'[^']*'|«[^»]*»)$"), body)
        .otherwise(c)
    )


def _any_of(names: Sequence[str]) -> str:
    """A pattern for the longest name that begins at a place: names share their beginnings, so their number costs little."""
    tree: dict = {}
    for name in names:
        node = tree
        for c in name:
            node = node.setdefault(c, {})
        if name:
            node[""] = {}

    def pattern(node: dict) -> str:
        arms = []
        for c, child in sorted(node.items()):
            if c:
                run = c
                while len(child) == 1 and "" not in child:
                    (c, child), = child.items()
                    run += c
                arms.append(re.escape(run) + pattern(child))
        if not arms:
            return ""
        joined = f"(?:{'|'.join(arms)})" if len(arms) > 1 or "" in node else arms[0]
        return joined + ("?" if "" in node else "")

    return pattern(tree)


def packed_values(value: Column, known: Sequence[str] = ()) -> Column:
    """``ARRAY<STRING>`` of the values packed in ``value``, in their order.

    known: a fixed vocabulary, which becomes part of the plan.  Its names are
    protected like quoted spans, whatever delimiters they contain, even where
    nothing parts them from the text before; all text before the first of them
    is one value.
    """
    text = _trim(_escape(value))
    as_json = F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, "array<string>"))
    is_list = text.rlike(r"(?s)^[\-*•][  ]+\S") & text.rlike(r"\n[\-*•][  ]+") | text.rlike(r"(?s)^[\-*•][  ]+[^\n]*$")
    body = F.when(is_list, F.regexp_replace(text, r"(?m)^[\-*•][  ]+", "")).otherwise(text)
    names = _any_of(known)
    span = _START + f"(?:{_QUOTED})"
    if names:
        span += rf'|["“\'«]?(?:{names})["”\'»]?'
    spans = F.regexp_extract_all(body, F.lit(f"({span})"), 1)
    # One mark for every span; the n-th mark then gets the index n, which no other text can hold.
    marked = F.split(F.regexp_replace(body, span, OPEN), OPEN)
    tagged = F.array_join(
        F.transform(marked, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), x))), ""
    )
    if names:
        # The head (all before the first known name) is kept whole: only its outer delimiters go.
        is_known = F.transform(spans, lambda s: _unquote(_trim(s)).isin(*sorted(set(known))))
        first = F.array_position(is_known, True)
        mark = F.concat(F.lit(OPEN), (first - 1).cast("string"), F.lit(CLOSE))
        where = F.when(first > 0, F.position(mark, tagged)).otherwise(F.length(tagged) + 1)
        head = F.regexp_replace(F.substring(tagged, F.lit(1), where - 1), r"(?U)^[\s|;,]+|(?:[\s|;,]|(?<=\s)[/\-–—])+$", "")
        tail = F.substring(tagged, where, F.length(tagged))
        apart = F.regexp_replace(tail, f"({OPEN}\\d+{CLOSE})", "\n$1\n")
        pieces = F.concat(F.array(head), F.split(apart, f"{HARD}|{SPACED}", -1))
    else:
        pieces = F.split(tagged, f"{HARD}|{SPACED}", -1)

    def restore(piece: Column) -> Column:
        parts = F.split(piece, OPEN)
        back = F.array_join(
            F.transform(
                parts,
                lambda p, i: F.when(i == 0, p).otherwise(
                    F.concat(F.get(spans, F.substring_index(p, CLOSE, 1).cast("int")), F.substring(p, F.length(F.substring_index(p, CLOSE, 1)) + 2, F.length(p)))
                ),
            ),
            "",
        )
        return _unescape(_trim(_unquote(_trim(back))))

    split = F.transform(pieces, restore)
    return F.filter(F.coalesce(F.transform(as_json, lambda x: _unescape(_trim(x))), split), lambda x: x.isNotNull() & (x != ""))


def split_packed(
    df: DataFrame, key: Column, value: Column, field_name: str, known: Sequence[str] = (), least: int = 2
) -> DataFrame:
    """One row ``(field_name, record_key, pos, item)`` for each packed value.

    Fields with fewer than ``least`` values give no row.  A null or blank field
    has no values.  Repeated values keep their own positions; repeated rows
    give repeated output.  Other columns of ``df``, whatever their names, are
    left aside.  Empty input gives an empty result.
    """
    rows = df.select(key.cast("string").alias("record_key"), packed_values(value, known).alias("__items"))
    rows = rows.where(F.size("__items") >= least)
    return rows.select(
        F.lit(field_name).alias("field_name"), "record_key", F.posexplode("__items").alias("__pos", "item")
    ).select("field_name", "record_key", (F.col("__pos") + 1).alias("pos"), "item")
