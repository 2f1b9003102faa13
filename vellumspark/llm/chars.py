"""One consistent form for text that only looks the same (problem 2).

An Arrow string batch is viewed as one numpy array of code points.  Lookup
tables fold widths and blanks and drop invisible signs, words that mix scripts
get their look-alike letters gathered into the Latin script, ligatures grow
through expansion offsets, and combining marks are composed pairwise over the
whole array.  No string method is called for any single row.

Left as they are: quotes, dashes, signs such as m², ½ or °C, words wholly in
another script (Россия), single Greek symbols (β, π, Ω), the place of the tone
mark, and the non-breaking blanks and soft hyphens that are debris of a wrong
encoding (problem 3).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOP = 0x20000
_DROP = 0xFFFFFFFF
# Invisible signs that carry no content.
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, 0x180E, 0x034F)
# Blanks that look like a plain one.
BLANKS = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
# Cyrillic and Greek letters drawn like a Latin one.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "χ": "x", "η": "n", "τ": "t", "ε": "e",
}
# Letters of the list above whose drawing also stands alone with its own meaning, so only a mixed word changes them.
_ONLY_MIXED = set("кмтвнгпαρυκγχητει")


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """The lookup tables, built from rules over the code points."""
    fold = np.arange(_TOP, dtype=np.uint32)
    for c in INVISIBLE:
        fold[c] = _DROP
    for c in BLANKS:
        fold[c] = 0x20
    grow: dict[int, str] = {}
    for c in (*range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), 0x212A, 0x212B):
        to = unicodedata.normalize("NFKC", chr(c))
        if len(to) == 1:
            fold[c] = ord(to)
        else:
            grow[c] = to
    latin, other, look, alone = (np.zeros(_TOP, bool) for _ in range(4))
    for c in range(0x41, 0x1F00):
        if unicodedata.category(chr(c)).startswith("L"):
            latin[c] = c < 0x250 or 0x1E00 <= c < 0x1F00
            other[c] = 0x370 <= c < 0x530
    for c in range(0xFF21, 0xFF5B):
        latin[c] = unicodedata.category(chr(c)).startswith("L")
    to_latin = np.arange(_TOP, dtype=np.uint32)
    for a, b in LOOK_ALIKE.items():
        look[ord(a)] = True
        alone[ord(a)] = a not in _ONLY_MIXED
        to_latin[ord(a)] = ord(b)
    mark = np.zeros(_TOP, np.uint8)
    for c in range(0x300, 0x370):
        mark[c] = max(1, unicodedata.combining(chr(c)))
    pairs: dict[int, int] = {}
    marks = list(range(0x300, 0x334))
    for base in [*range(0x41, 0x250), *range(0x1E00, 0x1F00)]:
        if unicodedata.category(chr(base)).startswith("L"):
            for m in marks:
                one = unicodedata.normalize("NFC", chr(base) + chr(m))
                if len(one) == 1:
                    pairs[base << 16 | m] = ord(one)
    keys = np.array(sorted(pairs), np.uint64)
    grown = np.ones(_TOP, np.int64)
    for c, to in grow.items():
        grown[c] = len(to)
    return {
        "fold": fold, "latin": latin, "other": other, "look": look, "alone": alone, "to_latin": to_latin, "mark": mark,
        "pair_key": keys, "pair_to": np.array([pairs[int(k)] for k in keys], np.uint32), "grown": grown,
        "grow_from": np.array(sorted(grow), np.uint32), "grow_to": np.array([[ord(x) for x in grow[c].ljust(4, "\0")[:4]] for c in sorted(grow)], np.uint32).reshape(-1, 4),
    }


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows as one array, and the row bounds in it (nulls are empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    starts = (raw & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(starts)])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, count[offsets - offsets[0]] if len(texts) else np.zeros(1, np.int64)


#: Bytes of text that a worker handles at once; longer single texts are still handled whole.
SLICE_BYTES = 1_500_000


def slices(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in ``columns`` stay below SLICE_BYTES: bounds the arrays built from them."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += np.diff(_offsets(batch.column(c))) if batch.num_rows else 0
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows:
            yield batch.slice(start)


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = texts.type in (pa.large_string(), pa.large_binary())
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def to_strings(points: np.ndarray, bounds: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The reverse of ``code_points``: one encoding call for the batch, offsets by cumulated byte widths."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(width)])[bounds].astype(np.int64)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data), bits)


def _debris(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Blanks and soft hyphens that a wrong encoding left: they are letters of a garbled text."""
    out = (p == 0xA0) | (p == 0xAD)
    if not out.any():
        return out
    prev, prev2, after = np.roll(p, 1), np.roll(p, 2), np.roll(p, -1)
    prev[:1], prev2[:2], after[-1:] = 0, 0, 0
    # UTF-8 read byte by byte: the blank or hyphen follows a lead or a middle byte.
    utf8 = np.isin(prev, [0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0x102, 0xBA, 0xBB, 0xB9, 0x20AC])
    capital = lambda x: ((x >= 0x41) & (x <= 0x5A)) | (x == 0x110) | ((x >= 0x30) & (x <= 0x39))
    utf8 &= ~((p == 0xA0) & np.isin(prev, [0xC2, 0xC3, 0x102]) & capital(prev2) & (capital(after) | ((after >= 0x1EA0) & (after < 0x1F00) & (after % 2 == 0))))
    # A one-byte Vietnamese font: a row dotted with signs after plain letters uses these codes as letters, too.
    sign = (((p >= 0xA8) & (p <= 0xBE)) | np.isin(p, [0xDE, 0xD7, 0xD8, 0xDF, 0xF7])) & ~np.isin(p, [0xAB, 0xAC, 0xAD, 0xB0, 0xB1, 0xB2, 0xB3, 0xBB, 0xBD])
    letter = (prev >= 0x61) & (prev <= 0x7A)
    barred = (p == 0xAE) & (after >= 0x61) & (((after <= 0x7A)) | (after > 0xA0))
    font = np.bincount(row, weights=(sign & letter) + 2.0 * barred, minlength=rows) >= 2
    return out & (utf8 | font[row])


def normalise(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent forms of a batch, and a mask of the rows that had to change."""
    t = _tables()
    n = len(texts)
    p, bounds = code_points(texts)
    valid = np.asarray(texts.is_valid()) if n else np.empty(0, bool)
    size = np.diff(bounds)
    row = np.repeat(np.arange(n), size)
    safe = np.minimum(p, _TOP - 1)
    touched = np.zeros(n, bool)
    if not len(p) or int(p.max()) < 0x80:
        return to_strings(p, bounds, valid), touched
    keep_as_is = _debris(p, row, n)
    q = np.where((p < _TOP) & ~keep_as_is, t["fold"][safe], p).astype(np.uint32)
    # Look-alikes: words are runs of letters and marks within a row (invisible signs don't part them).
    foreign = t["other"][safe] & (p < _TOP)
    if foreign.any():
        inside = t["latin"][safe] | foreign | (t["mark"][safe] > 0) | (q == _DROP)
        first = inside & ~(np.roll(inside, 1) & (np.roll(row, 1) == row))
        if inside[0]:
            first[0] = True
        word = np.cumsum(first)
        k = int(word[-1]) + 1
        mixed = np.bincount(word[inside & t["latin"][safe]], minlength=k) > 0
        strange = np.bincount(word[foreign & ~t["look"][safe]], minlength=k) > 0
        only = np.bincount(word[foreign & ~t["alone"][safe]], minlength=k) > 0
        change = foreign & t["look"][safe] & ((mixed[word] & ~(strange[word])) | (~mixed[word] & ~strange[word] & ~only[word]))
        q = np.where(change, t["to_latin"][safe], q).astype(np.uint32)
    # Eth at the start of a clean word stands for the barred D.
    eth = p == 0xD0
    if eth.any():
        prev, after = np.roll(safe, 1), np.roll(np.minimum(q, _TOP - 1), -1)
        start = ~t["latin"][prev] | (np.roll(row, 1) != row)
        q[eth & start & ((t["latin"][after] & ~((after >= 0xC0) & (after < 0xC8))) & (np.roll(row, -1) == row))] = 0x110
    touched |= np.bincount(row[q != p], minlength=n) > 0
    # Expansion: each code point takes as many places as its form has letters.
    grown = t["grown"][np.minimum(q, _TOP - 1)]
    grown[q == _DROP] = 0
    if (grown != 1).any():
        at = np.repeat(np.arange(len(q)), grown)
        step = np.arange(len(at)) - np.repeat(np.cumsum(grown) - grown, grown)
        more = grown[at] > 1
        r = q[at]
        if more.any():
            r[more] = t["grow_to"][np.searchsorted(t["grow_from"], r[more]), step[more]]
            touched |= np.bincount(row[at][more], minlength=n) > 0
        q, row = r.astype(np.uint32), row[at]
    # Composition: marks join the letter before them, nearest first; a mark that finds no composed form stays.
    mark = (t["mark"][np.minimum(q, _TOP - 1)] > 0) & (q < _TOP)
    while mark.any():
        at = np.flatnonzero(mark)
        at = at[(at > 0)]
        at = at[~mark[at - 1] & (row[at - 1] == row[at])]
        if not len(at):
            break
        key = q[at - 1].astype(np.uint64) << np.uint64(16) | q[at].astype(np.uint64)
        k = np.minimum(np.searchsorted(t["pair_key"], key), len(t["pair_key"]) - 1)
        hit = t["pair_key"][k] == key
        mark[at[~hit]] = False  # blocked: it takes the part of a letter
        if hit.any():
            q[at[hit] - 1] = t["pair_to"][k[hit]]
            touched |= np.bincount(row[at[hit]], minlength=n) > 0
            rest = np.ones(len(q), bool)
            rest[at[hit]] = False
            q, row, mark = q[rest], row[rest], mark[rest]
    out = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)
    return to_strings(q, out, valid), touched


def consistent(df: DataFrame, key: str, fields: dict[str, str], only_changed: bool = False) -> DataFrame:
    """Rows ``(field_name, record_id, text, changed)`` for the columns in ``fields`` (column: name to report).

    A null text stays null and unchanged, an empty one empty; texts of any length are handled whole; repeated
    rows give repeated output; other columns, whatever their names, are left aside.
    """
    names = list(fields)
    rows = df.select(F.col(key).cast("long").alias("__id"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(names)])
    labels = [fields[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, *range(1, len(labels) + 1)):
            for i, label in enumerate(labels):
                text, changed = normalise(batch.column(i + 1))
                out = pa.RecordBatch.from_arrays(
                    [pa.array([label]).take(pa.array(np.zeros(len(text), np.int32))), batch.column(0), text.cast(pa.string()), pa.array(changed)],
                    names=["field_name", "record_id", "text", "changed"],
                )
                yield out.filter(pa.array(changed)) if only_changed else out

    return rows.mapInArrow(run, "field_name string, record_id long, text string, changed boolean")
