"""Text garbled by a wrong encoding (problem 3).

A wrong code page turns each letter into a symbol: one sign, a vowel with a
trailing sign, or the two to four characters of a multi-byte letter.  That is a
substitution cipher whose plain ASCII letters stayed in place.  Records are
grouped into sources by the shape of their symbols; for every source the
symbol-to-letter mapping is learned by expectation-maximisation against the
letter bigrams of the clean records, and applied with ``translate``.

Two narrow passes over the texts, no shuffle of texts: the first counts symbol
pairs (their number is bounded by the alphabets, combined on the map side), the
second maps.  Only the pair counts reach the driver.

No code page is taken for granted.  For multi-byte symbols the learned mapping
tells which of all known single-byte code pages a source was read in: the one
whose bytes spell the letters that the mapping holds likely.  The bytes then
check and complete the mapping for symbols that are too rare to be learned; a
source that agrees with no page keeps what was learned, and one of which
nothing was learned is not reported.  Where one byte was lost (U+FFFD in its
place), the letters that the other bytes allow are weighed by the learned
bigrams with both neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import code_points, slices

# The vowels of Vietnamese with their marks and tones, and the barred d.
_VOWELS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
# Signs that clean texts hold besides letters.
_SIGNS = "“”‘’–—…•£€¥°²½±"
#: Foreign letters that the exact check accepts besides the alphabet.
_FOREIGN = set("ÅåÇçÃãâäöüñÑëïîûøØæœßµ¬·Ωβπ") | {chr(c) for c in range(0x410, 0x450)}
LETTERS = [chr(c) for c in range(0x21, 0x7F)] + list(_VOWELS + _VOWELS.upper()) + list(_SIGNS)
SPACE, OTHER = len(LETTERS), len(LETTERS) + 1
N_LETTERS = len(LETTERS) + 2
CLEAN = set(LETTERS) | set(" \n\r\t")
#: Symbols rarer than this share of a source's symbols are left to the exact check; it bounds the mapping.
LEAST_SHARE = 1e-4
#: A symbol counts as known when the learned mapping gives its letter at least this probability.
SURE = 0.5
EM_ROUNDS = 60
_PLACE = {c: i for i, c in enumerate(LETTERS)}
#: Key of the pages that were recognised, by source, among the mappings.
PAGE = "\1page"
#: Symbols of a text from which on its symbols are learned from; texts with fewer are mapped all the same.
LEARN_LEAST = 3
#: So many times a symbol must be seen on average for a mapping to stand without a page that agrees.
LEARN_TIMES = 10
#: Neighbours that clean texts hold with this probability are no symbol of a source without a page.
NATURAL = 1e-3
#: A source was read in the page whose letters the mapping holds so likely, by the mean over its symbols.
AGREES = 0.15
#: Where no known page covers so much of a text's odd runs, they are parted at the characters that begin runs.
COVERED = 0.7
#: Characters in odd runs that a text must hold for that.
ODD_LEAST = 20
RUNS = "runs:"
#: Texts of equal shape under several pages go to the first: the more usual ones lead, which decides nothing else.
USUAL = ("cp1252", "cp1258", "cp437", "mac_roman", "cp850")
LOST = "�"
# The bytes that cp1252 or cp1258 leaves undefined.
_UNDEFINED = (0x81, 0x8A, 0x8D, 0x8E, 0x8F, 0x90, 0x9A, 0x9D, 0x9E, 0x9F)


@lru_cache(maxsize=1)
def _readings() -> dict[str, tuple[dict[str, int], re.Pattern]]:
    """For each single-byte code page that keeps ASCII: character to byte (undefined bytes stand for themselves) and the multi-byte pattern."""
    out: dict[str, tuple[dict[str, int], re.Pattern]] = {}
    seen = set()
    for page in [*USUAL, *sorted(set(aliases.values()) - set(USUAL))]:
        byte = {}
        try:
            plain = bytes(range(0x20, 0x7F))
            if plain.decode(page) != plain.decode("ascii") or len(bytes([0x61] * 3).decode(page)) != 3:
                continue
            for b in range(0x80, 0x100):
                try:
                    letter = bytes([b]).decode(page)
                except UnicodeDecodeError:
                    letter = chr(b)
                byte[letter] = b
        except (LookupError, UnicodeError, ValueError):
            continue  # no text encoding
        if len(byte) < 100 or sum(ord(c) == b for c, b in byte.items()) > 120 and page not in USUAL:
            continue  # a multi-byte encoding, or Latin-1, which cp1252 with its control codes holds
        if page.startswith("cp12"):
            byte |= {chr(b): b for b in range(0x80, 0xA0)}  # control codes that readers leave in place
        if (key := tuple(sorted(byte.items()))) in seen:
            continue
        seen.add(key)
        span = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in byte.items() if lo <= b <= hi) + "]"  # noqa: E731,B023
        cont = span(0x80, 0xBF)
        out[page] = byte, re.compile(f"{span(0xC2, 0xDF)}{cont}|{span(0xE0, 0xEF)}{cont}{{2}}|{span(0xF0, 0xF4)}{cont}{{3}}")
    return out


@lru_cache(maxsize=1)
def _roles() -> np.ndarray:
    """By page and code point: 1 for a byte that goes on a letter, 2 and 3 for one that begins a letter of so many bytes."""
    out = np.zeros((len(_readings()), 0x3000), np.uint8)
    for k, (byte, _) in enumerate(_readings().values()):
        for c, b in byte.items():
            if ord(c) < 0x3000:
                out[k, ord(c)] = 1 if b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 0
    return out


def _pages_of(text: str) -> list[str]:
    """The pages under which most characters of a text have the shape of multi-byte letters; the usual ones first."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(points > 0x7E)
    if len(at) < 2:
        return []
    role = _roles()[:, np.minimum(points[at], 0x2FFF)]
    role[:, points[at] >= 0x3000] = 0
    one = np.diff(at) == 1
    goes_on = (role[:, 1:] == 1) & one
    covered = 2 * ((role[:, :-1] == 2) & goes_on).sum(1)
    if len(at) > 2:
        covered = covered + 3 * ((role[:, :-2] == 3) & goes_on[:, :-1] & goes_on[:, 1:]).sum(1)
    return [page for page, n in zip(_readings(), covered, strict=True) if n and n == covered.max()]


_MARKS = "ùøûõïâáàåãäêéèúüëÙØÛÕÏÂÁÀÅÃÄÊÉÈÚÜË"
#: Fonts that write a vowel and then its mark, or a sign for each letter.
_VOWEL_MARK = re.compile(f"[aeiouyAEIOUYöôÖÔ][{_MARKS}]|[ñÑöÖôÔíÍìÌóÓòÒæÆîÎ]")
_SIGN_FONT = re.compile("[¡-ÿ]")
# Vowel and mark pairs that no clean text writes.
_MARKED = {"aA": "áàãåäâéèêëùøûõïÁÀÃÅÄÂÉÈÊËÙØÛÕÏ", "eE": "áàãåäâùøûõïÁÀÃÅÄÂÙØÛÕÏ", "oO": "äåâùøûõïÄÅÂÙØÛÕÏ", "uUyY": "ùøûõïÙØÛÕÏ", "ôÔöÖ": "ùøûõïÙØÛÕÏ"}
#: Words that only such a font writes.
_STRONG_MARK = re.compile("|".join(f"[{v}][{m}]" for v, m in _MARKED.items()) + r"|(?<![^\W\d_])[ñÑ](?=[aeiouyöôùò])|[a-zñ]ö")
_STRONG_SIGN = re.compile(r"[a-zA-Z](?:[¡-©ª«®¯µ-¹»¼¾×ÞßØÜ÷]|¬(?![\r\n]))|®(?=[a-zµ-ÿ¨-¾])|[a-z]\xad(?=[íîëìéêèç])|[bcdfghklmnpqrstvx][ñëåçøûüäÞß÷×]|[a-z][ÈÉÊËÇÒÓÕÖÆÐÝØÑ]")
_LOSS = re.compile(r"\w\?+\w|(?<![^\s(“])\?+[^\W\d]|\w\?\?|\?\?\w")
_ODD_RUN = re.compile(f"[^\x00-\x7e{LOST}]{{2,}}")
_ODD_SIGN = re.compile("[" + re.escape("".join(chr(c) for c in range(0x80, 0x3000) if chr(c) not in CLEAN and not chr(c).isalnum() and unicodedata.category(chr(c)) not in ("Mn", "Cf", "Zs", "Cn"))) + "]")


@lru_cache(maxsize=1)
def _torn() -> dict[str, re.Pattern]:
    """For the code pages with undefined bytes: the pattern of a multi-byte letter one byte of which was lost."""
    out = {}
    for page in ("cp1252", "cp1258"):
        byte = _readings()[page][0]
        span = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in byte.items() if lo <= b <= hi) + "]"  # noqa: E731,B023
        cont = span(0x80, 0xBF)
        out[page] = re.compile(f"{span(0xC2, 0xDF)}{LOST}|{span(0xE0, 0xEF)}(?:{cont}{LOST}|{LOST}{cont})")
    return out


@lru_cache(maxsize=4096)
def torn_letters(symbol: str, page: str) -> tuple[str, ...]:
    """The letters of the alphabet that ``symbol`` may show: U+FFFD stands for a byte that the code pages leave undefined."""
    if page not in _torn() or symbol.count(LOST) != 1:
        return ()
    found = set()
    for b in _UNDEFINED:
        try:
            letter = bytes(b if c == LOST else _readings()[page][0][c] for c in symbol).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if letter in _VOWELS or letter in _VOWELS.upper():
            found.add(letter)
    return tuple(sorted(found))


def exact(symbol: str, page: str) -> str | None:
    """The letter whose UTF-8 bytes ``symbol`` shows under ``page``, if it is a plausible one."""
    try:
        letter = bytes(_readings()[page][0][c] for c in symbol).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return letter


def _plausible(letter: str | None) -> bool:
    """Letters, marks and signs that a text may hold; control codes, too, as they are bytes of a twice-garbled letter."""
    if letter is None or len(letter) != 1:
        return False
    c = ord(letter)
    return letter in CLEAN or letter in _FOREIGN or 0x80 <= c <= 0xFF or c in (0x300, 0x301, 0x303, 0x309, 0x31B, 0x323) or 0x2000 <= c <= 0x206F or 0xFF01 <= c <= 0xFF5E or c == 0xFEFF or c in (0x192, 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x2C6, 0x2DC, 0x2122, 0x201A, 0x20AC)


def _runs(text: str) -> tuple[str, list[tuple[int, int]]] | None:
    """Symbols of a text read in a page that nobody lists: pieces of its odd runs, parted before characters that begin runs.

    A character that begins a letter never goes on with one, under any page; so those that stand first in some run part the others.
    """
    runs = [m for m in _ODD_RUN.finditer(text) if _ODD_SIGN.search(m.group())]
    if sum(len(m.group()) for m in runs) < ODD_LEAST:
        return None
    begin = Counter(m.group()[0] for m in runs)
    first = {c for c, n in begin.items() if n > 1}
    spans = []
    for m in runs:
        at = m.start()
        for k in range(m.start() + 1, m.end()):
            if text[k] in first:
                spans.append((at, k))
                at = k
        spans.append((at, m.end()))
    return RUNS + begin.most_common(1)[0][0], [(a, b) for a, b in spans if b - a > 1]


def _reach_back(text: str, start: int, symbol: re.Pattern, most: int = 3) -> int:
    """The begin of the words just before ``start`` that hold a symbol, too."""
    for _ in range(most):
        end = start - 1
        begin = max(text.rfind(" ", 0, max(end, 0)), text.rfind("\n", 0, max(end, 0))) + 1
        if end <= 0 or not symbol.search(text, begin, end):
            break
        start = begin
    return start


def sources_of(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """The sources (shapes of symbols) that a text may come from and the spans of their symbols, those that cover most first.

    Texts read in a wrong page hold characters in the shape of multi-byte letters: one that begins a letter before those that go
    on with it, whatever they spell; the page that covers most names the source, which says nothing yet about the true page.
    In such a text symbols with a lost byte and capitals that look like one before a real sign belong to them.
    Font texts must hold at least two words that no clean text writes; their symbols lie between the
    first and the last such word.  Texts with lost letters hold replacement or question marks inside words.
    """
    best: tuple[str, list[tuple[int, int]]] | None = None
    for page in _pages_of(text)[:1]:
        spans, doubtful = [], []
        for m in _readings()[page][1].finditer(text):
            s = m.group()
            letter = exact(s, page)
            a, b = m.span()
            if " " in s and len(s) == 2 and a and text[a - 1].isupper() and text[b : b + 1].isupper():
                continue  # a capital before a real non-breaking blank
            if s[0] in _VOWELS.upper() and s[1] in "“”‘’–—…•" and ((a and text[a - 1].isupper()) or (letter not in CLEAN and not text[b : b + 1].isalpha())):
                if letter in CLEAN and letter.isupper() and text[b : b + 1].isalpha():
                    doubtful.append((a, b))
                continue  # a capital before a real sign
            spans.append((a, b))
        if spans:
            if LOST in text and page in _torn():
                doubtful += [m.span() for m in _torn()[page].finditer(text) if torn_letters(m.group(), page)]
            spans = sorted(spans + doubtful)
        if spans and (best is None or len(spans) > len(best[1])):
            best = page, spans
    found = [best] if best else []
    runs = _runs(text)
    if runs and (not best or sum(b - a for a, b in best[1]) < COVERED * sum(b - a for a, b in runs[1])):
        found.append(runs)
    if LOST in text:
        found.append(("lost", [m.span() for m in re.finditer(LOST, text)]))
    fonts = [("sign", [m.span() for m in _STRONG_SIGN.finditer(text)], _SIGN_FONT), ("mark", [m.span() for m in _STRONG_MARK.finditer(text)], _VOWEL_MARK)]
    for name, words, symbol in sorted(fonts, key=lambda f: -len(f[1]))[:1]:
        if len(words) >= 2:
            a = max(text.rfind(" ", 0, words[0][0]), text.rfind("\n", 0, words[0][0])) + 1
            b = words[-1][1]
            while b < len(text) and not text[b].isspace():
                b += 1
            a = _reach_back(text, a, symbol)
            found.append((name, [m.span() for m in symbol.finditer(text, a, b)]))
    hits = list(_LOSS.finditer(text)) if "?" in text else []
    if len(hits) >= 2:
        found.append(("lost", [(m.start() + k, m.start() + k + 1) for m in hits for k, c in enumerate(m.group()) if c == "?"]))
    return sorted(found, key=lambda f: -sum(b - a for a, b in f[1]))


def source_of(text: str) -> tuple[str, list[tuple[int, int]]] | None:
    """The source that most symbols of a text speak for, and their spans; None for a clean text."""
    found = sources_of(text)
    return found[0] if found else None


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.int32)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i
    for c in (*range(0x21), 0x7F):
        table[c] = SPACE
    return table


@lru_cache(maxsize=1)
def _watch() -> tuple[np.ndarray, ...]:
    """Tables for ``suspicious``: odd code points, signs, lead letters, vowels and the vowels each mark is odd after."""
    odd = np.ones(0x3000, bool)
    odd[[ord(c) for c in CLEAN]] = False
    odd[:0x21] = False
    odd[0x300:0x530] = False  # look-alike letters and marks are problem 2
    odd[0x2000:0x2010] = odd[0x2028:0x2030] = odd[0x205F:0x2070] = False
    odd[[0xA0, 0xAD, 0xAC, 0xB5, 0xC5, 0xC7, 0xD0, 0xF0, 0xE7, 0xE5]] = False
    sign = np.zeros(0x3000, bool)
    sign[[ord(c) for c in "£€¥°²½±µ¬\xa0\xad“”‘’–—…•"]] = True
    lead = np.zeros(0x3000, bool)
    lead[[ord(c) for c in "ÂÃÄÅÆĂâÅ"]] = True
    vowel, after = np.zeros(0x3000, np.uint8), np.zeros(0x3000, np.uint8)
    for k, (v, marks) in enumerate(_MARKED.items()):
        for c in v:
            vowel[ord(c)] |= 1 << k
        for c in marks:
            after[ord(c)] |= 1 << k
    return odd, sign, lead, vowel, after


def suspicious(texts: pa.Array) -> np.ndarray:
    """Mask of the rows worth a closer look, found on the code points of the whole batch at once.

    It passes every row that ``source_of`` can take: odd code points, signs behind a lead letter, vowels with a
    mark that no clean text writes, or two question marks.
    """
    points, bounds = code_points(texts)
    odd, sign, lead, vowel, after = _watch()
    at = np.flatnonzero(points > 0x7E)  # every case shows in a sign beyond ASCII, but for question marks
    here = points[at]
    low = np.minimum(here, 0x2FFF)
    before = np.minimum(points[np.maximum(at - 1, 0)], 0x2FFF)
    hit = odd[low] & (here < 0xFF00) | (here == 0xFFFD)
    hit |= (lead[before] & sign[low]) | ((vowel[before] & after[low]) > 0) | ((here == 0xAC) & (before > 0x60) & (before < 0x7B))
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(bounds, at[hit], side="right") - 1] = True
    asked = np.searchsorted(bounds, np.flatnonzero(points == 0x3F), side="right") - 1
    return out | (np.bincount(asked, minlength=len(texts)) > 1)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring symbols by source; '' is the source of clean texts."""
    clean = np.zeros(N_LETTERS * N_LETTERS, np.int64)
    table = _letter_table()
    garbled: Counter = Counter()
    for batch in slices(batches, 0):
        texts = batch.column(0)
        bad = np.zeros(len(texts), bool)
        look = np.flatnonzero(suspicious(texts))
        for i, text in zip(look, texts.take(pa.array(look)).to_pylist(), strict=True):
            found = source_of(text) if text else None
            if found:
                bad[i] = True
                if found[0] in _readings() and len(found[1]) < LEARN_LEAST:
                    continue
                seq, at = [], 0
                for a, b in found[1]:
                    seq += text[at:a]
                    seq.append(("\0" + text[a:b]))
                    at = b
                seq += text[at:]
                name = found[0]
                for x, y in zip([" ", *seq], [*seq, " "], strict=True):
                    if x[0] == "\0" or y[0] == "\0":
                        garbled[name, x, y] += 1
        points, bounds = code_points(texts)
        ids = table[np.minimum(points, 0x2FFF)]
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        if len(ids):
            same = (row[1:] == row[:-1]) & ~bad[row[1:]]
            clean += np.bincount((ids[:-1] * N_LETTERS + ids[1:])[same], minlength=len(clean))
    at = np.flatnonzero(clean)
    name = lambda i: LETTERS[i] if i < SPACE else (" " if i == SPACE else "\1")
    rows = [("", name(k // N_LETTERS), name(k % N_LETTERS), int(clean[k])) for k in at] + [(*k, n) for k, n in garbled.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["source", "a", "b", "n"])


def pair_counts(texts: DataFrame) -> DataFrame:
    """``(source, a, b, n)`` over one text column: counts of neighbouring symbols, over all rows."""
    return texts.mapInArrow(_pairs, "source string, a string, b string, n long").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))


def learn(counts: list[tuple[str, str, str, int]]) -> dict[str, dict[str, tuple[str, float]]]:
    """For every source: symbol to (letter, probability), by expectation-maximisation.

    The model draws a pair of letters from the language's bigrams and shows each letter as a symbol; plain
    letters show as themselves.  Emission probabilities of the other letters are re-estimated until they settle.
    """
    index = {c: i for i, c in enumerate(LETTERS)} | {" ": SPACE, "\n": SPACE, "\r": SPACE, "\t": SPACE}
    bigram = np.full((N_LETTERS, N_LETTERS), 1e-3)
    for s, a, b, n in counts:
        if s == "":
            bigram[index.get(a, OTHER), index.get(b, OTHER)] += n
    bigram /= bigram.sum()
    prior = bigram.sum(1)
    hidden = np.array([ord(c) > 0x7E for c in LETTERS] + [False, False])
    out: dict[str, dict[str, tuple[str, float]]] = {}
    after = np.log(bigram / bigram.sum(1, keepdims=True))
    out[""] = {(LETTERS[i] if i < SPACE else " "): (after[i].tolist(), 0.0) for i in range(SPACE + 1)}  # type: ignore[misc]  # rows of log probabilities
    out[PAGE] = {}
    for source in sorted({s for s, *_ in counts} - {"", "lost"}):
        own = [(a, b, n) for s, a, b, n in counts if s == source]
        total = Counter()
        for a, b, n in own:
            for x in (a, b):
                if x[0] == "\0":
                    total[x] += n
        least = sum(total.values()) * LEAST_SHARE
        symbols = sorted(x for x, n in total.items() if n >= least)
        if not symbols:
            continue
        place = {x: N_LETTERS + i for i, x in enumerate(symbols)}
        size = N_LETTERS + len(symbols)
        cells: Counter = Counter()
        for a, b, n in own:
            i = place.get(a, OTHER) if a[0] == "\0" else index.get(a, OTHER)
            j = place.get(b, OTHER) if b[0] == "\0" else index.get(b, OTHER)
            cells[i, j] += n
        i, j = np.array(sorted(cells)).T
        seen = np.array([cells[x] for x in zip(i.tolist(), j.tolist(), strict=True)], float)
        emit = np.zeros((size, N_LETTERS))
        emit[np.arange(N_LETTERS), np.arange(N_LETTERS)] = 1.0
        weight = np.array([total[x] for x in symbols], float)
        emit[np.ix_(np.arange(N_LETTERS, size), np.flatnonzero(hidden))] = (weight / weight.sum())[:, None]
        emit /= emit.sum(0)
        by_j = np.argsort(j, kind="stable")
        left, right = np.flatnonzero(np.diff(i, prepend=-1)), np.flatnonzero(np.diff(j[by_j], prepend=-1))
        for _ in range(EM_ROUNDS):
            before, behind = emit @ bigram, emit @ bigram.T
            ratio = (seen / np.maximum((before[i] * emit[j]).sum(1), 1e-12))[:, None]
            new = np.zeros_like(emit)
            new[i[left]] += np.add.reduceat(ratio * behind[j], left)
            new[j[by_j][right]] += np.add.reduceat((ratio * before[i])[by_j], right)
            fresh = (emit * new)[:, hidden]
            emit[:, hidden] = fresh / np.maximum(fresh.sum(0), 1e-300)
        joint = emit[N_LETTERS:] * prior
        share = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        best = share.argmax(1)
        out[source] = {x[1:]: (LETTERS[k] if k < SPACE else " ", float(share[i, k])) for i, (x, k) in enumerate(zip(symbols, best, strict=True))}
        if source in _readings() or source.startswith(RUNS):
            if weight.sum() < LEARN_TIMES * len(symbols):  # so little can't tell letters; a page may still agree
                out[source] = {}
            held = max(((_agreement(symbols, share, weight, page), -n, page) for n, page in enumerate(_readings())), default=(0.0, 0, ""))
            if held[0] >= AGREES:
                out[PAGE][source] = held[2], held[0]
    return out


def _agreement(symbols: list[str], share: np.ndarray, weight: np.ndarray, page: str) -> float:
    """How likely the learned mapping holds the letters that the symbols spell under ``page``, by the mean over the symbols."""
    total = 0.0
    for i, x in enumerate(symbols):
        k = _PLACE.get(exact(x[1:], page) or "")
        total += weight[i] * share[i, k] if k is not None else 0.0
    return total / weight.sum()


def mapping(*texts: DataFrame) -> dict[str, dict[str, tuple[str, float]]]:
    """Learned mappings from all rows of one-column DataFrames."""
    counts = texts[0]
    for more in texts[1:]:
        counts = counts.unionAll(more)
    # Bounded by the alphabets: at most (letters + symbols) squared pairs a source.
    return learn([tuple(r) for r in pair_counts(counts).collect()])


#: A word between garbled ones stays as it is only where its letters are likelier by so much (log, per letter).
_MARGIN = 0.5


def _by_word(marked: str, to: dict[int, str], back: dict[str, str], after: dict[str, tuple[list[float], float]], strong: re.Pattern) -> str:
    """Maps the words that only the font writes and those that don't get much less likely by it."""
    keep = {ord(k): v for k, v in back.items()}
    out = []
    for word in re.split(r"(\s+)", marked):
        new = word.translate(to)
        old = word.translate(keep)
        if new != old and after and not strong.search(old):
            score = lambda w: sum(after[a if a in after else " "][0][_PLACE.get(b, OTHER)] for a, b in zip(" " + w, w, strict=False)) / (len(w) + 1)
            new = new if score(new) > score(old) - _MARGIN else old
        out.append(new)
    return "".join(out)


def _by_neighbours(marked: str, unsure: dict[str, tuple[str, ...]], after: dict[str, tuple[list[float], float]]) -> str:
    """Sets each stand-in in ``unsure`` to its likeliest letter between its neighbours; one below SURE stays."""
    out = list(marked)
    for i, c in enumerate(out):
        if c not in unsure:
            continue
        left = out[i - 1] if i else " "
        right = out[i + 1] if i + 1 < len(out) else " "
        log = lambda a, b: after[a if a in after else " "][0][SPACE if b.isspace() else _PLACE.get(b, OTHER)]
        score = np.array([log(left, x) + (0.0 if right in unsure else log(x, right)) for x in unsure[c]])
        share = np.exp(score - score.max())
        if share.max() >= SURE * share.sum():
            out[i] = unsure[c][int(share.argmax())]
    return "".join(out)


def restore(text: str, maps: dict[str, dict[str, tuple[str, float]]]) -> tuple[str | None, str, bool] | None:
    """(restored text, source, whole): None for a clean text.

    The symbols of the source are given one stand-in character each and mapped with ``translate``.  ``whole`` is
    false where a symbol has no sure letter; such symbols stay as they are.  A symbol with a lost byte takes the letter
    that its bytes and neighbours leave, and counts as sure only where the bytes leave one.  Twice-garbled texts are restored twice.
    """
    for source, spans in sources_of(text):
        done = _restored(text, source, spans, maps)
        if done:
            return done
    return None


def _natural(symbol: str, after: dict[str, tuple[list[float], float]]) -> bool:
    """Whether clean texts hold the characters of a symbol one behind the other."""
    return all(after[a][0][_PLACE.get(b, OTHER)] >= np.log(NATURAL) if a in after else False for a, b in zip(symbol, symbol[1:], strict=False))


def _restored(text: str, source: str, spans: list[tuple[int, int]], maps: dict[str, dict[str, tuple[str, float]]]) -> tuple[str, str, bool] | None:
    """``restore`` for one source; None where nothing was learned for its symbols."""
    if source == "lost":
        return text, source, False
    learned = maps.get(source, {})
    page = maps.get(PAGE, {}).get(source, ("", 0.0))[0]  # recognised by the learned mapping
    spelt = lambda s: _plausible(exact(s, page)) or (LOST in s and bool(torn_letters(s, page))) if page else learned.get(s, ("", 0.0))[1] >= SURE and not _natural(s, maps.get("", {}))
    if source in _readings() or source.startswith(RUNS):
        spans = [(a, b) for a, b in spans if spelt(text[a:b])]
        if not any(LOST not in text[a:b] for a, b in spans):
            return None
    elif not any(learned.get(text[a:b], ("", 0.0))[1] >= SURE for a, b in spans):
        return None
    stand_in: dict[str, str] = {}
    to: dict[int, str] = {}
    unsure: dict[str, tuple[str, ...]] = {}
    whole = text.count(LOST) == sum(LOST in text[a:b] for a, b in spans)
    parts, at = [], 0
    for a, b in spans:
        s = text[a:b]
        if s not in stand_in:
            stand_in[s] = chr(0xF0000 + len(stand_in))
            letter = exact(s, page) if page else None  # the check of the bytes
            torn = torn_letters(s, page) if LOST in s and page else ()
            if len(torn) == 1:
                letter = torn[0]
            elif torn:
                unsure[stand_in[s]], letter, whole = torn, stand_in[s], False
            elif not _plausible(letter):
                letter, sure = learned.get(s, (s, 0.0))
                if sure < SURE:
                    letter, whole = s, False
            to[ord(stand_in[s])] = letter
        parts += [text[at:a], stand_in[s]]
        at = b
    marked = "".join(parts) + text[at:]
    if source in ("mark", "sign"):
        fixed = _by_word(marked, to, {v: k for k, v in stand_in.items()}, maps.get("", {}), _STRONG_MARK if source == "mark" else _STRONG_SIGN)
    else:
        fixed = marked.translate(to)
    if unsure:
        fixed = _by_neighbours(fixed, unsure, maps[""]) if "" in maps else fixed
        fixed = fixed.translate({ord(c): s for s, c in stand_in.items() if c in unsure})
    if source in _readings() and fixed != text:
        again = source_of(fixed)
        if again and again[0] in _readings():
            deeper = restore(fixed, maps)
            if deeper:
                return deeper[0], source, whole and deeper[2]
    return fixed, source, whole


def repaired(df: DataFrame, key: str, fields: dict[str, str], maps: dict[str, dict[str, tuple[str, float]]], only_found: bool = True) -> DataFrame:
    """Rows ``(field_name, record_id, source, text, whole)`` of the garbled values in ``fields`` (column: name).

    With ``only_found=False`` clean values come, too, with a null source.  Null and empty texts are clean; texts
    are handled whole; repeated rows give repeated output; extra columns are left aside.
    """
    names = list(fields)
    labels = [fields[c] for c in names]
    rows = df.select(F.col(key).cast("long").alias("__id"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(names)])
    shared = df.sparkSession.sparkContext.broadcast(maps)  # bounded: see LEAST_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, *range(1, len(labels) + 1)):
            for i, label in enumerate(labels):
                texts = batch.column(i + 1)
                look = np.flatnonzero(suspicious(texts))
                out = []
                ids = batch.column(0).take(pa.array(look)).to_pylist()
                for rid, text in zip(ids, texts.take(pa.array(look)).to_pylist(), strict=True):
                    hit = restore(text, shared.value) if text else None
                    if hit:
                        out.append((label, rid, hit[1], hit[0], hit[2]))
                    elif not only_found:
                        out.append((label, rid, None, text, True))
                if not only_found:
                    rest = np.setdiff1d(np.arange(len(texts)), look)
                    out += [(label, r, None, t, True) for r, t in zip(batch.column(0).take(pa.array(rest)).to_pylist(), texts.take(pa.array(rest)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()))],
                    names=["field_name", "record_id", "source", "text", "whole"],
                )

    return rows.mapInArrow(run, "field_name string, record_id long, source string, text string, whole boolean")
