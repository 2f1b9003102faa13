"""Noise in text from scanned pages (problem 1).

Two narrow passes.  The first counts, over all texts, words, words before numbers and short lines that
interrupt a sentence; lines are compared by a signature in which numbers, codes and runs of capitals
are masked.  What repeats at page edges beyond a share of all broken texts is page furniture; words beyond a
share of all words are the corpus vocabulary.  Shares, not counts, bound what is gathered and decide what is
rare: a corpus ten times as large is judged alike.

The second pass removes furniture, also where a few letters of a line were misread, and page numbers: those that
run on from page to page of a text, and lone ones that the words around them don't ask for.  It joins words broken
at line ends where the vocabulary knows the joined form (a word that is written with its hyphen keeps it, and what
the vocabulary knows in no form stays as it is), turns misread characters back where that makes a rare token a
common word, and joins the lines of a paragraph.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chars import code_points, normalise, slices

#: Least share of all words that a vocabulary word has (at most one million words).
WORD_SHARE = 1e-6
#: Least share of the texts with line breaks that a furniture line's signature has (at most 1000 signatures).
LINE_SHARE = 1e-3
#: A token is a misreading if the word it stands for is at least so many times as frequent.
MISREAD_RATIO = 12
#: Least share of all words of the word that a token with signs or figures inside is taken for.
TRUE_SHARE = 2.5e-6
#: Least share of all words of the word that a token of two or three letters is taken for.
SHORT_SHARE = 5e-5
#: So many letters of a furniture line may be misread: one, and one more for every so many letters.
MISREAD_LETTERS = 20
#: Above this share a word is mostly followed by a number, so a number on the next line belongs to it.
NUMBER_SHARE = 0.25
#: Above this share a word is seen behind numbers.
FOLLOW_SHARE = 0.01
# What a reader of scanned pages takes for what (misread form, true form).
CONFUSED = (("rn", "m"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("q", "g"), ("0", "o"), ("1", "l"), ("1", "i"), ("|", "i"), ("|", "l"), ("l", "i"), ("(", "c"), ("7", "t"), ("5", "s"), ("8", "b"), ("6", "b"), ("$", "s"), ("3", "e"), ("9", "g"), ("4", "a"), ("o'", "ơ"), ("u'", "ư"))
# Plain vowels and their forms with the dot below, which is read as a full stop.
DOTTED = dict(zip("aăâeêioôơuưy", "ạặậẹệịọộợụựỵ", strict=True))
#: Numbers with letters read into them.
_NUMBER = re.compile(r"(?=[^A-Z]*\d)(?=.*[lOoIbSB|])[\dlOoIbSB|]+(?:[.,/][\dlOoIbSB|]+)*%?$")
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATORS = "\"“”‘’«»;:!?/…•–—"
_TOKEN = re.compile(rf"[^\s{_SEPARATORS}]+")
_LINE = re.compile(r"\r\n|\n|\r")
_BREAK = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[-¬\u00ad‐][ \t]*(?:\r\n|\n|\r)[ \t]*[^\W\d_]+)+")
_PARTED = re.compile(r"([-¬\u00ad‐][ \t]*(?:\r\n|\n|\r)[ \t]*)")
_LINE_END = re.compile(r"[ \t\r\n]")
_LETTERS = "abcdeghiklmnopqrstuvxy" + "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_HYPHEN_END = re.compile(r"[-¬­‐][ \t]*[\r\n]")
# The capitals of Vietnamese beyond A to Z.
_CAPITALS = "ÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ"
_CAPITAL_RUN = rf"[A-Z{_CAPITALS}][A-Z0-9{_CAPITALS}.&,-]*(?:\s+[A-Z{_CAPITALS}&][A-Z0-9{_CAPITALS}.&,-]*)+"
_CODE = re.compile(r"(?=.*[A-Z])[A-Z0-9]{4}$")


def signature(line: str) -> tuple[str, str]:
    """Two fuzzy forms of a line: numbers and codes masked, and with runs of capitals masked, too."""
    out, shape = [], []
    for raw in line.split():
        token = raw
        if re.fullmatch(r"\d+", token):
            token = "#"
        elif _CODE.match(token):
            token = "@"
        else:
            token = re.sub(r"\d+", "#", token)
        out.append(token)
        mask = "^" if (token == "@" and raw.isalpha()) or (len(token) > 1 and token.isupper() and "#" not in token) else token
        if not (mask == "^" and shape and shape[-1] == "^"):
            shape.append(mask)
    return " ".join(out), " ".join(shape)


def _edges(text: str) -> Iterator[str]:
    """Short lines that interrupt a sentence: much shorter than the text's lines, between two others."""
    lines = _LINE.split(text)
    if len(lines) < 2:
        return
    width = max(map(len, lines))
    for k, line in enumerate(lines):
        short = line.strip()
        if 0 < len(short) <= 0.8 * width and len(short.split()) <= 10 and short[-1] not in ".!?;,-¬­":
            before = lines[k - 1].rstrip() if k else ""
            if k and before and before[-1] not in ".!?:;-¬­":
                yield short


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, number, follows, sigs, total = (Counter() for _ in range(5))

    def out() -> pa.RecordBatch:
        rows = [("w", k, n) for k, n in words.items()] + [("n", k, n) for k, n in number.items() if n] + [("a", k, n) for k, n in follows.items() if n] + [("s", k, n) for k, n in sigs.items()] + [("t", k, n) for k, n in total.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "key", "n"])

    letter, blank, _, lower, _ = _classes()
    for batch in slices(batches, 0):
        points, bounds = code_points(batch.column(0))
        if not len(points):
            continue
        low = np.minimum(points, 0x2FFF)
        points = np.where(points < 0x3000, lower[low], points).astype(np.uint32)
        inside = letter[low] & (points < 0x3000)
        starts, ends = _spans(inside, bounds)
        total["words"] += len(starts)
        _, first, n, inverse = _distinct(points, starts, ends)
        names = [_text_of(points, starts[k], ends[k]) for k in first]
        words.update(dict(zip(names, n.tolist(), strict=True)))
        # words before a blank and a digit
        after = np.minimum(ends, len(points) - 2)
        digit = blank[low[after]] & (points[after + 1] >= 0x30) & (points[after + 1] <= 0x39) & (ends < len(points) - 1)
        number.update(dict(zip(names, np.bincount(inverse[digit], minlength=len(names)).tolist(), strict=True)))
        follow = np.maximum(starts, 2)
        digit = blank[low[follow - 1]] & (points[follow - 2] >= 0x30) & (points[follow - 2] <= 0x39) & (starts >= 2)
        follows.update(dict(zip(names, np.bincount(inverse[digit], minlength=len(names)).tolist(), strict=True)))
        # words written with a hyphen
        hyphen = np.flatnonzero((points[np.minimum(ends, len(points) - 1)] == 0x2D) & (np.concatenate([starts[1:], [0]]) == ends + 1))
        if len(hyphen):
            _, first, n, _ = _distinct(points, starts[hyphen], ends[hyphen + 1])
            words.update({_text_of(points, starts[hyphen[k]], ends[hyphen[k] + 1]): int(m) for k, m in zip(first, n, strict=True)})
        broken = np.unique(np.searchsorted(bounds, np.flatnonzero((low == 10) | (low == 13)), side="right") - 1)
        total["lines"] += len(broken)
        for text in batch.column(0).take(pa.array(broken)).to_pylist():
            sigs.update({s for line in _edges(text) for s in set(signature(line))})
        if len(words) + len(sigs) > 500_000:  # hand over what is counted so far; the sums follow after the shuffle
            yield out()
            words, number, follows, sigs, total = (Counter() for _ in range(5))
    yield out()


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, ...]:
    """By code point: letter, blank, separator, and the lower-case form."""
    top = 0x3000
    letter, blank, apart = np.zeros(top, bool), np.zeros(top, bool), np.zeros(top, bool)
    lower = np.arange(top, dtype=np.uint32)
    for c in range(top):
        ch = chr(c)
        letter[c] = bool(_WORD.match(ch))
        blank[c] = ch.isspace()
        apart[c] = blank[c] or ch in _SEPARATORS
        if len(ch.lower()) == 1:
            lower[c] = ord(ch.lower())
    weight = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
    return letter, blank, apart, lower, weight


def _spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in ``inside``; a row's end ends a run."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def _distinct(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of a first occurrence, number, inverse) of the distinct runs, told apart by a 64-bit hash of their letters."""
    weight = _classes()[4]
    size = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    step = at - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        mixed = (points[at].astype(np.uint64) + np.uint64(0x9E3779B9)) * weight[step & 63] ^ (step >> 6).astype(np.uint64)
        key = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(size)[:-1]])) if len(size) else np.empty(0, np.uint64)
    keys, first, inverse, number = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return keys, first, number, inverse


def _text_of(points: np.ndarray, a: int, b: int) -> str:
    return points[a:b].astype("<u4").tobytes().decode("utf-32-le")


class Knowledge:
    """What the first pass learned: vocabulary, words before numbers, furniture patterns."""

    def __init__(self, words: dict[str, int], number: dict[str, float], signatures: list[str], follows: dict[str, float] | None = None, total: int = 0):
        self.words, self.number, self.follows, self.total = words, number, follows or {}, max(total, 1)
        line, inline, anchors = [], [], set()
        kept = [x for x in signatures if re.search(r"[#@^]", x) and x not in ("^", "@")]  # a name alone is no sign of furniture
        kept = [x for x in kept if not any(y != x and y.endswith(" " + x) or y.startswith(x + " ") for y in kept if "#" in y)]
        for s in sorted(kept):
            if s[0] in "-–—|~•" and s[0] != s[-1] or s[-1] in "-–—|~•" and s[0] != s[-1]:
                continue  # a piece of a longer line
            pattern = r"\s+".join(self._pattern(t) for t in s.split(" "))
            bare = re.fullmatch(r"[#/.,%]+", s.replace(" ", ""))
            if re.search(r"[#@^].*[.,%)]$|^\(", s):
                continue
            if "^" in s and not re.search(r"[|•—]", s):
                line.append(pattern)
            elif not bare:
                inline.append(pattern)
                rest = [t for t in s.split(" ") if t not in ("#", "@", "^")]
                rest = [t for t in rest if not set(t) & set(_SEPARATORS)] or [t for t in rest if t in _SEPARATORS] or [t.strip(_SEPARATORS) for t in rest]
                anchors.add(min(rest, key=lambda t: (words.get(t.lower(), 0), -len(t), t)))
        self.anchors = anchors
        self.forms = sorted(x for x in kept if len(x) >= 8 and not re.fullmatch(r"[#@^/.,%\W]+", x))
        self.line = re.compile("|".join(f"(?:{p})" for p in line) or r"(?!)")
        self.inline = re.compile(r"(?<!\S)(?:" + "|".join(f"(?:{p})" for p in sorted(inline, key=lambda p: (-len(p), p))) + r")(?!\S)" if inline else r"(?!)")
        self._start()

    def _start(self) -> None:
        """The parts that every process builds for itself."""
        self.sorted = sorted(self.words)
        self.verdict: dict[str, str | None] = {}
        self.slips: dict[str, bool] = {}
        self.judged: dict[int, bool] = {}
        self.by_token: dict[str, list[str]] = {}
        for form in self.forms:
            for token in set(form.split(" ")):
                self.by_token.setdefault(token, []).append(form)

    def share(self, word: str) -> float:
        """The share of a word among all words; an unknown one has at most WORD_SHARE."""
        n = self.words.get(word)
        return n / self.total if n else WORD_SHARE

    def begins(self, prefix: str) -> bool:
        """Whether some word of the vocabulary begins so."""
        at = bisect.bisect_left(self.sorted, prefix)
        return at < len(self.sorted) and self.sorted[at].startswith(prefix)

    def like_furniture(self, line: str) -> bool:
        """Whether a line is a furniture line but for a few misread letters."""
        out, shape = signature(line)
        for own in {out, shape}:
            room = 1 + len(own) // MISREAD_LETTERS
            near = {f for t in own.split(" ") for f in self.by_token.get(t, ()) if abs(len(f) - len(own)) <= room and f != own}
            if any(_edits(own, f, room) <= room for f in near):
                return True
        return False

    @staticmethod
    def _pattern(token: str) -> str:
        if token == "^":
            return _CAPITAL_RUN
        token = re.escape(token).replace(r"\#", "#")
        return token.replace("@", "[A-Z0-9]{3,5}").replace("#", r"[\dlOIo]+")

    def common(self, word: str) -> int:
        return self.words.get(word, 0)

    def true_form(self, token: str) -> str | None:
        """The word that a misread token stands for, or None if the token may stand."""
        if token not in self.verdict:
            if len(self.verdict) > 200_000:
                self.verdict.clear()
            self.verdict[token] = self._true_form(token)
        return self.verdict[token]

    def is_word(self, token: str) -> bool:
        """Whether the vocabulary knows a token, as it stands, misread, mistyped or with look-alike letters."""
        if self.common(token.lower()) or self.misspelt(token):
            return True
        form = self.true_form(token)
        if form is not None and self.common(form.lower()):
            return True
        even = normalise(pa.array([token], pa.string()))[0][0].as_py()
        return even != token and bool(self.common(even.lower()))

    def misspelt(self, token: str) -> bool:
        """Whether a token is a common word with one letter doubled or dropped: a typing error just as well as a misreading."""
        low = token.strip(".,()%").lower()
        if not low.isalpha():
            return False
        if token not in self.slips:
            if len(self.slips) > 50_000:
                self.slips.clear()
            doubled = (low[:i] + low[i + 1 :] for i in range(1, len(low)) if low[i] == low[i - 1])
            dropped = (low[:i] + c + low[i:] for i in range(len(low) + 1) for c in _LETTERS)
            least = MISREAD_RATIO * self.share(low)
            common = lambda w: self.share(w) >= least and w in self.words
            self.slips[token] = any(map(common, doubled)) or any(map(common, dropped))
        return self.slips[token]

    def _true_form(self, token: str) -> str | None:
        core = token.strip(".,)%").lstrip("(") if not token.endswith("(") else token.lstrip("(").strip(".,")
        if len(core) < 2:
            return None
        if _NUMBER.match(core) and not core.isalpha():
            digits = sum(c.isdigit() for c in core)
            letters = len(re.findall("[lOoIbSB|]", core))
            if digits and len(core) > 2 and not _CODE.match(core) and not re.fullmatch(r"[A-Z]\d[A-Z]", core) and (digits >= letters or re.search(r"[.,/]", core)):
                return token.replace(core, core.translate(str.maketrans("lOoIbSB|", "10016581")))
        low = core.lower()
        if low.isalpha() and len(low) < 3:
            return None
        if _CODE.match(core) and re.search(r"\d", core):
            return None  # a firm's code
        if re.fullmatch(r"[a-z]0", core):  # a word of two letters that ends in o; a code is rarely written so
            word = core[0] + "o"
            return token.replace(core, word) if word in self.words and self.share(word) >= SHORT_SHARE else None
        if re.search(r"\d", low) and (not re.search(r"[^\W\d_]", low) or re.fullmatch(r"(?:[a-z]{1,2}\d+|\d+[a-z]{1,3}|[a-z]\d[a-z])", low)):
            if not re.search(r"[^\x00-\x7f]", low) and not (re.search(r"[01]", low) and len(low) > 2 and low.islower() and core.islower()):
                return None
        best = self._likeliest(low)
        if best is None or self._share_of(best) < (MISREAD_RATIO * self.share(low) if low.isalpha() else TRUE_SHARE):
            return None  # a token with signs or figures inside is no word anyway
        if low.isalpha() and len(low) < 4 and self._share_of(best) < SHORT_SHARE:
            return None
        best = best.upper() if core.isupper() and len(core) > 1 else best[:1].upper() + best[1:] if core[:1].isupper() else best
        return token.replace(core, best)


    def _share_of(self, token: str) -> float:
        return min(self.share(x) for x in _WORD.findall(token))

    def _likeliest(self, low: str) -> str | None:
        """The most frequent reading of a token that turns any number of its spots back and holds known words only.

        The readings grow letter by letter, and only those with which a word of the vocabulary begins go on, so the
        number of spots doesn't matter.  Of equally frequent ones the first in the alphabet is taken.
        """
        turns: dict[int, list[tuple[int, str]]] = {}
        for wrong, right in CONFUSED:
            at = low.find(wrong)
            while at >= 0:
                turns.setdefault(at, []).append((len(wrong), right))
                at = low.find(wrong, at + 1)
        if "." in low:
            for m in re.finditer(r"([aăâeêioôơuưy])\.(?=[^\W\d_]|$)", low):
                turns.setdefault(m.start(), []).append((2, DOTTED[m.group(1)]))
        if not turns:
            return None
        # (place in the token, reading so far, begin of its last word): a hyphen ends a word, other signs and figures end the reading.
        alive, ready = {(0, "", 0)}, []
        while alive:
            grown = set()
            for at, text, word in alive:
                if at == len(low):
                    ready.append(text)
                    continue
                for n, new in [(1, low[at]), *turns.get(at, ())]:
                    begin = word
                    if new == "-":
                        if text[word:] not in self.words:
                            continue
                        begin = len(text) + 1
                    elif not _WORD.fullmatch(new):
                        continue
                    reading = text + new
                    if begin == len(reading) or self.begins(reading[begin:]):
                        grown.add((at + n, reading, begin))
            alive = grown
        known = [r for r in ready if r != low and (x := _WORD.findall(r)) and all(w in self.words for w in x)]
        return min(known, key=lambda r: (-self._share_of(r), r), default=None)


def _edits(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or more than ``most``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def learn(*texts: DataFrame) -> Knowledge:
    """Vocabulary and furniture of all rows of one-column DataFrames."""
    rows = texts[0]
    for more in texts[1:]:
        rows = rows.unionAll(more)
    # Written once, since totals and thresholds both read them: the texts are passed through once.
    counts = cut_lineage(rows.mapInArrow(_collect, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    # A cumulated share bounds what is gathered: words and lines below it stay behind.
    totals = F.broadcast(counts.where("kind = 't'").groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("key") == "words", F.col("n"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("key") == "lines", F.col("n"))), F.lit(0)).alias("lines")
    ))
    kept = counts.join(totals).where(
        (F.col("kind").isin("w", "n", "a") & (F.col("n") >= F.greatest(F.col("words") * WORD_SHARE, F.lit(2))))
        | ((F.col("kind") == "s") & (F.col("n") >= F.greatest(F.col("lines") * LINE_SHARE, F.lit(3))))
    ).select("kind", "key", "n")
    words, number, follows, sigs = {}, {}, {}, []
    total = (counts.where("kind = 't' and key = 'words'").agg(F.sum("n")).first()[0]) or 0
    for kind, key, n in kept.collect():
        if kind == "w":
            words[key] = n
        elif kind == "n":
            number[key] = n
        elif kind == "a":
            follows[key] = n
        else:
            sigs.append(key)
    share = lambda x: {w: n / words[w] for w, n in x.items() if w in words}
    return Knowledge(words, share(number), sigs, share(follows), total)


_PAGE = re.compile(r"([\[(~\-–—|\s]*)(\d{1,4})(?:\s*/\s*(\d{1,4}))?[\])~\-–—|\s]*")


def _running(lines: list[str]) -> set[int]:
    """The lines that are numbers and nothing else and go on by one from one such line to a later one: page numbers of a text's pages."""
    found = [(k, int(m.group(2)), m.group(3)) for k, line in enumerate(lines) if (m := _PAGE.fullmatch(line.strip())) and line.strip()]
    held = {(n, of): k for k, n, of in reversed(found)}
    out = set()
    for k, n, of in found:
        later = held.get((n + 1, of))
        if later is not None and later > k + 1:
            out |= {k, later}
    return out


def _is_page_number(line: str, before: str, after: str, know: Knowledge) -> bool:
    """A lone line that is nothing but a page number, and not a number that the lines around it ask for."""
    short = line.strip()
    m = _PAGE.fullmatch(short)
    if not m or not short:
        return False
    if m.group(1):
        return True
    if m.group(3):
        return int(m.group(2)) <= int(m.group(3)) and not 1900 <= int(m.group(3)) <= 2100
    if re.match(r"\s*\d", after):
        return True  # two numbers in a row
    last, first = _WORD.findall(before.lower()), _WORD.findall(after.lower())
    asked = bool(last) and before.rstrip()[-1:].isalpha() and know.number.get(last[-1], 0.0) > NUMBER_SHARE
    return not (asked and (not first or know.follows.get(first[0], 0.0) > FOLLOW_SHARE))


def _drop_furniture(text: str, know: Knowledge) -> tuple[str, bool]:
    found = False

    def gone(m: re.Match) -> str:
        nonlocal found
        found = True
        return "\0"

    if any(a in text for a in know.anchors if "#" not in a) or any("#" in a for a in know.anchors) and re.search(r"[\[(~/]\s?\d", text):
        text = know.inline.sub(gone, text)
        if found:
            text = re.sub(r"(?:\r\n|\n|\r)[ \t]*\0[ \t]*(?=[\r\n]|$)", "", text).replace("\0", " ")
    if "\n" in text or "\r" in text:
        lines, kept = _LINE.split(text), []
        running = _running(lines)
        width = max(map(len, lines))
        for k, line in enumerate(lines):
            short = line.strip()
            before = next((x for x in reversed(kept) if x.strip()), "")
            if k in running or short and 0 < k and len(short) <= 0.8 * width and len(short.split()) <= 10 and before.rstrip()[-1:] not in ".!?:;" and know.like_furniture(short):
                found = True
                continue
            if short and (0 < k < len(lines) - 1 or len(lines) > 2) and _is_page_number(line, before, next((x for x in lines[k + 1 :] if x.strip()), ""), know) or short and know.line.fullmatch(short):
                found = True
                continue
            kept.append(line)
        text = "\n".join(kept)
    return text, found


def _join_words(text: str, know: Knowledge) -> tuple[str, bool]:
    found = False
    if not _HYPHEN_END.search(text):
        return text, found

    def join(m: re.Match) -> str:
        nonlocal found
        pieces = _PARTED.split(m.group())  # words and the marks between them
        out, at = pieces[0], 1
        while at < len(pieces):
            # a word may be broken more than once: the longest known run of pieces is one word
            for end in range(len(pieces), at, -2):
                run = [_LINE_END.sub("", x) for x in [out, *pieces[at:end]]]
                marks = {x for x in run[1::2]}
                whole, hyphened = "".join(run[::2]), "-".join(run[::2])
                if marks == {"-"} and know.common(hyphened.lower()) > know.common(whole.lower()):
                    out, at = hyphened, end
                    break
                # '-' and its like may part a word or two; the other marks part one word only
                if not marks & set("-‐") or know.is_word(whole):
                    found = True
                    out, at = whole, end
                    break
            else:  # known in no form
                if at + 2 < len(pieces):
                    return out + pieces[at] + _BREAK.sub(join, "".join(pieces[at + 1 :]))
                return out + "".join(pieces[at:])
        return out

    return _BREAK.sub(join, text), found


def repair(text: str, know: Knowledge) -> tuple[str, bool]:
    """(continuous text, whether the text had noise of a scanned page)."""
    text0 = text
    text, furniture = _drop_furniture(text, know)
    text, broken = _join_words(text, know)
    clear = _TOKEN.sub(lambda m: know.true_form(m.group()) or m.group(), text)
    misread = False
    if clear != text:
        # a typing error alone is no noise of a scanned page, and stays
        misread = furniture or broken or any((form := know.true_form(t)) is not None and form != t and not know.misspelt(t) for t in set(_TOKEN.findall(text)))
        text = clear if misread else text
    if "\n" in text or "\r" in text:
        paragraphs = [p for p in re.split(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+", text)]
        text = "\n\n".join(re.sub(r"[ \t]*(?:\r\n|\n|\r)[ \t]*", " ", p) for p in paragraphs)
    if furniture or broken or misread:
        text = re.sub(r"[ \t]{2,}", " ", text)
    return (text if text != text0 else text0), furniture or broken or misread


def _worth(texts: pa.Array, know: Knowledge) -> np.ndarray:
    """Rows that ``repair`` may change: those with line breaks, a misread token or a token of page furniture.

    Tokens are told apart over the whole batch, and each distinct one is judged once.
    """
    points, bounds = code_points(texts)
    out = np.zeros(len(texts), bool)
    if not len(points):
        return out
    _, _, apart, _, _ = _classes()
    low = np.minimum(points, 0x2FFF)
    row = lambda at: np.searchsorted(bounds, at, side="right") - 1
    out[row(np.flatnonzero((low == 10) | (low == 13)))] = True
    for sign in know.anchors:
        if sign in _SEPARATORS:
            out[row(np.flatnonzero(low == ord(sign)))] = True
    starts, ends = _spans(~apart[low], bounds)
    keys, first, _, inverse = _distinct(points, starts, ends)
    hit = np.zeros(len(keys), bool)
    for i, (key, k) in enumerate(zip(keys.tolist(), first.tolist(), strict=True)):
        judged = know.judged.get(key)
        if judged is None:
            token = _text_of(points, starts[k], ends[k])
            form = know.true_form(token)
            judged = (form is not None and form != token) or token in know.anchors or re.sub(r"\d+", "#", token) in know.anchors
            if len(know.judged) > 1_000_000:
                know.judged.clear()
            know.judged[key] = judged
        hit[i] = judged
    if hit.any():
        out[row(starts[hit[inverse]])] = True
    return out


def continuous(df: DataFrame, key: str, fields: dict[str, str], know: Knowledge, only_found: bool = False) -> DataFrame:
    """Rows ``(field_name, record_id, text, found)`` for the columns in ``fields`` (column: name to report).

    Null texts stay null and are no case; empty ones stay empty; texts are handled whole; repeated rows give
    repeated output; extra columns are left aside.
    """
    names = list(fields)
    labels = [fields[c] for c in names]
    rows = df.select(F.col(key).cast("long").alias("__id"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(names)])
    shared = df.sparkSession.sparkContext.broadcast((know.words, know.number, know.follows, know.total, know.forms, know.line.pattern, know.inline.pattern, know.anchors))  # bounded by the shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Knowledge.__new__(Knowledge)
        own.words, own.number, own.follows, own.total, own.forms, line, inline, own.anchors = shared.value
        own.line, own.inline = re.compile(line), re.compile(inline)
        own._start()
        for batch in slices(batches, *range(1, len(labels) + 1)):
            for i, label in enumerate(labels):
                out = []
                worth = _worth(batch.column(i + 1), own)
                kept = batch.filter(pa.array(worth)) if only_found else batch
                flags = worth[worth] if only_found else worth
                for rid, text, look in zip(kept.column(0).to_pylist(), kept.column(i + 1).to_pylist(), flags.tolist(), strict=True):
                    new, found = repair(text, own) if look and text else (text, False)
                    if found or not only_found:
                        out.append((label, rid, new, found))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["field_name", "record_id", "text", "found"])

    return rows.mapInArrow(run, "field_name string, record_id long, text string, found boolean")
