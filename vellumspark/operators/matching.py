"""Dictionary matching: exact spans, near misses with positions, overlap resolution.

The dictionary is the stated query set: it is sent out in blocks of bounded size, and every text is passed once, in Arrow
batches, in one narrow pass without a shuffle.  Exact spans are found by an automaton over the forms.  Near misses are found
word by word: each distinct word of a batch is compared once with all words of the forms, by letter counts first and then by
a bit-parallel common subsequence for all pairs at once; a form is looked for only where its longest word is resembled.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tone_normal, words

#: Forms in a block that is sent to the workers; larger dictionaries are searched block by block.
MAX_FORMS = 200_000
MATCH = "struct<keyword_found:string,keyword_canonical:string,category:string,position:int,end_position:int,match_type:string,similarity:double,levenshtein_distance:int>"
# Everyday words that are never taken for a misspelt term.
COMMON_WORDS = (
    "together", "whether", "weather", "gather", "gathering", "another", "brother", "mother", "father", "other", "rather", "further", "either", "neither",
    "leather", "nether", "bother", "finance", "financial", "general", "company", "annual", "report", "market", "meeting", "system", "service", "management",
    "operation", "business", "statement", "audited", "executive", "director", "shareholder", "capital", "revenue", "profit", "investment", "growth",
    "overview", "quarter", "forward", "between", "through", "without",
    "bảo đảm", "dòng tiền", "tiền mặt", "bảo hiểm", "bảo toàn", "bảo vệ", "bảo lãnh", "phân cấp", "phân quyền", "hội đồng", "quản trị", "ban giám đốc",
    "cổ đông", "kế hoạch", "kinh doanh", "lợi nhuận", "doanh thu", "tăng trưởng", "vốn chủ", "sở hữu", "tài chính", "ngân sách", "ngân hàng", "kiểm soát",
)
# Signs that end a clause at a token's end, and signs stripped from a token's edges.
BREAKS = ",;:.!?\n—–)]}\"”"
EDGES = ".,;:!?()[]{}\"'“”—–/\\"
#: A word of a phrase resembles that of a form from this similarity on.
WORD_ALIKE = 0.75
#: Noise signs near a short acronym that betray a misread page, and how many make it so.
NOISE, NOISE_LIMIT, NOISE_REACH = "@#%^*~`'{}/\\", 3, 25


_BLANKS, _UNEVEN = re.compile(r"\s+"), re.compile(r"\s\s|[^\S ]")


class Scanner:
    """All occurrences of all forms in a text, on word boundaries, whatever the case and the blanks between words."""

    def __init__(self, forms: list[tuple[str, str, str]]):
        self.forms = {}
        for form, canonical, category in forms:
            key = " ".join(form.lower().split())
            if key:
                self.forms[key] = (canonical, category)
        word = lambda c: c.isalnum() or c == "_"
        #: By form: its length, whether it begins and ends with a word character, whether it is a short acronym, what it stands for.
        self.facts = {k: (len(k), word(k[0]), word(k[-1]), len(k) <= 3 and k.isascii(), *v) for k, v in self.forms.items()}
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for key in self.forms:
                self.automaton.add_word(key, key)
            if self.forms:
                self.automaton.make_automaton()
        except ImportError:
            self.automaton = None
            self.pattern = {k: re.compile(re.escape(k)) for k in self.forms}

    @staticmethod
    def fold(text: str) -> str:
        """The lower-case text with single blanks."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        return _BLANKS.sub(" ", low) if _UNEVEN.search(low) else low

    @staticmethod
    def places(text: str) -> Callable[[int], int]:
        """The place in a text of a place in its folded form: runs of blanks became one."""
        ends, shifts, gone = [], [], 0
        for m in _BLANKS.finditer(text):
            if m.end() - m.start() > 1:
                ends.append(m.start() - gone)
                gone += m.end() - m.start() - 1
                shifts.append(gone)
        if not ends:
            return lambda at: at
        # a run's own blank stands at its begin; what follows is shifted
        return lambda at: at + (shifts[k - 1] if (k := bisect.bisect_left(ends, at)) else 0)

    def find(self, text: str) -> list[tuple]:
        if not text or not self.forms:
            return []
        low = self.fold(text)
        spans = self.automaton.iter(low) if self.automaton is not None else ((m.end() - 1, k) for k, p in self.pattern.items() for m in p.finditer(low))
        out, place, size = [], None, len(low)
        for last, key in spans:
            length, begins, ends, short, canonical, category = self.facts[key]
            a, b = last + 1 - length, last + 1
            # a word character on either side makes it a part of a longer word
            if begins and a and ((c := low[a - 1]).isalnum() or c == "_") or ends and b < size and ((c := low[b]).isalnum() or c == "_"):
                continue
            if place is None:
                place = self.places(text) if size != len(text) else int
            start, end = place(a), place(b - 1) + 1
            found = text[start:end]
            if short:
                if found != found.upper() or not re.search("[A-Z]", found):
                    continue
                near = text[max(0, start - NOISE_REACH) : end + NOISE_REACH]
                if sum(c in NOISE for c in near) >= NOISE_LIMIT:
                    continue
            out.append((found, canonical, category, start, end, "exact", 100.0, 0))
        out.sort(key=lambda m: (m[3], m[4], m[1]))
        return out


class NearMisses:
    """Near misses of forms in texts: runs of words, parted by no clause end, that resemble a form word by word and as a whole."""

    def __init__(self, forms: dict[str, tuple[str, str]], threshold: float, exclusions: frozenset[str]):
        self.threshold, self.exclusions = threshold, exclusions
        self.forms = [f for f in forms if len(f) >= 6 and f not in exclusions]
        self.parts = [f.split(" ") for f in self.forms]
        self.words = sorted({w for p in self.parts for w in p})
        place = {w: i for i, w in enumerate(self.words)}
        self.parts_at = [[place[w] for w in p] for p in self.parts]
        #: By word: the forms whose longest word it is, where it stands in them, how far behind it their next longest word stands, and that word.
        self.anchors: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, p in enumerate(self.parts):
            at, *rest = sorted(range(len(p)), key=lambda i: (-len(p[i]), i))
            next_at = rest[0] if rest else at
            self.anchors.setdefault(place[p[at]], []).append((k, at, next_at - at, place[p[next_at]]))
        self.floor = min(WORD_ALIKE, threshold / 100)
        #: By token: the bare word, whether a clause ends behind it, what it resembles, and the forms it may anchor by the distance and the word that must stand there.
        self.seen: dict[str, tuple[str, bool, dict[int, bool] | None, list[tuple[int, dict[int, list[tuple[int, int]]]]]]] = {}
        self.judged: dict[tuple[str, int], tuple[float, int] | None] = {}
        letters = sorted({c for w in self.words for c in w})
        self.code = {c: i for i, c in enumerate(letters)}
        self.size = np.array([len(w) for w in self.words], np.int64)
        counts = np.zeros((len(self.words), len(letters)), np.int64)
        self.mask = np.zeros((len(self.words), len(letters)), np.uint64)
        for i, w in enumerate(self.words):
            for j, c in enumerate(w):
                counts[i, self.code[c]] += 1
                if j < 63:
                    self.mask[i, self.code[c]] |= np.uint64(1 << j)
        #: One feature a letter and occurrence: their dot product is the number of common letters.
        self.features = np.array([(c, k) for c in range(len(letters)) for k in range(int(counts[:, c].max(initial=0)))], np.int64).reshape(-1, 2)
        self.bag = (counts[:, self.features[:, 0]] > self.features[:, 1]).astype(np.float32)
        self.of_point = np.full(ord(letters[-1]) + 1 if letters else 1, -1, np.int64)
        self.of_point[[ord(c) for c in letters]] = np.arange(len(letters))

    def _resembled(self, tokens: list[str]) -> list[dict[int, bool] | None]:
        """By token: the form words that it equals or resembles, and whether closely enough for a word of a phrase."""
        out: list[dict[int, bool] | None] = []
        for start in range(0, len(tokens), 2000):
            part = tokens[start : start + 2000]
            size = np.array([len(t) for t in part], np.int64)
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            row = np.repeat(np.arange(len(part)), size)
            letter = np.where(points < len(self.of_point), self.of_point[np.minimum(points, len(self.of_point) - 1)], -1)
            codes = np.full((len(part), int(size.max(initial=0))), -1, np.int64)
            codes[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = letter
            n = len(self.code)
            counts = np.bincount(row[letter >= 0] * n + letter[letter >= 0], minlength=len(part) * n).reshape(len(part), n)
            bag = (counts[:, self.features[:, 0]] > self.features[:, 1]).astype(np.float32)
            i, w = np.nonzero(2 * (bag @ self.bag.T) + 1e-4 >= self.floor * (size[:, None] + self.size[None, :]))
            common = self._common(codes, i, w)
            for x in np.flatnonzero((self.size[w] > 63) | (size[i] > 63)):  # beyond the bits of a word
                common[x] = round(indel_ratio(part[i[x]], self.words[w[x]]) * (size[i[x]] + self.size[w[x]]) / 2)
            ratio = 2 * common / (size[i] + self.size[w])
            low, high = np.minimum(size[i], self.size[w]), np.maximum(size[i], self.size[w])
            same = ratio == 1.0
            # fixed values: short words need equal length and .85, longer ones similar length and .75
            close = same | np.where(low <= 3, (low == high) & (ratio >= 0.85), (low / high > 0.65) & (ratio >= WORD_ALIKE))
            found: list[dict[int, bool] | None] = [None] * len(part)
            for x in np.flatnonzero(close | (ratio >= self.floor)):
                held = found[i[x]]
                if held is None:
                    held = found[i[x]] = {}
                held[int(w[x])] = bool(close[x])
            out += found
        return out

    def _common(self, codes: np.ndarray, i: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of tokens i and form words w, all pairs at once, one bit a letter."""
        rest = np.full(len(i), np.uint64(2**64 - 1))
        with np.errstate(over="ignore"):
            for step in range(codes.shape[1]):
                c = codes[i, step]
                hit = np.where(c >= 0, self.mask[w, np.maximum(c, 0)], np.uint64(0))
                rest = (rest + (rest & hit)) | (rest & ~hit)
        inside = (np.uint64(1) << np.minimum(self.size[w], 63).astype(np.uint64)) - np.uint64(1)
        return np.bitwise_count(~rest & inside).astype(np.int64)

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The tokens of a batch, after those not seen before were compared with the forms' words."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        listed = [text.split() for text in texts]
        raw = sorted(set().union(*listed) - self.seen.keys())
        clean = [t.strip(EDGES) for t in raw]
        for t, c, near in zip(raw, clean, self._resembled(clean) if self.words else [None] * len(raw), strict=True):
            steps: dict[int, dict[int, list[tuple[int, int]]]] = {}
            for w in (near or ()) if c else ():
                for k, place, step, other in self.anchors.get(w, ()):
                    steps.setdefault(step, {}).setdefault(other, []).append((k, place))
            self.seen[t] = c, t[-1] in BREAKS, near if c else None, list(steps.items())
        return listed

    def _judge(self, window: str, k: int) -> tuple[float, int] | None:
        """(similarity in per cent, edit distance) of a run of words and a form; None where a guard speaks against it."""
        form = self.forms[k]
        a, b, edits = len(window), len(form), int(len(form) * (1 - self.threshold / 100) + 0.5) + 1
        unlike = window == form or window in COMMON_WORDS or window in self.exclusions
        if unlike or abs(a - b) > edits or not int(0.73 * a) <= b <= int(1.37 * a) + 1 or len(set(form) - set(window)) > edits:
            return None
        distance = edit_distance(window, form)
        if " " not in form and (b <= 8 and abs(a - b) > 1 or b <= 7 and distance > 1 or b <= 10 and distance > 2):
            return None
        alike = 100 * indel_ratio(window, form)
        return (round(alike, 2), distance) if self.threshold <= alike < 100 else None

    def find(self, text: str, raw: list[str], forms: dict[str, tuple[str, str]]) -> list[tuple]:
        """Near misses of a lower-case text whose tokens were learned."""
        tokens = [x for x in map(self.seen.__getitem__, raw) if x[0]]
        out, starts, number = [], None, len(tokens)
        for at, (_, _, _, steps) in enumerate(tokens):
            for step, group in steps:
                other = at + step
                if not 0 <= other < number or not (beside := tokens[other][2]):
                    continue
                for w in beside if len(beside) < len(group) else group:
                    # a word of a phrase must be close, a word alone is judged as a whole
                    if w not in group or w not in beside or step and not beside[w]:
                        continue
                    for k, place in group[w]:
                        hit = self._at(tokens, at - place, k)
                        if hit is None:
                            continue
                        if starts is None:
                            starts = [m.start() for m in re.finditer(r"\S+", text) if self.seen[m.group()][0]]
                        window, alike, distance = hit
                        canonical, category = forms[self.forms[k]]
                        begin = starts[at - place]
                        out.append((window, canonical, category, begin, begin + len(window), "fuzzy", alike, distance))
        return out

    def _at(self, tokens: list[tuple], first: int, k: int) -> tuple[str, float, int] | None:
        """(run of words, similarity, distance) where the run that begins at a token resembles form ``k``."""
        words = self.parts_at[k]
        run = tokens[first : first + len(words)] if first >= 0 else []
        if len(run) < len(words):
            return None
        if len(words) > 1:
            for n, (_, brk, near, _) in enumerate(run, 1):
                if brk and n < len(run) or not near or not near.get(words[n - 1]):
                    return None
        window = " ".join([r[0] for r in run])
        if (window, k) not in self.judged:
            if len(self.judged) > 500_000:
                self.judged.clear()
            self.judged[window, k] = self._judge(window, k)
        hit = self.judged[window, k]
        return None if hit is None else (window, *hit)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = row
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b): similarity under insertions and deletions only."""
    if not a and not b:
        return 1.0
    place: dict[str, int] = {}
    for j, c in enumerate(b):
        place[c] = place.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    rest = full
    for c in a:
        hit = rest & place.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return 2.0 * (len(b) - rest.bit_count()) / (len(a) + len(b))


def disjoint(found: list[tuple]) -> list[tuple]:
    """``resolve_overlaps`` of a list of matches: chosen spans stay sorted, so each candidate meets its two neighbours only."""
    starts: list[int] = []
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (m[5] != "exact", m[3] - m[4], -m[6], m[3], m[1])):
        at = bisect.bisect_right(starts, m[3])
        if (at and kept[at - 1][4] > m[3]) or (at < len(kept) and kept[at][3] < m[4]):
            continue
        starts.insert(at, m[3])
        kept.insert(at, m)
    return kept


def search(docs: DataFrame, text: str, forms: DataFrame, fuzzy: bool = False, threshold: float = 85.0, exclusions: tuple[str, ...] = (), resolve: bool = True) -> DataFrame:
    """``docs`` with ``matches``: the exact matches of every text, with ``fuzzy`` the near misses, too, disjoint spans by position.

    Exact matches are looked for with tone marks brought to one place on both sides; their positions are those of the
    tone-normalised text, which has as many characters as the text itself.  Near misses are looked for in the text as it is.
    Null and empty texts have an empty list.  Without ``resolve`` overlapping matches stay.
    """
    spark = docs.sparkSession
    blocks: list[list[tuple]] = [[]]
    for r in forms.select(tone_normal(F.col("form")).alias("form"), "canonical", "category").orderBy("form", "canonical").toLocalIterator():
        if len(blocks[-1]) == MAX_FORMS:
            blocks.append([])
        blocks[-1].append(tuple(r))
    columns = []
    for block in blocks:
        # One block at a time: a dictionary of any size is searched whole.
        columns.append(_search_udf(spark.sparkContext.broadcast(block), fuzzy, threshold, tuple(exclusions), resolve and len(blocks) == 1)(tone_normal(F.col(text)), F.col(text) if fuzzy else F.lit("")))
    if len(blocks) == 1:
        return docs.withColumn("matches", columns[0])
    found = docs.withColumn("matches", F.concat(*columns))
    return found.withColumn("matches", resolve_overlaps(F.col("matches"))) if resolve else found


def exact_matches(docs: DataFrame, text: str, forms: DataFrame) -> DataFrame:
    """``docs`` with ``matches``: all exact matches of every text, overlapping ones, too; see ``search``."""
    return search(docs, text, forms, resolve=False)


_FIELDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
_NAMES = [x.split(":")[0] for x in MATCH[7:-1].split(",")]
#: The worker's last searchers by what they were built of.
_SEARCHERS: dict[tuple, tuple[Scanner, NearMisses | None]] = {}


def _searcher(block: list[tuple], fuzzy: bool, threshold: float, exclusions: tuple[str, ...]) -> tuple[Scanner, NearMisses | None]:
    key = (hashlib.sha256(repr(block).encode()).digest(), fuzzy, threshold, exclusions)
    if key not in _SEARCHERS:
        if len(_SEARCHERS) > 3:
            _SEARCHERS.clear()
        scanner = Scanner(block)
        _SEARCHERS[key] = scanner, NearMisses(scanner.forms, threshold, frozenset(exclusions)) if fuzzy else None
    return _SEARCHERS[key]


def _search_udf(shared, fuzzy: bool, threshold: float, exclusions: tuple[str, ...], resolve: bool):
    @F.arrow_udf(f"array<{MATCH}>")
    def find(normal: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scanner, near = _searcher(shared.value, fuzzy, threshold, exclusions)
        for texts, raw in normal:
            low = [(t or "").lower() for t in raw.to_pylist()] if near else []
            tokens = near.learn(low) if near else []
            bounds, rows = [0], []
            for k, t in enumerate(texts.to_pylist()):
                found = scanner.find(t) if t else []
                if near and low[k]:
                    found += near.find(low[k], tokens[k], scanner.forms)
                if resolve and len(found) > 1:
                    found = disjoint(found)
                rows += found
                bounds.append(len(rows))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS, strict=True)], names=_NAMES)
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    return find


def resolve_overlaps(matches: Column) -> Column:
    """Greedy choice of disjoint spans: exact before fuzzy, longer before shorter, more before less similar; by position after.

    Spans are half-open.  Ties fall to the earlier position, then the keyword, so the result is the same however
    the data are partitioned.
    """
    ranked = F.transform(
        matches,
        lambda m: F.struct(
            F.when(m["match_type"] == "exact", 0).otherwise(1).alias("k"), (m["position"] - m["end_position"]).alias("l"), (-m["similarity"]).alias("s"),
            m["position"].alias("p"), m["keyword_canonical"].alias("c"), m.alias("m"),
        ),
    )
    empty = F.array().cast(f"array<{MATCH}>")
    kept = F.aggregate(
        F.array_sort(ranked), empty,
        lambda acc, c: F.when(F.exists(acc, lambda a: F.greatest(a["position"], c["m"]["position"]) < F.least(a["end_position"], c["m"]["end_position"])), acc).otherwise(F.concat(acc, F.array(c["m"]))),
    )
    by_place = F.array_sort(F.transform(kept, lambda m: F.struct(m["position"].alias("p"), m["end_position"].alias("e"), m.alias("m"))))
    return F.transform(by_place, lambda x: x["m"])


def tokens(text: Column) -> Column:
    """``ARRAY<STRUCT<tok, brk>>``: lower-case tokens stripped of edge signs, and whether a clause ends behind each."""
    raw = words(F.lower(text))
    out = F.transform(raw, lambda t: F.struct(F.btrim(t, F.lit(EDGES)).alias("tok"), F.contains(F.lit(BREAKS), F.right(t, F.lit(1))).alias("brk")))
    return F.filter(out, lambda x: x["tok"] != "")


def ngrams(t: Column, sizes: list[int]) -> Column:
    """``ARRAY<STRUCT<n, gram>>`` of a column of tokens: runs that no clause end parts.

    ``t`` should be a column, not an expression, since every run refers to it.
    """

    def of_size(n: int) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        whole = F.filter(starts, lambda i: ~F.exists(F.slice(t, i, n - 1), lambda x: x["brk"])) if n > 1 else starts
        return F.transform(whole, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.transform(F.slice(t, i, n), lambda x: x["tok"]), " ").alias("gram")))

    parts = [of_size(n) for n in sizes]
    return F.concat(*parts)


def fuzzy_matches(docs: DataFrame, key: str, text: str, forms: DataFrame, threshold: float = 85.0, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """``(key, gram, canonical, category, similarity, levenshtein_distance, times)``: near misses in every document that overlap no better match."""
    m = search(docs.select(key, F.col(text).alias("text")), "text", forms, True, threshold, exclusions).select(key, F.explode("matches").alias("m")).where("m.match_type = 'fuzzy'")
    return (
        m.select(key, F.col("m.keyword_found").alias("gram"), F.col("m.keyword_canonical").alias("canonical"), "m.category", "m.similarity", "m.levenshtein_distance")
        .groupBy(key, "gram", "canonical", "category", "similarity", "levenshtein_distance").agg(F.count(F.lit(1)).alias("times"))
    )
