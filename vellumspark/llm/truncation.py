"""Text cut off by field limits (problem 8).

Near-copies come first.  Every text is signed by min-hash bands over its five-word shingles, as a whole and for its
heads of 32, 128, 512 ... words: a copy that was cut, at whatever length, is a head of its original, so containment
becomes similarity at the longest head that the copy holds.  Texts that end without a closing mark look for longer
texts in their buckets; a pair is verified (similarity of 0.8 or more between the shorter text and the stretch of the
longer one that it lies on) and aligned, and the copy whose alignment ends inside a word or sentence of the other is cut.

Texts that no pair decides are scored by the terminality of their closing words: of the closing line, how often lines
that begin so end there, and of the last word, how often a sentence or line ends behind it.

In the first round a bucket's open texts meet its longest text only, so a hot group of copies costs one pair an open
text.  All texts that no near-copy has shown to be cut go on, also those whose near-copies don't tell or end there: round k
adds some 16 ** k drawn partners a bucket, so small buckets, where true pairs meet, are exhausted first, and after log16 of
the largest bucket's size no partner is left out.  So a verdict doesn't depend on the draw.  Exact copies share one text id
and are compared once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chars import code_points, slices
from .scanned import _classes, _distinct, _spans, _text_of
from .words import hashed_words, mix, windows

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5  # whole texts: finds a pair of similarity 0.8 with probability 0.9996
HEAD_BANDS, HEAD_ROWS = 8, 4  # heads: 0.985 at a similarity of 0.8, all pairs where the copy's head is unaltered
#: Words of the shortest head, and the factor to the next one.
HEAD, HEAD_STEP = 32, 4
#: Sets of keys or ids up to this number are broadcast; larger ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: By so much the partners of an open text grow from round to round.
MORE = 16
#: Words behind the last common shingle within which the end of a copy is looked for.
END_REACH = 8
#: Least share of all documents that end with a closing line, for the line to be learned (at most 10,000 lines).
LINE_SHARE = 1e-4
#: A closing line has so many words at most.
LINE_WORDS = 12
#: Least share of all words that a word has to get a terminality (at most one million words).
WORD_SHARE = 1e-6
#: A line that begins like a closing line ends there at least so often.
LINE_CLOSING = 0.6
#: A last word this often at the end of a sentence or line closes a short line.
CLOSING = 0.995
BINS = BANDS * ROWS
#: From so many letters on, a text's id has more bits for the length.
LONG = 2**19
_SEED, _EMPTY = np.uint64(0x5851F42D4C957F2D), np.uint64(2**64 - 1)
# Marks that close a sentence, marks that may follow them, marks put after a cut.
_STOPS, _BEHIND = ".!?。", "\"'”’»)]"
_DOTS = re.compile(r"\s*(?:\.{2,}|…)\s*")
_AFTER_CUT = re.compile(r"\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|<\s*(?:\.{2,}|…)\s*>|…|\.{3,})\s*")
_OPENING = {"]": "[", ")": "(", ">": "<"}
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"\s*(?:[-–—*•+]|\d{1,2}[.)])\s+")
_FIGURE = re.compile(r"\d[\d.,/]*\d|\d")
LOST = "�"


def _closed(text: str) -> bool:
    """Whether a text ends with a closing mark, behind which quotes and brackets may stand."""
    return text.rstrip(_BEHIND)[-1:] in tuple(_STOPS)


def _cut_at(text: str) -> int | None:
    """Where the mark of cutting at the end of a text begins; None where there is none."""
    end = text.rstrip()
    if end.endswith("…"):
        return len(end[:-1].rstrip())
    if end.endswith("..."):
        return len(end.rstrip(".").rstrip())
    if end[-1:] in _OPENING:
        at = end.rfind(_OPENING[end[-1]])
        if at >= 0 and _DOTS.fullmatch(end, at + 1, len(end) - 1):
            return len(end[:at].rstrip())
    return None


def _last_word(text: str, end: int) -> str:
    """The last word before ``end``, in lower case; '' for none."""
    a = end
    while a and not text[a - 1].isalpha():
        a -= 1
    b = a
    while a and text[a - 1].isalpha():
        a -= 1
    return text[a:b].lower()


def line_form(line: str) -> str:
    """A line with its numbers masked."""
    return _FIGURE.sub("#", " ".join(line.split()))


def _tail(text: str) -> tuple[str, str]:
    """(what stands before the last line, the last line), without outer blanks."""
    text = text.rstrip()
    at = max(text.rfind("\n"), text.rfind("\r"))
    return text[: at + 1].rstrip(), text[at + 1 :].strip()


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts: documents; short last lines by whether the text before them is closed; list lines; words and their ends."""
    out: Counter = Counter()
    for batch in slices(batches, 0):
        for text in batch.column(0).to_pylist():
            if not text or not text.strip():
                continue
            out["d", ""] += 1
            before, last = _tail(text)
            if before and len(last.split()) <= LINE_WORDS:
                form = line_form(last)
                out["l", form] += 1
                # list items stand behind other items: look at the text before the list
                while before and _BULLET.match(_tail(before)[1]):
                    before = _tail(before)[0]
                out["c", form] += _closed(before) and _cut_at(before) is None
            for line in text.split("\n"):
                if line and _BULLET.match(line) and len(line.split()) <= LINE_WORDS:
                    out["b", line_form(line)] += 1
            at = _cut_at(text)
            if at is not None and (w := _last_word(text, at)):
                out["e", w] += 1
        _count_words(batch.column(0), out)
        if len(out) > 500_000:
            yield _rows(out)
            out = Counter()
    yield _rows(out)


def _count_words(texts: pa.Array, out: Counter) -> None:
    """Adds, for each word of the batch, how often it stands ('w') and how often it closes a sentence or line ('z')."""
    letter, blank, _, lower, _ = _classes()
    points, bounds = code_points(texts)
    if not len(points):
        return
    low = np.minimum(points, 0x2FFF)
    points = np.where(points < 0x3000, lower[low], points).astype(np.uint32)
    starts, ends = _spans(letter[low] & (points < 0x3000), bounds)
    _, first, n, inverse = _distinct(points, starts, ends)
    names = [_text_of(points, starts[k], ends[k]) for k in first]
    # the end of the text itself tells nothing: it may be a cut
    row_end = bounds[np.searchsorted(bounds, starts, side="right")]
    one, two = np.minimum(ends, len(points) - 1), np.minimum(ends + 1, len(points) - 1)
    closes = (ends < row_end) & ((low[one] == 10) | np.isin(low[one], [0x21, 0x2E, 0x3F]) & (ends + 1 < row_end) & blank[low[two]])
    out.update({("w", w): int(k) for w, k in zip(names, n, strict=True)})
    out.update({("z", w): int(k) for w, k in zip(names, np.bincount(inverse[closes], minlength=len(names)), strict=True) if k})


def _rows(out: Counter) -> pa.RecordBatch:
    items = list(out.items())
    return pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in items], pa.string()), pa.array([k for (_, k), _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["kind", "key", "n"])


class Closings:
    """What the documents' ends taught: markers put behind a cut, closing lines, terminality of lines and words."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        by: dict[str, dict[str, int]] = {k: {} for k in "dlcbewz"}
        for kind, key, n in counts:
            by[kind][key] = n
        docs = by["d"].get("", 0)
        least = max(3, docs * LINE_SHARE)
        closed = {k: by["c"].get(k, 0) / n for k, n in by["l"].items()}
        known = {k for k, n in by["l"].items() if n >= least}
        self.markers = {k for k in known if closed[k] < 0.4 and not _closed(k)}
        items = {k for k, n in by["b"].items() if n >= least}
        #: Lines whose terminality is to be counted.
        self.lines = {k for k in known if closed[k] >= 0.6} | items
        self.lasting = {w: n / by["w"][w] for w, n in by["z"].items() if w in by["w"]}
        # words that are mostly followed by dots: "and so on"
        self.open_list = {w for w, n in by["e"].items() if n >= 3 and n >= 0.2 * by["w"].get(w, n)}
        #: By line form: how often lines that begin so end there.
        self.terminal: dict[str, float] = {}

    def peeled(self, text: str) -> str:
        """The text without the lines put behind a cut."""
        text = text.rstrip()
        while text:
            before, last = _tail(text)
            if not before or line_form(last) not in self.markers:
                break
            text = before
        return text

    def score(self, text: str) -> float:
        """How surely the closing words of a text, which no closing mark follows, end it."""
        before, last = _tail(text)
        by_line = self.terminal.get(line_form(last))
        if by_line is not None:
            return by_line
        words = _WORD.findall(last)
        by_word = self.lasting.get(words[-1].lower(), 0.0) if words else 0.0
        if last.isupper() and before:
            return by_word  # a heading
        short = before and len(last.split()) <= LINE_WORDS // 2 and last[-1].isalpha()
        return by_word if short and by_word >= CLOSING else 0.0

    def is_open(self, text: str) -> bool:
        """Whether a text ends without a closing mark, or with one that may be a figure's or a mark of cutting."""
        text = self.peeled(text)
        return bool(text) and (not _closed(text) or _cut_at(text) is not None or re.search(r"\d[.,]$", text[-2:]) is not None)

    def is_cut(self, text: str) -> bool:
        """Whether a text that no copy decides ends inside a word or a sentence."""
        text = self.peeled(text)
        if not text:
            return False
        if text[-1] == LOST:
            return True
        at = _cut_at(text)
        if at is not None:
            return at > 0 and _last_word(text, at) not in self.open_list and not _closed(text[:at])
        return not _closed(text) and self.score(text) < LINE_CLOSING


def learn(texts: DataFrame) -> Closings:
    """Closing lines and word terminality over all rows of a one-column DataFrame; the lines' terminality follows in ``sign``."""
    # Written once, since totals and thresholds both read them: the texts are passed through once.
    counts = cut_lineage(texts.mapInArrow(_collect, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = F.broadcast(counts.groupBy().agg(F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("n"))), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.when(F.col("kind") == "w", F.col("n"))), F.lit(0)).alias("words")))  # one row
    kept = counts.join(totals).where(
        (F.col("kind") == "d")
        | (F.col("kind").isin("l", "c", "b", "e") & (F.col("n") >= F.greatest(F.col("docs") * LINE_SHARE, F.lit(2))))
        | (F.col("kind").isin("w", "z") & (F.col("n") >= F.greatest(F.col("words") * WORD_SHARE, F.lit(2))))
    )
    # Bounded by the shares.
    return Closings([tuple(r) for r in kept.select("kind", "key", "n").collect()])


def text_id(text: Column) -> Column:
    """One id for equal texts, longer texts having the larger one: the length, then bits of a hash (fewer for the few texts above LONG)."""
    size, bits = F.length(text).cast("long"), F.xxhash64(text)
    long = F.lit(2**62).bitwiseOR(F.shiftleft(size, 31)).bitwiseOR(F.shiftrightunsigned(bits, 33))
    return F.when(size >= LONG, long).otherwise(F.shiftleft(size, 43).bitwiseOR(F.shiftrightunsigned(bits, 21)))


def heads(n_windows: int) -> list[int]:
    """The numbers of shingles of the heads that a text of ``n_windows`` shingles holds."""
    out, size = [], HEAD - SHINGLE + 1
    while size <= n_windows:
        out.append(size)
        size = (size + SHINGLE - 1) * HEAD_STEP - SHINGLE + 1
    return out


def _banded(values: np.ndarray, bands: int, rows: int, salt: np.ndarray | int) -> np.ndarray:
    """Band keys, one column a band, of min-hash values (one row a text)."""
    key = np.full((len(values), bands), np.uint64(0), np.uint64)
    key += np.asarray(salt, np.uint64).reshape(-1, 1)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            b = k // rows
            key[:, b] = mix((key[:, b] + np.uint64(b)) * np.uint64(31) + values[:, k])
    return key


def _binned(key: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
    """Least hash in every one of BINS bins of each piece: one permutation, whose bins stand for as many min-hashes."""
    x = mix(key ^ _SEED)
    place = ((x >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    out = np.full(n * BINS, _EMPTY)
    np.minimum.at(out, piece * BINS + place.astype(np.int64), x)
    return out.reshape(n, BINS)


def _filled(bins: np.ndarray) -> np.ndarray:
    """Every empty bin takes the value of a filled one, tried in an order that is drawn for each bin and the same for all texts."""
    out = bins.copy()
    row, col = np.nonzero(bins == _EMPTY)
    step = 0
    while len(row):
        step += 1
        other = (mix((col.astype(np.uint64) + np.uint64(1)) * np.uint64(1_000_003) + np.uint64(step)) % np.uint64(BINS)).astype(np.int64)
        value = bins[row, other]
        got = value != _EMPTY
        out[row[got], col[got]] = mix(value[got] + np.uint64(step))
        row, col = row[~got], col[~got]
    return out


def signatures(texts: pa.Array) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For every text its band keys as a whole and by head (shortest first)."""
    words, bounds, _, _ = hashed_words(texts)
    key, at = windows(words, bounds, SHINGLE)
    row = np.searchsorted(bounds, at, "right") - 1
    count = np.bincount(row, minlength=len(texts))
    out: list[tuple[np.ndarray, list[np.ndarray]]] = [(np.empty(0, np.uint64), [])] * len(texts)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    # The shingles fall into pieces between the ends of the heads; a head's bins are the least of its pieces'.
    steps = np.array(heads(int(count.max())), np.int64)
    pieces = np.searchsorted(steps, count[has], "left") + 1
    offset = np.concatenate([[0], np.cumsum(pieces)])
    owner = np.zeros(len(texts), np.int64)
    owner[has] = offset[:-1]
    inside = np.arange(len(key)) - (np.cumsum(count) - count)[row]
    bins = _binned(key, owner[row] + np.searchsorted(steps, inside, "right"), int(offset[-1]))
    for k in range(1, int(pieces.max())):
        later = offset[:-1][pieces > k] + k
        bins[later] = np.minimum(bins[later], bins[later - 1])
    bins = _filled(bins)
    whole = _banded(bins[offset[1:] - 1], BANDS, ROWS, 0)
    number = np.searchsorted(steps, count[has], "right")  # heads that the text holds
    which = np.repeat(np.arange(len(has)), number)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
    part = _banded(bins[offset[which] + nth], HEAD_BANDS, HEAD_ROWS, steps[nth] if len(steps) else 0)
    ends = np.concatenate([[0], np.cumsum(number)])
    for k, r in enumerate(has.tolist()):
        out[r] = whole[k], list(part[ends[k] : ends[k + 1]])
    return out


def sign(docs: DataFrame, closings: Closings) -> DataFrame:
    """Written table of two kinds of rows: ``(tid, keys, own)`` of texts, and ``(form, exact, begins)`` of closing lines.

    ``keys`` are all band keys of a text, ``own`` those that it looks for longer texts with: of the whole and of its
    longest head, where its end is open, else none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(closings)  # bounded by the shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        first = {f.split(" ")[0] for f in c.lines}
        exact, begins = Counter(), Counter()
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            keys, own = [], []
            for text, (whole, parts) in zip(texts, signatures(batch.column(1)), strict=True):
                keys.append(np.concatenate([whole, *parts]).view(np.int64))
                own.append(np.concatenate([whole, *parts[-1:]]).view(np.int64) if len(whole) and c.is_open(text) else np.empty(0, np.int64))
                for line in text.split("\n"):
                    start = line.split(None, 1)[:1]
                    if not start or (start[0] if start[0].isalpha() else line_form(start[0])) not in first:
                        continue
                    tokens = line_form(line).split(" ")
                    for k in range(1, min(len(tokens), LINE_WORDS) + 1):
                        form = " ".join(tokens[:k])
                        if form in c.lines:
                            begins[form] += 1
                            exact[form] += k == len(tokens)
            ragged = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in x])]), pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64()))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(keys), ragged(own), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["tid", "keys", "own", "form", "exact", "begins"])
        forms = list(begins)
        n = len(forms)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), pa.array(forms, pa.string()), pa.array([exact[f] for f in forms], pa.int64()), pa.array([begins[f] for f in forms], pa.int64())],
            names=["tid", "keys", "own", "form", "exact", "begins"],
        )

    signed = docs.select(text_id(F.col("text")).alias("tid"), "text").mapInArrow(run, "tid long, keys array<long>, own array<long>, form string, exact long, begins long")
    return cut_lineage(signed)


def terminality(signed: DataFrame) -> dict[str, float]:
    """By closing line, how often lines that begin so end there; at most as many as ``Closings.lines``."""
    rows = signed.where("form is not null").groupBy("form").agg((F.sum("exact") / F.sum("begins")).alias("t"))
    return {r["form"]: r["t"] for r in rows.collect()}


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it has at most BROADCAST_KEYS rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def buckets(signed: DataFrame) -> DataFrame:
    """Written rows ``(key, tid, asks)``: the texts of every bucket that holds an open text and a longer one."""
    texts = signed.where("tid is not null")
    asked = texts.select(F.explode("own").alias("key")).distinct()
    asks = texts.select("tid", F.explode("own").alias("key")).select("key", "tid", F.lit(True).alias("asks"))
    held = texts.select("tid", F.explode("keys").alias("key")).join(_small(asked), "key", "left_semi").select("key", "tid", F.lit(False).alias("asks"))
    rows = cut_lineage(held.unionAll(asks).groupBy("key", "tid").agg(F.max("asks").alias("asks")))
    shared = rows.groupBy("key").agg(F.min(F.when(F.col("asks"), F.col("tid"))).alias("low"), F.max("tid").alias("high")).where("low < high").select("key")
    return cut_lineage(rows.join(_small(shared), "key", "left_semi"))


def verdicts(docs: DataFrame, signed: DataFrame, closings: Closings) -> DataFrame:
    """``(tid, early)``, one row for each text that near-copies decide: whether it ends inside a word or sentence of any of them."""
    spark = docs.sparkSession
    rows = buckets(signed)
    shared = spark.sparkContext.broadcast(closings)
    # Only the texts of the buckets are held, one of equal ones.
    wanted = _small(rows.select("tid").distinct())
    texts = docs.select(text_id(F.col("text")).alias("tid"), "text").join(wanted, "tid", "left_semi").dropDuplicates(["tid"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # without the lines behind a cut, as they are aligned
            peeled = pa.array([shared.value.peeled(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_shingles(peeled), pa.binary())], names=["tid", "text", "shingles"])

    held = cut_lineage(texts.select("tid", "text").mapInArrow(shingled, "tid long, text string, shingles binary"))
    texts, sets = held.select("tid", "text"), held.select("tid", "shingles")
    contained = F.pandas_udf(lambda a, b: pd.Series([_contained(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")

    def judged(short: pd.Series, full: pd.Series) -> pd.Series:
        return pd.Series([align_end(shared.value.peeled(a), shared.value.peeled(b)) for a, b in zip(short, full, strict=True)], dtype="object").astype("Int8")

    judge = F.pandas_udf(judged, "byte")
    out = spark.createDataFrame([], "tid long, early boolean")
    asking = rows.where("asks").select("key", "tid")
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("tid").alias("top"))
    members = cut_lineage(rows.select("key", F.col("tid").alias("other")).join(size, "key"))
    # A number in [0, 1) that every text draws for each bucket tells from which round on it is a partner there.
    draw = F.pmod(F.xxhash64("key", "other"), F.lit(2**40)) / 2.0**40
    members = members.withColumn("round", F.when(F.col("other") == F.col("top"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(float(MORE), F.greatest(draw * F.col("n"), F.lit(1.0)))))).cast("int"))
    last = members.agg(F.max("round")).first()[0]
    for k in range((last if last is not None else -1) + 1):
        pairs = asking.join(members.where(F.col("round") == k).select("key", "other"), "key").where("tid < other").select("tid", "other").distinct()
        # The sets of shingles leave the near-copies, whose texts are aligned.
        near = pairs.join(sets.withColumnRenamed("shingles", "a"), "tid").join(sets.select(F.col("tid").alias("other"), F.col("shingles").alias("b")), "other").where(contained("a", "b")).select("tid", "other")
        near = cut_lineage(near)
        if near.isEmpty():
            continue
        both = near.join(texts.withColumnRenamed("text", "short"), "tid").join(texts.select(F.col("tid").alias("other"), F.col("text").alias("full")), "other")
        found = cut_lineage(both.select("tid", judge("short", "full").alias("v")).where("v is not null").groupBy("tid").agg(F.max(F.when(F.col("v") < 2, F.col("v"))).alias("v")))
        out = out.unionAll(found.where("v is not null").select("tid", (F.col("v") == 1).alias("early")))
        # Only what is cut for sure is settled: others may yet meet a near-copy that goes on.
        settled = found.where("v = 1").select("tid")
        if settled.isEmpty():
            continue
        asking = cut_lineage(asking.join(_small(settled), "tid", "left_anti"))
        if asking.isEmpty():
            break
    return out.groupBy("tid").agg(F.max("early").alias("early"))


def _shingles(texts: pa.Array) -> list[bytes]:
    """The sorted distinct shingles of every text, half of their bits each, as bytes.

    In slices: the arrays that they come from take some 70 bytes a letter.
    """
    out = []
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], 0):
        words, bounds, _, _ = hashed_words(part.column(0))
        key, at = windows(words, bounds, SHINGLE)
        place = np.searchsorted(at, bounds)
        out += [np.unique((key[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(place, place[1:], strict=False)]
    return out


def _contained(a: bytes, b: bytes) -> bool:
    """Whether a set of shingles lies so far in another that their texts may be near-copies."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    return bool(len(x) and len(y)) and int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) >= SIMILAR * len(x)


def align_end(short: str, full: str) -> int | None:
    """How ``short`` ends against its longer near-copy ``full``: 1 inside a word or sentence, 0 where a sentence or line ends,
    2 where the pair doesn't tell (both end there, or the shorter has an ending of its own); None if they are no near-copies."""
    words, bounds, starts, _ = hashed_words(pa.array([short, full], pa.string()))
    key, at = windows(words, bounds, SHINGLE)
    cut = np.searchsorted(at, bounds[1])
    a, b = key[:cut], key[cut:]
    if not len(a) or not len(b):
        return None
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if not len(i):
        return None
    # common shingles on one diagonal, which edits may shift by a tenth of the way
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = np.abs((j - i) - np.sort(j - i)[len(i) // 2]) <= SHINGLE + 0.1 * len(a)
    i, j = i[near], j[near]
    stretch = len(np.unique(b[j.min() : j.max() + 1]))
    n = len(np.unique(a))
    if len(i) < SIMILAR * (n + stretch - len(i)):
        return None
    wa, wb = words[: bounds[1]], words[bounds[1] :]
    sa, sb = starts[: bounds[1]], starts[bounds[1] :]
    behind = len(wa) - (int(i[-1]) + SHINGLE)  # words of the short text behind the last common shingle
    end = int(j[-1]) + SHINGLE - 1
    if behind > END_REACH:
        return 2
    word = lambda text, at: re.compile(r"\w+").match(text, int(at)).group()
    last = word(short, sa[-1])
    for shift in (0, -1, 1, -2, 2):
        at = end + behind + shift
        if not end <= at < len(wb):
            continue
        if wb[at] == wa[-1]:
            if at == len(wb) - 1:
                return 2
            mine = short[int(sa[-1]) + len(last) :]
            rest = full[int(sb[at]) + len(word(full, sb[at])) :]
            if not mine.strip():
                return 0 if re.match(r"\s*\n", rest) else 1
            if _AFTER_CUT.fullmatch(mine):
                return 1
            if _closed(mine.rstrip()):
                return 0 if re.match(r"[^\w\s]*[.!?。][^\w\s]*(?:\s|$)", rest) or re.match(r"\s*\n", rest) else 1
            return 1 if not re.match(r"[^\w\n]*\n", rest) else 0
        other = word(full, sb[at])
        if len(other) > len(last) and other.lower().startswith(last.lower()):
            return 1
    return 2


def cut_documents(documents: DataFrame) -> DataFrame:
    """Rows ``(doc_id, source, by_copy, by_closing)`` of the documents whose text was cut.

    ``by_copy`` tells that a longer near-copy goes on in the word or sentence; ``by_closing`` is null where a near-copy
    decides.  Null and blank texts are no case; texts are read whole; repeated rows of a document give one row each;
    extra columns are left aside.  An empty table gives an empty result.
    """
    docs = documents.where("text is not null and trim(text) <> ''").select("doc_id", "source", "text")
    spark = documents.sparkSession
    closings = learn(docs.select("text"))
    signed = sign(docs, closings)
    closings.terminal = terminality(signed)
    decided = verdicts(docs, signed, closings).withColumnRenamed("early", "by_copy")
    shared = spark.sparkContext.broadcast(closings)
    closing = F.pandas_udf(lambda s: s.map(shared.value.is_cut).astype(bool), "boolean")
    scored = docs.select("doc_id", "source", text_id(F.col("text")).alias("tid"), closing("text").alias("by_closing"))
    both = scored.join(_small(decided), "tid", "left")
    return both.select("doc_id", "source", F.coalesce("by_copy", F.lit(False)).alias("by_copy"), F.when(F.col("by_copy").isNull(), F.col("by_closing")).alias("by_closing")).where("by_copy or by_closing")


def share_by_source(documents: DataFrame) -> DataFrame:
    """``(source, n_docs, n_cut, cut_share)``: how often each source truncates; documents without text are not counted."""
    cut = cut_documents(documents).select("doc_id").distinct().withColumn("cut", F.lit(1))
    docs = documents.where("text is not null and trim(text) <> ''").select("doc_id", "source")
    return (
        docs.join(cut, "doc_id", "left").groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("cut"), F.lit(0)).alias("n_cut"))
        .select("source", "n_docs", "n_cut", F.round(F.col("n_cut") / F.col("n_docs"), 6).alias("cut_share"))
    )
