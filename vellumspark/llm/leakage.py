"""Evaluation texts leaking into training text (problem 7).

Items and documents are turned into templates: numbers, names and units become typed placeholders (names and
units are learned from all items at once, by hash, so case and accents don't matter).  Windows of template words are
hashed; the items' windows are joined with every document's windows, and where several of them lie on one
diagonal the words themselves are aligned.  A run of at least ``LEAST_RUN`` words with at most one edit in
``ONE_IN`` is a leak; a run that holds only between the templates, with slots filled consistently (one old
value, one new value), is a re-parameterised question.

Windows of placeholders alone say nothing about a template and seed none; equal windows are counted by diagonal in
pieces of bounded size, so a table of numbers against many numeric items takes time, but no memory.

The items are the stated query set: what their words are is learned once over all of them; their index reaches the
executors in blocks of bounded size (one for some 10,000 items), every document is read once a block, no text is
shuffled, and no pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import code_points, slices
from .words import hashed_words, mix, windows

LEAST_RUN = 18
ONE_IN = 6
#: Template words in a window: a run of 18 words with 3 edits holds at least one whole window of 4.
WINDOW = 4
#: Windows equal word for word that call for an alignment of words: 18 words with 3 edits have at least 3 of them.
LEAST_EXACT = 3
#: So many equal telling template windows on one diagonal band call for an alignment of templates: as few as of words, so that no run is lost.
TEMPLATE_WINDOWS = 3
BAND = 12
#: Words in a block of items: the index of a block takes some 60 MB.
BLOCK_WORDS = 1_000_000
#: Pairs of equal windows that are unfolded at once.
PIECE = 2_000_000
#: So many times a word must follow a number to be a unit.
UNIT_TIMES = 3
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _capitals(texts: pa.Array, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mask of the words that begin with a capital but not a sentence."""
    points, rows = code_points(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = rows[row] + starts
    here = points[at] if len(at) else np.empty(0, np.uint32)
    up = np.array([chr(c).isupper() for c in here.tolist()], bool)
    begin = np.zeros(len(at), bool)
    begin[bounds[:-1][bounds[:-1] < len(at)]] = True
    for i in np.flatnonzero(up).tolist():
        before = points[max(at[i] - 3, 0) : at[i]].tolist()
        begin[i] |= any(chr(c) in ".?!;:\n" for c in before)
    return up & ~begin


def _word_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of names ('n') and of words behind numbers ('u') in a column of item texts, by hash."""
    for batch in slices(batches, 0):
        words, bounds, starts, number = hashed_words(batch.column(0))
        names, n = np.unique(words[_capitals(batch.column(0), bounds, starts) & ~number], return_counts=True)
        after = np.flatnonzero(number[:-1]) + 1 if len(number) else np.empty(0, np.int64)
        units, m = np.unique(words[after][~number[after]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(["n"] * len(names) + ["u"] * len(units), pa.string()), pa.array(np.concatenate([names, units]).view(np.int64)), pa.array(np.concatenate([n, m]).astype(np.int64))], names=["kind", "word", "n"])


def word_types(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(names, units) of all items, sorted hashes: bounded by the distinct words of the query set."""
    counts = items.where("text is not null").select("text").mapInArrow(_word_types, "kind string, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    rows = counts.where((F.col("kind") == "n") | (F.col("n") >= UNIT_TIMES)).select("kind", "word").collect()
    of = lambda kind: np.unique(np.array([r["word"] for r in rows if r["kind"] == kind], np.int64).view(np.uint64))
    names = of("n")
    return names, np.setdiff1d(of("u"), names)


class Items:
    """A block of items, ready for the search; ``names`` and ``units`` are those of all items."""

    def __init__(self, ids: list[int], texts: list[str], names: np.ndarray, units: np.ndarray):
        self.names, self.units = names, units
        self.ids = np.array(ids, np.int64)
        self.words, self.bounds, _, number = hashed_words(pa.array(texts, pa.string()))
        self.template = self.canonical(self.words, number)
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.index = [self._sorted(*w) for w in self.seeds(self.words, self.template, self.bounds)]

    @staticmethod
    def _sorted(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return key[order], at[order]

    @staticmethod
    def seeds(words: np.ndarray, template: np.ndarray, bounds: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Windows (key, place) of the words, and those of the template that hold a word besides placeholders."""
        key, at = windows(template, bounds, WINDOW)
        literal = np.concatenate([[0], np.cumsum(~np.isin(template, [NUMBER, NAME, UNIT]))])
        telling = literal[at + WINDOW] > literal[at]
        return windows(words, bounds, WINDOW), (key[telling], at[telling])

    def canonical(self, words: np.ndarray, number: np.ndarray) -> np.ndarray:
        out = words.copy()
        if len(self.units):
            out[np.isin(words, self.units)] = UNIT
        if len(self.names):
            out[np.isin(words, self.names)] = NAME
        out[number] = NUMBER
        return out


def _diagonals(items: Items, words: np.ndarray, template: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, diagonal, equal windows of words, of templates): counted piece by piece, sorted."""
    parts: list[np.ndarray] = []
    for kind, ((keys, places), (key, at)) in enumerate(zip(items.index, Items.seeds(words, template, bounds), strict=True)):
        if not len(keys) or not len(key):
            continue
        low = np.searchsorted(keys, key, "left")
        hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == key)
        low, j = low[hit], at[hit]
        count = np.searchsorted(keys, key[hit], "right") - low
        total = np.concatenate([[0], np.cumsum(count)])
        for start in range(0, int(total[-1]), PIECE):
            end = min(start + PIECE, int(total[-1]))
            n = np.arange(start, end)
            which = np.searchsorted(total, n, "right") - 1
            i = places[low[which] + n - total[which]]
            place = j[which]
            row, item = np.searchsorted(bounds, place, "right") - 1, items.row[i]
            diagonal = (place - bounds[row]) - (i - items.bounds[item])
            seen, times = np.unique(np.stack([row, item, diagonal], 1), axis=0, return_counts=True)
            parts.append(np.column_stack([seen, times * (kind == 0), times * (kind == 1)]))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    rows = np.concatenate(parts)
    seen, inverse = np.unique(rows[:, :3], axis=0, return_inverse=True)
    sums = [np.bincount(inverse.ravel(), weights=rows[:, k], minlength=len(seen)).astype(np.int64) for k in (3, 4)]
    return seen[:, 0], seen[:, 1], seen[:, 2], *sums


def _align(a: np.ndarray, b: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Local alignment of two word lists near the diagonal j = i + shift: pairs (i, j), -1 for a gap."""
    n, m, width = len(a), len(b), 2 * BAND + 1
    a, b = a.tolist(), b.tolist()
    score = [[0] * (width + 2) for _ in range(n + 1)]
    move = [[0] * (width + 2) for _ in range(n + 1)]
    best = (0, 0, 0)
    for i in range(1, n + 1):
        up, row, step, x = score[i - 1], score[i], move[i], a[i - 1]
        for k in range(1, width + 1):
            j = i + shift + k - BAND - 1  # 1-based in b
            if j < 1 or j > m:
                continue
            s, mv = up[k] + (1 if x == b[j - 1] else -1), 1
            if up[k + 1] - 1 > s:
                s, mv = up[k + 1] - 1, 2  # a word of a left out
            if row[k - 1] - 1 > s:
                s, mv = row[k - 1] - 1, 3  # a word of b added
            if s <= 0:
                s, mv = 0, 0
            row[k], step[k] = s, mv
            if s > best[0]:
                best = (s, i, k)
    path = []
    _, i, k = best
    while i > 0 and 0 < k <= width and move[i][k]:
        j = i + shift + k - BAND - 1
        mv = move[i][k]
        if mv == 1:
            path.append((i - 1, j - 1))
            i -= 1
        elif mv == 2:
            path.append((i - 1, -1))
            i, k = i - 1, k + 1
        else:
            path.append((-1, j - 1))
            k -= 1
    return path[::-1]


def _dense(a: np.ndarray, b: np.ndarray, shift: int, near: int = 5) -> bool:
    """Whether some LEAST_RUN words of a find nearly as many equal ones close to the diagonal: needed for any run.

    Three edits shift the words of a run by three places at most, and take away three of them.
    """
    n, m = len(a), len(b)
    found = np.zeros(n, bool)
    for k in range(-near, near + 1):
        low, high = max(0, -shift - k), min(n, m - shift - k)
        if low < high:
            found[low:high] |= a[low:high] == b[low + shift + k : high + shift + k]
    total = np.concatenate([[0], np.cumsum(found)])
    return bool((total[LEAST_RUN:] - total[:-LEAST_RUN]).max(initial=0) >= LEAST_RUN - LEAST_RUN // ONE_IN)


def longest_run(path: list[tuple[int, int]], same: list[bool]) -> tuple[int, int]:
    """(words, edits) of the longest stretch of an alignment whose edits are at most one in ONE_IN of its words."""
    # Position sums of (1 - ONE_IN * edit) + the half word of tolerance: the longest stretch with a sum not below it.
    total, sums = 0, [0]
    for ok in same:
        total += 1 if ok else 1 - ONE_IN
        sums.append(total)
    slack = -(ONE_IN // 2)
    best = (0, 0)
    n = len(same)
    for i in range(n):
        if n - i <= best[0]:
            break
        if not same[i]:
            continue
        for j in range(n, i + best[0], -1):
            if same[j - 1] and sums[j] - sums[i] >= slack:
                words = j - i
                best = (words, sum(not x for x in same[i:j]))
                break
    return best


def _slots(path: list[tuple[int, int]], a: np.ndarray, b: np.ndarray, ta: np.ndarray) -> bool:
    """Whether placeholders were filled consistently: an old value always became the same new one."""
    seen: dict[int, int] = {}
    for i, j in path:
        if i >= 0 and j >= 0 and ta[i] in (NUMBER, NAME, UNIT) and seen.setdefault(int(a[i]), int(b[j])) != int(b[j]):
            return False
    return True


def find(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, str]]:
    """(row, item, run, edits, kind) of the leaks in a batch; kind is 'verbatim' or 'reparameterised'."""
    words, bounds, _, number = hashed_words(texts)
    template = items.canonical(words, number)
    row, item, diagonal, exact, alike = _diagonals(items, words, template, bounds)
    if not len(row):
        return []
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > BAND // 2)])
    first = np.flatnonzero(new)
    exact_of, alike_of = np.add.reduceat(exact, first), np.add.reduceat(alike, first)
    until = np.concatenate([first[1:], [len(row)]])
    out: dict[tuple[int, int], tuple[int, int, str]] = {}
    for g in np.flatnonzero((exact_of >= LEAST_EXACT) | (alike_of >= TEMPLATE_WINDOWS)).tolist():
        r, it = int(row[first[g]]), int(item[first[g]])
        here = slice(first[g], until[g])
        weight = np.cumsum(exact[here] + alike[here])
        middle = int(diagonal[here][np.searchsorted(weight, (weight[-1] + 1) // 2)])
        ia, ib = items.bounds[it], items.bounds[it + 1]
        ja = max(bounds[r], bounds[r] + middle - BAND)
        jb = min(bounds[r + 1], bounds[r] + middle + (ib - ia) + BAND)
        a, b, ta, tb = items.words[ia:ib], words[ja:jb], items.template[ia:ib], template[ja:jb]
        if len(a) < LEAST_RUN or len(b) < LEAST_RUN:
            continue
        shift = int(bounds[r] + middle - ja)
        kinds = []
        if exact_of[g] >= LEAST_EXACT:
            kinds.append(("verbatim", a, b))
        if alike_of[g] >= TEMPLATE_WINDOWS:
            kinds.append(("reparameterised", ta, tb))
        for kind, x, y in kinds:
            if not _dense(x, y, shift):
                continue
            path = _align(x, y, shift)
            run, edits = longest_run(path, [p >= 0 and q >= 0 and x[p] == y[q] for p, q in path])
            if run >= LEAST_RUN and (kind == "verbatim" or _slots(path, a, b, ta)):
                old = out.get((r, it))
                if old is None or (old[2] != "verbatim" and kind == "verbatim") or (old[2] == kind and run > old[0]):
                    out[r, it] = run, edits, kind
                break
    return [(r, it, *v) for (r, it), v in out.items()]


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Rows ``(doc_id, item_id, run_words, edits, kind)``, one for each document and item that leaked into it.

    Null or empty texts hold no leak; items under ``LEAST_RUN`` words can't leak; repeated rows give repeated
    output; extra columns are left aside.  Empty items or documents give an empty result.
    """
    docs = documents.where("text is not null").select("doc_id", F.col("text").alias("__text"))
    schema = "doc_id long, item_id long, run_words int, edits int, kind string"
    spark = documents.sparkSession
    out = None
    names, units = word_types(eval_items)
    ordered = eval_items.where("text is not null").select("item_id", "text").orderBy("item_id", "text")
    block: list = []
    size = 0

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], names, units))  # bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, 1):
                found = find(batch.column(1), items)
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(items.ids[[f[1] for f in found]] if found else [], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.string())],
                    names=["doc_id", "item_id", "run_words", "edits", "kind"],
                )

        return docs.mapInArrow(run, schema)

    for r in ordered.toLocalIterator():
        block.append(r)
        size += len(r["text"].split())
        if size >= BLOCK_WORDS:
            out = search(block) if out is None else out.unionAll(search(block))
            block, size = [], 0
    if block or out is None:
        out = search(block) if out is None else out.unionAll(search(block))
    return out
