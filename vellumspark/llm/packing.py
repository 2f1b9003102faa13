"""Filling fixed-capacity containers with items (problem 6).

Planning works on the histogram of lengths, not on documents: at most ``capacity`` counts reach the driver, and
best-fit-decreasing runs over them, handling all containers with the same room at once.  The plan says which
ranks of a length go to which containers; documents then take their slots by joining on their rank within
their length.  Ranks are counted in salted parts of a length and offset by the parts before, so a length shared
by a third of all documents is never ranked in one task.

A text longer than the capacity is cut into pieces of exactly the capacity and a rest; no other text is split.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Vocabulary file of a public tokenizer (base64 token and rank on each line).
TOKENIZER = os.environ.get("VELLUM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one length that one salted part is meant to hold.
PART_ROWS = 200_000
#: Plans up to this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

_LOADED: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    """The tokenizer, loaded once a worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        if not os.path.exists(path):
            try:  # the same files, where the installed package holds them
                import public_tokenizers

                path_of = public_tokenizers.path(os.path.basename(path))
            except ImportError:
                path_of = path
        else:
            path_of = path
        with open(path_of, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def token_counts(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)`` over whole texts; null and empty texts have 0 tokens."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(path, pattern).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return documents.select("doc_id", count("text").alias("n_tokens"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over counts: rows (length, first rank, last rank, first container, items a container).

    The items of a length with ranks from first to last go to consecutive containers, so many to each.  Items are
    taken from the longest down; each goes where the least room remains, and containers with equal room and
    content are handled as one group.  Containers are numbered from 1 without gaps.
    """
    groups: dict[int, list[list]] = defaultdict(list)  # room: [group, number of containers]
    contents: list[tuple[int, int, int]] = []  # group: (parent group, length, items)
    closed: list[tuple[int, int]] = []

    def put(room: int, group: int, number: int) -> None:
        if room == 0:
            closed.append((group, number))
        else:
            groups[room].append([group, number])

    def add(parent: int, length: int, items: int) -> int:
        contents.append((parent, length, items))
        return len(contents) - 1

    order: list[int] = []  # rooms in use, rising

    def open_room(room: int) -> None:
        at = bisect.bisect_left(order, room)
        if at == len(order) or order[at] != room:
            order.insert(at, room)

    for length in sorted((n for n in counts if n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"an item of {length} exceeds the capacity {capacity}")
        left = counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            while at < len(order) and not groups[order[at]]:
                del order[at]
            if at == len(order):
                each = capacity // length
                number, rest = divmod(left, each)
                for n, k in ((number, each), (1 if rest else 0, rest)):
                    if n:
                        put(capacity - k * length, add(-1, length, k), n)
                        if capacity - k * length:
                            open_room(capacity - k * length)
                left = 0
                break
            room = order[at]
            group, number = groups[room].pop()
            each = room // length
            full = min(number, left // each)
            used = 0
            if full:
                put(room - each * length, add(group, length, each), full)
                if room - each * length:
                    open_room(room - each * length)
                left -= full * each
                used = full
            if left and used < number and left < each:
                put(room - left * length, add(group, length, left), 1)
                if room - left * length:
                    open_room(room - left * length)
                left, used = 0, used + 1
            if used < number:
                groups[room].append([group, number - used])
    # Number the containers group by group and unfold each group's contents.
    out: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    container = 1
    leaves = closed + [(g, n) for room in sorted(groups) for g, n in groups[room]]
    for group, number in leaves:
        at = group
        while at >= 0:
            parent, length, each = contents[at]
            out.append((length, rank[length], rank[length] + number * each - 1, container, each))
            rank[length] += number * each
            at = parent
        container += number
    return out


def pack(lengths: DataFrame, capacity: int) -> DataFrame:
    """Rows ``(doc_id, part, container_id, n_tokens)`` of one capacity; see ``pack_lengths``."""
    return pack_lengths(lengths, {0: capacity}).drop("target_id")


def pack_lengths(lengths: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Rows ``(target_id, doc_id, part, container_id, n_tokens)`` for every capacity by target id, ranked in one pass.

    ``lengths`` has doc_id and n_tokens.  A document of 0 tokens takes no room and goes to container 1.  A document
    over the capacity has several parts, numbered from 0, all but the last as long as the capacity.  Repeated
    rows of a doc_id are packed each for itself.  Extra columns are left aside; an empty table gives no rows.
    """
    spark = lengths.sparkSession
    targets = F.array(*[F.struct(F.lit(t).cast("long").alias("target_id"), F.lit(c).cast("long").alias("capacity")) for t, c in sorted(capacities.items())])
    each_target = lengths.where("doc_id is not null").select("doc_id", "n_tokens", F.explode(targets).alias("t")).select("t.target_id", "t.capacity", "doc_id", "n_tokens")
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    rest = F.col("n_tokens") % F.col("capacity")
    parts = F.when(F.col("n_tokens") <= F.col("capacity"), F.array(F.col("n_tokens"))).otherwise(
        F.concat(F.array_repeat(F.col("capacity"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    )
    pieces = each_target.select("target_id", "doc_id", F.posexplode(parts).alias("part", "length"))
    # At most as many rows as the capacities' sum.
    counted = pieces.where("length > 0").groupBy("target_id", "length").agg(F.count(F.lit(1)).alias("n")).collect()
    slots: list[tuple[int, ...]] = []
    widths: list[tuple[int, ...]] = []
    for target, capacity in sorted(capacities.items()):
        histogram = {r["length"]: r["n"] for r in counted if r["target_id"] == target}
        rows = plan(histogram, capacity)
        number = Counter(r[0] for r in rows)
        for length, n in histogram.items():
            # Ranks fall into buckets as wide as the length's plan rows are on average, so that a document meets few of them.
            widths.append((target, length, max(1, -(-n // number[length])), -(-n // PART_ROWS)))
        width = {w[1]: w[2] for w in widths if w[0] == target}
        slots += [(target, length, bucket, a, b, first, each) for length, a, b, first, each in rows for bucket in range(a // width[length], b // width[length] + 1)]
    frame = lambda rows, names: spark.createDataFrame(pd.DataFrame(rows, columns=names.split()).astype("int64"), ", ".join(f"{n} long" for n in names.split()))
    slot = frame(slots, "target_id length bucket first_rank last_rank first_container each")
    of_length = F.broadcast(frame(widths, "target_id length width salts"))  # as many rows as `counted`
    if len(slots) <= BROADCAST_ROWS:
        slot = F.broadcast(slot)
    salted = pieces.where("length > 0").join(of_length, ["target_id", "length"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    offsets = (
        salted.groupBy("target_id", "length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .select("target_id", "length", "salt", (F.sum("n").over(Window.partitionBy("target_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    )
    local = F.row_number().over(Window.partitionBy("target_id", "length", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("local", local).join(offsets, ["target_id", "length", "salt"]).select("target_id", "doc_id", "part", "length", "width", (F.col("local") + F.col("offset")).alias("rank"))
    placed = ranked.withColumn("bucket", F.floor(F.col("rank") / F.col("width"))).join(slot, ["target_id", "length", "bucket"]).where("rank between first_rank and last_rank")
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))
    return placed.select("target_id", "doc_id", "part", container.cast("long").alias("container_id"), F.col("length").alias("n_tokens")).unionAll(
        pieces.where("length = 0 or length is null").select("target_id", "doc_id", "part", F.lit(1).cast("long").alias("container_id"), F.lit(0).cast("long").alias("n_tokens"))
    )


def pack_all(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(target_id, doc_id, part, container_id, n_tokens)`` for every capacity in ``targets`` (a few rows)."""
    capacities = {r["target_id"]: r["capacity_tokens"] for r in targets.where("capacity_tokens > 0 and target_id is not null").select("target_id", "capacity_tokens").distinct().orderBy("target_id", "capacity_tokens").collect()}
    if not capacities:
        return documents.sparkSession.createDataFrame([], "target_id long, doc_id long, part int, container_id long, n_tokens long")
    return pack_lengths(cut_lineage(token_counts(documents, path)), capacities)


def fill(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_id, n_containers, n_tokens, fill_share)``: how full the containers of each capacity are."""
    used = packed.where("n_tokens > 0").groupBy("target_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(targets, "target_id").select("target_id", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill_share"))
