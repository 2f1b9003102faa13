"""Keyword dictionaries: reading, cleaning, flattening and statistics, as DataFrames.

An entry is ``(seq, category, keyword, variants ARRAY<STRING>, lang, weight, is_ambiguous)``.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import packed_values
from .ranking import one_per_key

ENTRY = "seq long, category string, keyword string, variants array<string>, lang string, weight double, is_ambiguous boolean"
# Forms that never count as keywords.
HARD_EXCLUSIONS = ("phân quyền", "phan quyen", "phân cấp", "together")
# Column names by which a dictionary sheet's columns are known.
SYNONYMS = {
    "keyword": ("keyword", "từ khóa", "từ khoá", "tu khoa", "term", "word"),
    "category": ("category", "danh mục", "nhóm", "group", "loại"),
    "variants": ("variants", "variant", "biến thể", "synonyms", "từ đồng nghĩa"),
    "lang": ("lang", "language", "ngôn ngữ"),
    "weight": ("weight", "trọng số"),
}
DEFAULT_CATEGORY = "Chung"


def weight_value(c: Column) -> Column:
    """A weight typed with point or comma; 1.0 where it is no positive number."""
    v = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v > 0, v).otherwise(F.lit(1.0))


def split_variants(c: Column) -> Column:
    """Variants of a cell, the first spelling kept of those that differ in case only."""
    parts = F.filter(F.transform(F.split(c, r"[|;,\t\n\r]+"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def from_table(keywords: DataFrame) -> DataFrame:
    """Entries of the ``keywords`` table, whose variants are packed in one string."""
    return keywords.select(
        F.col("keyword_id").alias("seq"), "category", "keyword", F.coalesce(packed_values(F.col("variants")), F.array().cast("array<string>")).alias("variants"),
        "lang", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"),
    )


def from_string(spark: SparkSession, text: str, category: str = DEFAULT_CATEGORY) -> DataFrame:
    """Entries of a typed list parted by commas, semicolons or line ends."""
    one = spark.createDataFrame([(text,)], "t string")
    parts = one.select(F.posexplode(F.split("t", r"[,;\n]+")).alias("seq", "k")).select(F.col("seq").cast("long"), F.trim("k").alias("keyword")).where("keyword <> ''")
    return parts.select("seq", F.lit(category).alias("category"), "keyword", F.array().cast("array<string>").alias("variants"), F.lit(None).cast("string").alias("lang"), F.lit(1.0).alias("weight"), F.lit(False).alias("is_ambiguous"))


def _frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ENTRY)


def from_list(spark: SparkSession, words: Iterable[str], category: str = DEFAULT_CATEGORY) -> DataFrame:
    return _frame(spark, [(category, w.strip(), [], None, 1.0, False) for w in words if w and w.strip()])


def from_mapping(spark: SparkSession, by_category: dict[str, Iterable[str]]) -> DataFrame:
    return _frame(spark, [(c, w.strip(), [], None, 1.0, False) for c, ws in by_category.items() for w in ws if w and w.strip()])


def from_headed_text(spark: SparkSession, text: str) -> DataFrame:
    """Entries of a plain file: ``#`` lines are remarks, ``[Header]`` lines name the category, ``|`` parts variants."""
    rows, category = [], DEFAULT_CATEGORY
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]"):
            category = line[1:-1].strip() or DEFAULT_CATEGORY
            continue
        head, *variants = [p.strip() for p in line.replace("\t", "|").split("|")]
        if head:
            rows.append((category, head, [v for v in variants if v], None, 1.0, False))
    return _frame(spark, rows)


def decode(data: bytes) -> str:
    """Text of a small file in the first encoding that reads it."""
    for name in ("utf-8-sig", "utf-8", "cp1258"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def sniff_delimiter(text: str) -> str:
    """The delimiter of a small sheet: the one most frequent in its first line; a pipe, tab, comma, semicolon in this order on ties."""
    first = next((line for line in text.splitlines() if line.strip()), "")
    return max("|\t,;", key=lambda c: (first.count(c), -"|\t,;".index(c)))


def from_sheet(spark: SparkSession, text: str) -> DataFrame:
    """Entries of a delimited sheet: the header is looked for in its first rows by synonyms, else columns go by position."""
    sheet = [r for r in csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text)) if any(c.strip() for c in r)]
    place: dict[str, int] = {}
    start = 0
    for i, row in enumerate(sheet[:3]):
        names = [c.strip().lower() for c in row]
        found = {field: names.index(n) for field, known in SYNONYMS.items() for n in known if n in names}
        if "keyword" in found:
            place, start = found, i + 1
            break
    place = place or {"keyword": 0, "category": 1, "variants": 2}
    cell = lambda row, f: row[place[f]].strip() if f in place and place[f] < len(row) else ""
    raw = [(i, cell(r, "category"), cell(r, "keyword"), cell(r, "variants"), cell(r, "lang"), cell(r, "weight")) for i, r in enumerate(sheet[start:])]
    df = spark.createDataFrame(raw, "seq long, category string, keyword string, v string, lang string, w string")
    return df.where("keyword <> ''").select(
        "seq", F.coalesce(F.nullif("category", F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("category"), F.regexp_replace("keyword", r"^\s*(?:[-*•]|\d+[.)])\s*", "").alias("keyword"),
        split_variants(F.col("v")).alias("variants"), F.nullif("lang", F.lit("")).alias("lang"), weight_value(F.col("w")).alias("weight"), F.lit(False).alias("is_ambiguous"),
    )


def from_nested(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, exclusions, rules) of a JSON or YAML dictionary with categories, exclusions and classification rules."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    rows = []
    for name, body in (data.get("categories") or {}).items():
        for k in (body or {}).get("keywords") or []:
            k = k if isinstance(k, dict) else {"keyword": k}
            variants = k.get("variants") or []
            variants = variants.split("|") if isinstance(variants, str) else variants
            rows.append((name, str(k["keyword"]), [str(v).strip() for v in variants], k.get("language"), float(k.get("weight", 1.0)), bool(k.get("is_ambiguous", False))))
    excluded = [(str(e["keyword"] if isinstance(e, dict) else e),) for e in data.get("exclusions") or []]
    rules = [(name, i, str(t)) for i, (name, r) in enumerate((data.get("classification_rules") or {}).items()) for t in (r or {}).get("triggers") or []]
    return _frame(spark, rows), spark.createDataFrame(excluded, "keyword string"), spark.createDataFrame(rules, "rule string, rule_order int, trigger string")


def forms(entries: DataFrame, include_variants: bool = True, include_ambiguous: bool = True, categories: list[str] | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """``(form, canonical, category)``: distinct lower-case forms without excluded ones; a later entry wins a form.

    Where the choice leaves nothing, ambiguous entries come back.
    """
    rows = entries if categories is None else entries.where(F.col("category").isin(categories))
    if not include_ambiguous:
        certain = rows.where(~F.col("is_ambiguous"))
        rows = rows if certain.isEmpty() else certain
    every = F.array("keyword") if not include_variants else F.concat(F.array("keyword"), F.coalesce("variants", F.array().cast("array<string>")))
    out = rows.select("seq", "category", F.col("keyword").alias("canonical"), F.explode(every).alias("form")).withColumn("form", F.lower(F.trim("form"))).where("form <> ''")
    out = out.where(~F.col("form").isin(*HARD_EXCLUSIONS))
    if exclusions is not None:
        out = out.join(exclusions.select(F.lower("keyword").alias("form")).distinct(), "form", "left_anti")
    last = F.max_by(F.struct("canonical", "category"), F.struct("seq", "canonical"))
    return out.groupBy("form").agg(last.alias("e")).select("form", "e.canonical", "e.category")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both dictionaries' entries, one for each keyword whatever its case: first spelling and category, largest weight, all variants."""
    rows = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    order = F.struct("__side", "seq")
    first = lambda c: F.min_by(c, order)
    out = rows.groupBy(F.lower(F.trim("keyword")).alias("__k")).agg(
        first("seq").alias("seq"), first(F.coalesce("category", F.lit(DEFAULT_CATEGORY))).alias("category"), first("keyword").alias("keyword"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("variants", F.array().cast("array<string>")))))).alias("variants"),
        first("lang").alias("lang"), F.max("weight").alias("weight"), F.max("is_ambiguous").alias("is_ambiguous"),
    )
    return out.drop("__k")


def stats(entries: DataFrame) -> DataFrame:
    """Totals of a dictionary by category and language (rollup; both null: all)."""
    return entries.rollup("category", "lang").agg(
        F.count(F.lit(1)).alias("n_keywords"), F.count_if(F.size("variants") > 0).alias("n_with_variants"), F.count_if("is_ambiguous").alias("n_ambiguous"),
        F.grouping_id().alias("level"),
    )


def keep_latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Upsert rule: one row for each key, the last by ``order``."""
    return one_per_key(rows, keys, order, last=True)


def import_entries(old: DataFrame, new: DataFrame, mode: str = "append") -> DataFrame:
    """A dictionary after an import: ``append`` merges the new entries into the old ones, ``new`` keeps the new ones only."""
    if mode not in ("append", "new"):
        raise ValueError(f"unknown mode {mode}")
    return merge(old, new) if mode == "append" else new


def put(entries: DataFrame, entry: DataFrame) -> DataFrame:
    """Entries with those of the same keyword, whatever its case, replaced by ``entry``, or with it added."""
    return without(entries, entry.select("keyword")).unionByName(entry)


def without(entries: DataFrame, keywords: DataFrame) -> DataFrame:
    """Entries but those of the given keywords, whatever their case."""
    gone = keywords.select(F.lower(F.trim("keyword")).alias("__k")).distinct()
    return entries.withColumn("__k", F.lower(F.trim("keyword"))).join(gone, "__k", "left_anti").select(*entries.columns)


class Store:
    """Dictionaries by topic below one folder, a parquet table each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def topics(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path)) if self._fs.exists(self._path) else []

    def load(self, topic: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{topic}")

    def save(self, topic: str, entries: DataFrame) -> None:
        """Writes a topic beside the old one first, which ``entries`` may be read from."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        entries.write.mode("overwrite").parquet(f"{self.root}/.{topic}")
        self._fs.delete(place(f"{self.root}/{topic}"), True)
        self._fs.rename(place(f"{self.root}/.{topic}"), place(f"{self.root}/{topic}"))

    def delete(self, topic: str) -> bool:
        return self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{topic}"), True)


def resolve(spark: SparkSession, keywords: str | None = None, sheet: str | None = None, topic: str | None = None, project: str | None = None, store: Store | None = None) -> DataFrame:
    """The dictionary that is meant: typed keywords before a sheet's text, before a stored topic, before the project's topic."""
    if keywords and keywords.strip():
        return from_string(spark, keywords)
    if sheet and sheet.strip():
        return from_sheet(spark, sheet)
    for name in (topic, project):
        if name and store is not None and name in store.topics():
            return store.load(name)
    raise LookupError("no keywords, sheet, topic or project names a dictionary")
