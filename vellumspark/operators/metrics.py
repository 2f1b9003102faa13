"""Research variables from matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def core_variables(docs: DataFrame, keys: list[str], word_count: Column) -> DataFrame:
    """Word_Count, Frequency, Log_Frequency, Mention, Density (per cent) and Unique_Keywords of every document with ``matches``."""
    n = F.size("matches")
    return docs.select(
        *keys, word_count.alias("Word_Count"), n.alias("Frequency"), F.round(F.log1p(n.cast("double")), 6).alias("Log_Frequency"), F.when(n > 0, 1).otherwise(0).alias("Mention"),
        F.when(word_count > 0, F.round(n / word_count * 100, 4)).otherwise(F.lit(0.0)).alias("Density"),
        F.size(F.array_distinct(F.transform("matches", lambda m: m["keyword_canonical"]))).alias("Unique_Keywords"),
    )


def long_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, category, keyword, frequency)``: raw counts, long form."""
    m = docs.select(*keys, F.explode("matches").alias("m"))
    return m.groupBy(*keys, F.col("m.category").alias("category"), F.col("m.keyword_canonical").alias("keyword")).agg(F.count(F.lit(1)).alias("frequency"))


def category_name(prefix: str, category: str) -> str:
    """Column name of a category's frequency; the prefixes 'topic' and 'default' are left out."""
    base = category.lower().replace(" ", "_") + "_Freq"
    return base if prefix in ("", "topic", "default") else f"{prefix}_{base}"


def category_frequencies(counts: DataFrame, keys: list[str], categories: list[str], prefix: str = "") -> DataFrame:
    """One column for each listed category, zero where it has no match (an explicit list keeps the schema fixed)."""
    return counts.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("frequency"))), F.lit(0)).cast("long").alias(category_name(prefix, c)) for c in categories]
    )


def normalised_scores(counts: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Per category: frequency, diversity and matches per 10,000 words; ``totals`` has Word_Count by key."""
    per = counts.groupBy(*keys, "category").agg(F.sum("frequency").alias("frequency"), F.countDistinct("keyword").alias("diversity"))
    return per.join(totals, keys).select(*keys, "category", "frequency", "diversity", F.when(F.col("Word_Count") > 0, F.round(F.col("frequency") / F.col("Word_Count") * 10000, 6)).otherwise(F.lit(0.0)).alias("normalized_score"))


def summary(counts: DataFrame) -> DataFrame:
    """Totals over all matches: number, distinct keywords, categories."""
    return counts.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total"), F.countDistinct("keyword").alias("unique_keywords"), F.countDistinct("category").alias("categories"))


def _of_categories(names: list[str] | None) -> Column:
    return F.filter("matches", lambda m: m["category"].isin(*names)) if names else F.col("matches")


def _mentions(matches: Column, trigger: str) -> Column:
    return F.exists(matches, lambda m: F.contains(F.lower(m["keyword_found"]), F.lit(trigger.lower())))


def build_variables(docs: DataFrame, keys: list[str], spec: list[dict], word_count: Column) -> DataFrame:
    """User-defined variables: each of ``spec`` has name and type (frequency, diversity, normalized_score, classification, custom).

    Optional: categories (list), triggers (classification: 1 if one occurs in a match or the text column), formula
    (custom: a SQL expression over the row).
    """
    out = [F.col(k) for k in keys]
    for v in spec:
        chosen = _of_categories(v.get("categories"))
        kind = v["type"]
        if kind == "frequency":
            c = F.size(chosen).cast("double")
        elif kind == "diversity":
            c = F.size(F.array_distinct(F.transform(chosen, lambda m: m["keyword_canonical"]))).cast("double")
        elif kind == "normalized_score":
            c = F.when(word_count > 0, F.round(F.size(chosen) / word_count * v.get("per", 10000), 6)).otherwise(F.lit(0.0))
        elif kind == "classification":
            hit = F.lit(False)
            for t in v.get("triggers", []):
                hit = hit | _mentions(chosen, t)
                if "text" in v:
                    hit = hit | F.contains(F.lower(F.col(v["text"])), F.lit(t.lower()))
            c = hit.cast("double")
        elif kind == "custom":
            c = F.expr(v["formula"]).cast("double")
        else:
            c = F.lit(None).cast("double")
        out.append(c.alias(v["name"]))
    return docs.select(*out)


def classify_by_rules(docs: DataFrame, key: str, text: str, rules: DataFrame, default: str = "talk") -> DataFrame:
    """``(key, label, n_triggers, confidence)``: the rule with most distinct triggers in the text, the earlier rule on ties.

    ``rules`` has (rule, rule_order, trigger); documents without matches are 'none'.
    """
    low = docs.select(key, F.size("matches").alias("n"), F.lower(F.col(text)).alias("t"))
    listed = rules.groupBy("rule", "rule_order").agg(F.array_sort(F.collect_set(F.lower("trigger"))).alias("triggers"))
    packed = listed.agg(F.sort_array(F.collect_list(F.struct("rule_order", "rule", "triggers"))).alias("r")).first()["r"]  # a few rules
    scored = low
    names = []
    for r in packed:
        c = f"__r{len(names)}"
        hits = sum((F.contains("t", F.lit(x)).cast("int") for x in r["triggers"]), F.lit(0))
        scored = scored.withColumn(c, hits)
        names.append((c, r["rule"]))
    if not names:
        return low.select(key, F.when(F.col("n") > 0, F.lit(default)).otherwise("none").alias("label"), F.lit(0).alias("n_triggers"), F.lit(0.5).alias("confidence"))
    top = F.greatest(F.lit(0), *[F.col(c) for c, _ in names])
    label = F.lit(default)
    for c, rule in reversed(names):
        label = F.when((F.col(c) == top) & (top > 0), F.lit(rule)).otherwise(label)
    return scored.select(
        key, F.when(F.col("n") == 0, F.lit("none")).otherwise(label).alias("label"), top.alias("n_triggers"),
        F.when(top > 0, F.round(F.least(F.lit(1.0), top / 3), 2)).otherwise(F.lit(0.5)).alias("confidence"),
    )


def per_category(counts: DataFrame, categories: list[str]) -> DataFrame:
    """(category, frequency, unique_keywords) of the named categories, those without matches with zeros."""
    named = counts.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(categories)], "category string")
    seen = counts.where(F.col("category").isin(*categories)).groupBy("category").agg(F.sum("frequency").alias("frequency"), F.countDistinct("keyword").alias("unique_keywords"))
    return named.join(F.broadcast(seen), "category", "left").select("category", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("unique_keywords", F.lit(0)).alias("unique_keywords"))


def top_keywords(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent keywords; ties by name."""
    return counts.groupBy("keyword").agg(F.sum("frequency").alias("frequency")).orderBy(F.col("frequency").desc(), "keyword").limit(n)
