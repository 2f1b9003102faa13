"""Small cases of the core operators."""

import random
import re
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.operators import catalog, contexts, dictionary, directory, finance, labor, labor_tables, matching, metrics, news, panel
from vellumspark.operators.packed import packed_values, split_packed
from vellumspark.sources import readers, sinks
from vellumspark.streaming import incremental

SECTORS = ["Sản xuất bao bì, nhãn mác", "Kho bãi / cảng / giao nhận", "Viễn thông di động", "Xuất bản; in ấn; truyền thông", "Khai khoáng - tuyển quặng"]


def one(spark, value, column):
    """The value of ``column`` over a row whose x is ``value``."""
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


class TestPacked:
    @pytest.mark.parametrize(
        ("value", "items"),
        [
            ("a|b|c", ["a", "b", "c"]), ("a; b ;; c", ["a", "b", "c"]), ('"a, b",c', ["a, b", "c"]), ("x 4,0, y", ["x 4,0", "y"]), ("AI/ML x / y-z / R&D", ["AI/ML x", "y-z", "R&D"]),
            ('["a, b", "c \\"d\\""]', ["a, b", 'c "d"']), ("- a b\n- c", ["a b", "c"]), ('"a ""b"" c" | d', ['a "b" c', "d"]), ("“a; b”\t'c, d'", ["a; b", "c, d"]),
            ("a", ["a"]), ("", []), ("   ", []), (None, None), ("a0|b", ["a0", "b"]), ("a|a|a", ["a", "a", "a"]), ('AP / AI/ML p / "au - au"', ["AP", "AI/ML p", "au - au"]),
        ],
    )
    def test_plain(self, spark, value, items):
        assert one(spark, value, packed_values(F.col("x"))) == items

    @pytest.mark.parametrize(
        ("value", "items"),
        [
            ("Công ty AViễn thông di động", ["Công ty A", "Viễn thông di động"]), ("CTCP B, C và D; Kho bãi / cảng / giao nhận", ["CTCP B, C và D", "Kho bãi / cảng / giao nhận"]),
            ("T - CTCPSản xuất bao bì, nhãn mác; Viễn thông di động", ["T - CTCP", "Sản xuất bao bì, nhãn mác", "Viễn thông di động"]),
            ('"CTCP ""X"" Y" / "Khai khoáng - tuyển quặng"', ['CTCP "X" Y', "Khai khoáng - tuyển quặng"]), ("Công ty A, B và C", ["Công ty A, B và C"]),
            ("“CTCP M, N”;Viễn thông di động;", ["CTCP M, N", "Viễn thông di động"]), ("Z – 'Xuất bản; in ấn; truyền thông'", ["Z", "Xuất bản; in ấn; truyền thông"]),
        ],
    )
    def test_known(self, spark, value, items):
        assert one(spark, value, packed_values(F.col("x"), SECTORS)) == items

    def test_rows(self, spark):
        df = spark.createDataFrame([("k", "a|b", 1), ("k", "a|b", 1), (None, "c", 2), ("e", None, 3), ("f", "|".join(map(str, range(5000))), 4)], "key string, v string, item int")
        rows = split_packed(df, F.col("key"), F.col("v"), "t.v").collect()
        assert len(rows) == 5004 and {(r.pos, r.item) for r in rows if r.record_key == "k"} == {(1, "a"), (2, "b")}
        assert split_packed(df.limit(0), F.col("key"), F.col("v"), "t.v").count() == 0

    def test_many_known_names(self, spark):
        r = random.Random(9)
        names = sorted({"".join(r.choice("ab, (") for _ in range(r.randint(3, 9))).strip() + str(i) for i in range(12_000)} | {"Kho", "Kho lạnh", "Kho lạnh, cảng"})
        assert one(spark, "Công ty; Kho lạnh, cảng; Kho lạnh", packed_values(F.col("x"), names)) == ["Công ty", "Kho lạnh, cảng", "Kho lạnh"]
        picked = r.sample([n for n in names if n[0] in "ab"], 5)
        assert one(spark, "Hãng; " + "; ".join(picked), packed_values(F.col("x"), names)) == ["Hãng", *picked]

    @pytest.mark.parametrize(("a", "b"), [('"', '"'), ("“", "”"), ("'", "'"), ("«", "»")])
    def test_long_values(self, spark, a, b):
        long = "x, " * 33_000 + "y"
        assert one(spark, f"{a}{long}{b}; z", packed_values(F.col("x"))) == [long, "z"]
        assert one(spark, f"{a}{long}{b}; {SECTORS[2]}", packed_values(F.col("x"), SECTORS)) == [long, SECTORS[2]]
        assert one(spark, f"{a}q, z", packed_values(F.col("x"))) == [f"{a}q", "z"]
        assert len(one(spark, f"{a}{'w; ' * 33_000}z", packed_values(F.col("x")))) == 33_001
        doubled = '"' + 'p""' * 30_000 + '"'
        assert one(spark, f"{doubled}|z", packed_values(F.col("x"))) == ['p"' * 30_000, "z"]

    def test_random_round_trip(self, spark):
        r = random.Random(7)
        cases = []
        for _ in range(200):
            items = ["".join(r.choice("ab, ;|-x") for _ in range(r.randint(1, 8))).strip(" ") or "q" for _ in range(r.randint(2, 5))]
            cases.append((r.choice(["|", "; ", ","]).join(f'"{x}"' for x in items), items))
        got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, x string").select("i", packed_values(F.col("x")).alias("v")).collect()
        assert all(row.v == cases[row.i][1] for row in got)


class TestText:
    def test_functions(self, spark):
        assert one(spark, "hoá và thuỷ", tx.tone_normal(F.col("x"))) == "hóa và thủy"
        assert one(spark, "Điện Lực ẹ", tx.strip_accents(F.col("x"))) == "Dien Luc e"
        assert one(spark, " a  b\n c ", tx.word_count(F.col("x"))) == 3 and one(spark, "", tx.word_count(F.col("x"))) == 0
        assert one(spark, "oﬃce  ​x\n\n\n\n\ny", tx.clean_text(F.col("x"))) == "office x\n\n\ny"
        assert one(spark, "é", tx.nfc("x")) == "é"
        assert one(spark, "0123456789", tx.snippet(F.col("x"), F.lit(5), F.lit(1), 2)) == "...34567..."
        assert one(spark, "vcb; bid, VCB\tfpt", tx.split_tickers(F.col("x"))) == ["VCB", "BID", "FPT"]
        for raw, want in (("1.234,5", 1234.5), ("(2.000)", -2000.0), ("-", None), ("", None), ("abc", None), ("12", 12.0)):
            assert one(spark, raw, tx.parse_cell_number(F.col("x"))) == want
        for raw, want in (("9.960", 9960), ("54,646", 54646), ("1 250", 1250), ("1.O5O", 1050), ("35.8783", 35878), ("12", 12), ("1.234,56", 1234), ("x", 0)):
            assert one(spark, raw, tx.headcount_number(F.col("x"))) == want, raw
        for raw, want in (("12/3/2020 10:00", "2020-03-12"), ("2021-4-5T", "2021-04-05"), ("yesterday evening", "yesterday ev")):
            assert one(spark, raw, tx.clean_date(F.col("x"))) == want
        for raw, want in (("VCB_2019_BCTN.pdf", ("VCB", 2019)), ("a\\2020_BCTN_FPT.pdf", ("FPT", 2020)), ("HPG 21.pdf", ("HPG", 2021)), ("HPG_98_x.pdf", ("HPG", 1998)), ("scan.pdf", (None, None))):
            assert tuple(one(spark, raw, tx.parse_filename(F.col("x")))) == want
        assert one(spark, "II. Tiền (VND)", tx.normal_item_name(F.col("x"))) == "tiền"
        assert one(spark, "x", tx.article_year(F.lit(None).cast("string"), F.lit("http://a/2018/x"), F.lit("t"))) == 2018


class TestMatching:
    FORMS = [("AI", "AI", "t"), ("sổ cái", "sổ cái", "t"), ("sổ cái số hóa", "sổ cái số hóa", "t"), ("ML", "ML", "t"), ("real-time", "real-time", "t")]

    def spans(self, spark, text, forms=None):
        docs = spark.createDataFrame([(1, text)], "id int, text string")
        f = spark.createDataFrame([(a.lower(), b, c) for a, b, c in forms or self.FORMS], "form string, canonical string, category string")
        out = matching.exact_matches(docs, "text", f).select(matching.resolve_overlaps(F.col("matches")).alias("m")).first().m
        return [(x.keyword_found, x.keyword_canonical) for x in out]

    @pytest.mark.parametrize(
        ("text", "want"),
        [
            ("ai đến, Ai và ai", []), ("AI, (AI) AI/ML", ["AI", "AI", "AI", "ML"]), ("Sổ cái\n số  hoá mới", ["sổ cái số hóa"]), ("sổ cáix và xsổ cái", []), ("sổ cái sổ cái", ["sổ cái", "sổ cái"]), ("Real-Time.", ["real-time"]), ("@#%^AI", []), (None, []), ("", []),
        ],
    )
    def test_exact(self, spark, text, want):
        assert [c for _, c in self.spans(spark, text)] == want

    def test_overlaps_against_python(self, spark):
        r = random.Random(1)
        for _ in range(25):
            ms = [(f"k{i}", a := r.randint(0, 30), a + r.randint(1, 9), r.choice(["exact", "fuzzy"]), float(r.randint(85, 100))) for i in range(r.randint(0, 9))]
            rows = [(k, k, "c", a, b, t, s, 0) for k, a, b, t, s in ms]
            got = spark.createDataFrame([(rows,)], f"m array<{matching.MATCH}>").select(matching.resolve_overlaps(F.col("m")).alias("m")).first().m
            kept = []
            for k, a, b, t, s in sorted(ms, key=lambda m: (m[3] != "exact", m[1] - m[2], -m[4], m[1], m[0])):
                if all(max(a, x) >= min(b, y) for _, x, y in kept):
                    kept.append((k, a, b))
            assert [(x.keyword_found, x.position, x.end_position) for x in got] == sorted(kept, key=lambda m: (m[1], m[2]))

    def test_indel_ratio(self):
        def lcs(a, b):
            row = [0] * (len(b) + 1)
            for x in a:
                new = [0]
                for j, y in enumerate(b):
                    new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
                row = new
            return row[-1]

        r = random.Random(2)
        for _ in range(100):
            a, b = ("".join(r.choice("abcđ ") for _ in range(r.randint(0, 12))) for _ in range(2))
            assert matching.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)

    def test_fuzzy(self, spark):
        docs = spark.createDataFrame([(1, "the smart pipelie, smart pipeline and together"), (2, "smart, pipelie"), (3, None)], "id int, text string")
        forms = spark.createDataFrame([("smart pipeline", "smart pipeline", "t"), ("tether", "tether", "t")], "form string, canonical string, category string")
        got = matching.fuzzy_matches(docs, "id", "text", forms).collect()
        assert [(r.id, r.gram, r.canonical, r.levenshtein_distance, r.times) for r in got] == [(1, "smart pipelie", "smart pipeline", 1, 1)]

    def test_search_against_brute_force(self, spark, monkeypatch):
        """Every run of words against every form, guard by guard; blocks of the dictionary change nothing."""
        r = random.Random(12)
        letters = "aăbcđeghiklmnoprstuư"
        word = lambda: "".join(r.choice(letters) for _ in range(r.choice([2, 3, 4, 6, 9, 12])))
        forms = sorted({" ".join(word() for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(40)} | {"x" * 70, "kiểm tra nội bộ"})

        def noisy(w):
            w = list(w)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w[at] = r.choice(["", w[at] * 2, r.choice(letters)])
            return "".join(w)

        texts = []
        for _ in range(60):
            parts = [" ".join(noisy(w) for w in r.choice(forms).split(" ")) if r.random() < 0.7 else word() for _ in range(12)]
            texts.append("".join(p + r.choice([" ", "  ", ", ", " (", "\n"]) for p in parts))
        texts[0] = "x" * 69 + " và " + "x" * 71 + " kiểm tra nộii bộ"

        def brute(text):
            low, out = text.lower(), []
            tokens = [(m.group().strip(matching.EDGES), m.group()[-1] in matching.BREAKS, m.start()) for m in re.finditer(r"\S+", low)]
            tokens = [t for t in tokens if t[0]]
            for form in (f for f in forms if len(f) >= 6):
                k = form.split(" ")
                for i in range(len(tokens) - len(k) + 1):
                    run = tokens[i : i + len(k)]
                    window, edits = " ".join(t[0] for t in run), int(len(form) * 0.15 + 0.5) + 1
                    if any(t[1] for t in run[:-1]) or not int(0.73 * len(window)) <= len(form) <= int(1.37 * len(window)) + 1 or abs(len(window) - len(form)) > edits or len(set(form) - set(window)) > edits or window in matching.COMMON_WORDS:
                        continue
                    gap, dist = abs(len(window) - len(form)), matching.edit_distance(window, form)
                    if len(k) == 1 and (len(form) <= 8 and gap > 1 or len(form) <= 7 and dist > 1 or len(form) <= 10 and dist > 2):
                        continue
                    alike = lambda a, b: a == b or (len(a) == len(b) and matching.indel_ratio(a, b) >= 0.85 if min(len(a), len(b)) <= 3 else min(len(a), len(b)) / max(len(a), len(b)) > 0.65 and matching.indel_ratio(a, b) >= 0.75)
                    sim = 100 * matching.indel_ratio(window, form)
                    if 85 <= sim < 100 and (len(k) == 1 or all(alike(t[0], x) for t, x in zip(run, k, strict=True))):
                        out.append((window, form, run[0][2], run[0][2] + len(window), round(sim, 2), dist))
            return sorted(out)

        docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, "")], "id int, text string")
        f = spark.createDataFrame([(x, x, "c") for x in forms], "form string, canonical string, category string")
        every = matching.search(docs, "text", f, fuzzy=True, resolve=False).select("id", F.explode("matches").alias("m")).where("m.match_type = 'fuzzy'").collect()
        found = {}
        for x in every:
            found.setdefault(x.id, []).append((x.m.keyword_found, x.m.keyword_canonical, x.m.position, x.m.end_position, x.m.similarity, x.m.levenshtein_distance))
        want = {i: b for i, t in enumerate(texts) if (b := brute(t))}
        assert {i: sorted(v) for i, v in found.items()} == want and sum(map(len, want.values())) > 100
        rows = lambda: sorted(tuple(x) for x in matching.search(docs, "text", f, fuzzy=True).select("id", F.explode("matches").alias("m")).select("id", "m.*").collect())
        whole = rows()
        monkeypatch.setattr(matching, "MAX_FORMS", 7)
        assert rows() == whole and any(x[6] == "exact" for x in whole) and any(x[6] == "fuzzy" for x in whole)

    def test_fuzzy_sizes_of_the_forms(self, spark, tmp_path):
        from vellumspark.plans import text_queries

        keywords = [(1, "a", "nền tảng quản trị số hóa", "blockchain", "vi", 1.0, False)]
        spark.createDataFrame(keywords, "keyword_id long, category string, keyword string, variants string, lang string, weight double, is_ambiguous boolean").write.parquet(f"{tmp_path}/keywords.parquet")
        spark.createDataFrame([(1, "e", 7, None, "Một nền tảng quản trj số hóa trên blokchain."), (2, "e", 7, None, None)], "snippet_id long, match_type string, report_id long, created_at timestamp, context_text string").write.parquet(f"{tmp_path}/snippets.parquet")
        got = text_queries.QUERIES["fuzzy_keywords"](spark, str(tmp_path)).collect()
        # a word of three letters or less must agree to .85, so the six-word form needs a longer word misspelt
        assert {(r.doc_id, r.gram, r.canonical) for r in got} == {(1, "blokchain", "nền tảng quản trị số hóa")}
        spark.createDataFrame([(1, "e", 7, None, "Một nền tảngg quản trị số hóa.")], "snippet_id long, match_type string, report_id long, created_at timestamp, context_text string").write.parquet(f"{tmp_path}/b/snippets.parquet")
        spark.read.parquet(f"{tmp_path}/keywords.parquet").write.parquet(f"{tmp_path}/b/keywords.parquet")
        got = text_queries.QUERIES["fuzzy_keywords"](spark, f"{tmp_path}/b").collect()
        assert [(r.gram, r.times) for r in got] == [("nền tảngg quản trị số hóa", 1)]
        none = spark.createDataFrame([("ab", "ab", "t")], "form string, canonical string, category string")
        assert matching.fuzzy_matches(spark.createDataFrame([(1, "ab ac")], "id int, text string"), "id", "text", none).count() == 0

    def test_queries_search_variants(self, spark, tmp_path):
        from vellumspark.plans import text_queries

        keywords = [(1, "mang", "smart grid", "smart grids | SG / lưới thông minh", "en", 1.0, False), (2, "quy", "cảm biến biên", None, "vi", None, None)]
        spark.createDataFrame(keywords, "keyword_id long, category string, keyword string, variants string, lang string, weight double, is_ambiguous boolean").write.parquet(f"{tmp_path}/keywords.parquet")
        texts = ["Two smart grids and a Smart Grid.", "Lưới  thông minh, cảm biến biên; SG but not sg.", "nothing", None]
        rows = [(i, "exact", 7, pd.Timestamp("2021-01-01").to_pydatetime(), t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "snippet_id long, match_type string, report_id long, created_at timestamp, context_text string").write.parquet(f"{tmp_path}/snippets.parquet")
        run = lambda name: text_queries.QUERIES[name](spark, str(tmp_path)).collect()
        spans = sorted((r.doc_id, r.keyword_found, r.keyword_canonical) for r in run("match_spans"))
        assert spans == [(0, "Smart Grid", "smart grid"), (0, "smart grids", "smart grid"), (1, "Lưới  thông minh", "smart grid"), (1, "SG", "smart grid"), (1, "cảm biến biên", "cảm biến biên")]
        assert len(run("match_contexts")) == len(run("char_snippets")) == 5
        assert {(r.category, r.frequency, r.documents) for r in run("keyword_panel_all_forms")} == {("mang", 4, 2), ("quy", 1, 1)}
        assert sum(r.frequency for r in run("keyword_counts_all_forms")) == 5 and len(run("dictionary_forms_all_forms")) == 5
        # the names that have SQL search what their SQL searches
        assert {(r.category, r.frequency, r.documents) for r in run("keyword_panel")} == {("mang", 1, 1), ("quy", 1, 1)}
        assert len(run("dictionary_forms")) == 2

    def test_sentences(self, spark):
        text = "Ông PGS. An ở TP. HCM tăng 6.5 % năm nay. Xong! Thật? Hết."
        got = one(spark, text, contexts.sentences(F.col("x")))
        assert "".join(got) == text and len(got) == 4
        spans = one(spark, text, contexts.sentence_spans(F.col("x")))
        assert [text[s.start : s.end] for s in spans] == got

    @pytest.mark.parametrize(
        ("text", "found", "context"),
        [
            ("Một. Hai ba. Bốn. Năm.", "Hai", "Một. Hai ba. Bốn...."), ("a\t1\t2\nb\t3\t4\nc\t5\t6\nd", "b", "a 1 2\nb 3 4\nc 5 6..."), ("một câu", "câu", "một câu"),
            ("x " * 300 + ". Từ khóa đây. " + "y " * 300 + ".", "khóa", "Từ khóa đây."), ("z" * 500 + " khóa " + "w" * 500, "khóa", "z" * 399 + " khóa " + "w" * 399),
            ("a\t1\t" + "số " * 400, "số", "a 1 " + ("số " * 265).strip()), ("\n\n", "\n", ""), ("A.\n\n\n\nB b.", "B", "A.\n\nB b."),
        ],
    )
    def test_context(self, spark, text, found, context):
        at = text.index(found)
        df = spark.createDataFrame([(1, text, at, at + len(found))], "k long, t string, a int, b int").selectExpr(
            "k", "t", "array(struct('f' keyword_found, 'c' keyword_canonical, 'g' category, a position, b end_position, 'exact' match_type, 100.0D similarity, 0 levenshtein_distance)) matches"
        )
        assert [r.sentence_context for r in contexts.context_rows(df, "k", "t").collect()] == [context]

    def test_merge_near(self, spark):
        rows = [(10, 90.0), (100, 95.0), (500, 80.0)]
        got = spark.createDataFrame([(rows,)], "s array<struct<position:int,similarity:double>>").select(contexts.merge_near(F.col("s")).alias("s")).first().s
        assert [(x.position, x.similarity) for x in got] == [(100, 95.0), (500, 80.0)]

    def test_metrics(self, spark):
        m = [("a", "a", "tech", 0, 1, "exact", 100.0, 0), ("a", "a", "tech", 5, 6, "exact", 100.0, 0), ("b", "b", "legal", 9, 10, "exact", 100.0, 0)]
        docs = spark.createDataFrame([(1, m, "x " * 1000), (2, [], "")], f"id int, matches array<{matching.MATCH}>, text string")
        r = metrics.core_variables(docs, ["id"], tx.word_count(F.col("text"))).orderBy("id").collect()
        assert (r[0].Frequency, r[0].Density, r[0].Unique_Keywords, r[0].Mention, r[1].Density) == (3, 0.3, 2, 1, 0.0)
        c = metrics.category_frequencies(metrics.long_counts(docs, ["id"]), ["id"], ["tech", "legal"], "fintech").first()
        assert (c["fintech_tech_Freq"], c["fintech_legal_Freq"]) == (2, 1)
        assert metrics.category_name("default", "A b") == "a_b_Freq"


class TestDictionary:
    def test_sheets(self, spark):
        got = dictionary.from_sheet(spark, "Từ khóa;Nhóm;biến thể;trọng số\nAI;t;a|A|b;1,8\n;t;x;2\n- ML;;;abc\n").orderBy("seq").collect()
        assert [(r.keyword, r.category, r.variants, r.weight) for r in got] == [("AI", "t", ["a", "b"], 1.8), ("ML", "Chung", [], 1.0)]
        headed = dictionary.from_headed_text(spark, "# remark\n[Tech]\nAI|a.i.\n\nML\n").collect()
        assert [(r.category, r.keyword, r.variants) for r in headed] == [("Tech", "AI", ["a.i."]), ("Tech", "ML", [])]
        assert dictionary.decode("khóa".encode("utf-8-sig")) == "khóa" and dictionary.sniff_delimiter("a\tb") == "\t"
        assert dictionary.from_string(spark, "a, b;c\n\n").count() == 3 and dictionary.from_list(spark, ["a", "", None]).count() == 1 and dictionary.from_mapping(spark, {"c": ["x", "y"]}).count() == 2

    def test_nested_and_forms(self, spark):
        e, x, rules = dictionary.from_nested(spark, '{"categories": {"t": {"keywords": [{"keyword": "AI", "variants": "a.i.|KI"}, "together"]}}, "exclusions": ["ki"], "classification_rules": {"do": {"triggers": ["build", "run"]}}}')
        assert {r.form for r in dictionary.forms(e, exclusions=x).collect()} == {"ai", "a.i."} and rules.count() == 2
        amb = dictionary.from_list(spark, ["x"]).withColumn("is_ambiguous", F.lit(True))
        assert dictionary.forms(amb, include_ambiguous=False).count() == 1
        both = dictionary.merge(dictionary.from_list(spark, ["AI"], "a"), dictionary.from_list(spark, ["ai", "b"], "z").withColumn("weight", F.lit(3.0)))
        assert {(r.keyword, r.category, r.weight) for r in both.collect()} == {("AI", "a", 3.0), ("b", "z", 3.0)}


class TestFinance:
    def wide(self, spark):
        facts = [("A", 2019, "bs_tong_tai_san", 100.0), ("A", 2020, "bs_tong_tai_san", 150.0), ("A", 2022, "bs_tong_tai_san", None), ("A", 2019, "bs_no_phai_tra", 0.0), ("A", 2019, "is_loi_nhuan_sau_thue", 10.0), ("A", 2020, "is_loi_nhuan_sau_thue", -5.0), ("B", 2019, "bs_tong_tai_san", 0.0), ("A", 2019, "bs_tong_tai_san", 90.0)]
        return finance.pivot_facts(spark.createDataFrame(facts, "ticker string, year int, item_code string, value double"), ["bs_tong_tai_san", "bs_no_phai_tra", "is_loi_nhuan_sau_thue", "absent"])

    def test_ratios(self, spark):
        w = self.wide(spark)
        assert "absent" in w.columns and w.where("absent is not null").count() == 0
        r = {(x.ticker, x.year): x for x in finance.ratios(finance.base_items(w)).collect()}
        a = r["A", 2020]
        assert r["A", 2019].roa == pytest.approx(10 / 90) and a.assets_growth_yoy == pytest.approx((150 - 90) / 90) and a.eat_growth_yoy == pytest.approx(-1.5)
        assert r["A", 2019].altman_x4 is None and r["B", 2019].roa is None and r["B", 2019].size_ln is None
        assert len(finance.ratios(finance.base_items(w)).columns) == 118

    def test_strict_growth(self, spark):
        df = spark.createDataFrame([("A", 2019, 1.0), ("A", 2021, 2.0), ("A", 2022, 3.0)], "ticker string, year int, v double")
        got = df.select("year", finance.yoy("v").alias("a"), finance.yoy("v", True).alias("b")).orderBy("year").collect()
        assert [(x.a, x.b) for x in got] == [(None, None), (1.0, None), (0.5, 0.5)]

    def test_helpers(self, spark):
        assert finance.statements_of(["bs_x", "cf_y"]) == ["balance_sheet", "cash_flow"]
        have = finance.available_ratios(["bs_tong_tai_san", "is_loi_nhuan_sau_thue"])
        assert have["roa"] and not have["roe"] and sum(map(bool, have.values())) >= 2 and len(have) == 116
        assert len(finance.PRESETS["full"]) == 116


class TestPanel:
    def test_merge(self, spark):
        a = spark.createDataFrame([(" abc ", "2019", 1, 5), ("ABC", "2019.0", 2, 6), (None, "2019", 3, 7), ("X", "n/a", 4, 8)], "ticker string, year string, rid int, v int")
        b = spark.createDataFrame([("ABC", "2019", 1, 50), ("abc", "2019", 2, 60)], "ticker string, year string, rid int, v int")
        r = panel.merge_left(a, b, F.col("rid"), F.col("rid")).collect()
        assert [(x.ticker, x.year, x.v, x.v_fin) for x in r] == [("ABC", 2019, 5, 60)]

    def test_against_pandas(self, spark):
        r = random.Random(4)
        pdf = pd.DataFrame({"a": [r.random() if r.random() > 0.1 else None for _ in range(80)], "b": [r.random() for _ in range(80)], "c": [1.0] * 80})
        df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
        d = {x.variable: x for x in panel.describe(df, ["a", "b"]).collect()}
        assert d["a"].n == pdf.a.count() and d["a"]["std"] == pytest.approx(pdf.a.std(), abs=1e-4) and d["b"].q75 == pytest.approx(pdf.b.quantile(0.75), abs=1e-4)
        c = {(x.a, x.b): x["corr"] for x in panel.correlations(df, ["a", "b"]).collect()}
        assert c["a", "b"] == c["b", "a"] == pytest.approx(pdf.a.corr(pdf.b), abs=1e-4) and c["a", "a"] == 1.0
        assert panel.research_variables(df, True) == ["a", "b"]
        assert panel.describe(df.limit(0), ["a"]).first().n == 0

    def test_small(self, spark):
        df = spark.createDataFrame([(1, "x", 2019), (2, None, None)], "id int, ind string, year int")
        r = panel.dummies(df, "ind", ["x", "y"], "ind").orderBy("id").collect()
        assert [(x.ind_x, x.ind_y) for x in r] == [(1, 0), (0, 0)]
        assert one(spark, "2.5", panel.int_or(F.col("x"))) == 2 and one(spark, "z", panel.int_or(F.col("x"))) == 1
        assert panel.ordered(df, ["year", "zz"]).columns == ["year", "id", "ind"]


class TestCatalog:
    def test_search(self, spark):
        rec = spark.createDataFrame([(1, "VCB", "CTCP Điện lực", "HOSE", "Tài chính", "s", 2019), (2, "BID", "Thép", "HNX", "Vật liệu", "t", 2020), (3, "VCX", None, "UPCOM", None, None, None)], "report_id int, ticker string, company_name string, exchange_code string, icb_l1 string, sector_name string, report_year int")
        ids = lambda **k: sorted(r.report_id for r in catalog.search(rec, **k).collect())
        assert ids(query="VC") == [1] and ids(query="vcb, bid") == [1, 2] and ids() == [1, 2] and ids(query="dien luc") == [1] and ids(exchanges=["HSX"]) == [1]
        assert ids(exchanges=["HSX", "HNX", "UPCOM"]) == [1, 2] and ids(sector="Vật liệu") == [2] and ids(year_from=2020) == [2] and ids(query="") == [1, 2]
        assert catalog.search(rec, limit=1).first().total_matched == 2

    def test_supplement(self, spark):
        a = spark.createDataFrame([(1, "a")], "k int, v string")
        b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
        assert {tuple(r) for r in catalog.supplement(a, b, ["k"]).collect()} == {(1, "a"), (2, "y")} and {tuple(r) for r in catalog.override(a, b, ["k"]).collect()} == {(1, "x"), (2, "y")}


def test_ranks(spark):
    from vellumspark.operators.ranking import one_per_key, rank_within

    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", None, "b"]), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    for size in (1000, 40):
        got = {x.id: x.n for x in rank_within(df, ["k"], "id", "n", size).collect()}
        seen: dict = {}
        for i, k, _ in rows:
            seen[k] = seen.get(k, 0) + 1
            assert got[i] == seen[k]
    first = {x.k: x.id for x in one_per_key(df, ["k"], F.col("id")).collect()}
    assert first == {k: min(i for i, x, _ in rows if x == k) for k in ("a", "b", None)}
    last = {x.k: x.id for x in one_per_key(df, ["k"], F.col("id"), True).collect()}
    assert last["a"] == max(i for i, x, _ in rows if x == "a") and one_per_key(df.limit(0), ["k"], F.col("id")).count() == 0


class TestNews:
    def test_html(self, spark):
        html = '<html><head><title>T | Site</title><meta property="og:description" content="Lead"><meta property="article:published_time" content="2020-05-01"></head><body><nav><p>menu</p></nav><h1>Head</h1><p>One  two</p><script>x</script><figcaption>cap</figcaption></body></html>'
        r = one(spark, html, news.parse_html("x"))
        assert (r.title, r.sapo, r.text, r.published_date, r.word_count, r.captions_count) == ("Head", "Lead", "One two\ncap", "2020-05-01", 3, 1)
        assert one(spark, None, news.parse_html("x")).text == ""

    def test_clusters(self, spark):
        rows = [(1, 1, "Công ty A công bố lợi nhuận năm", "", "x"), (2, 2, "Công ty A công bố lợi nhuận năm!", "", "y"), (3, 1, "Giá thép giảm mạnh", "", "z")]
        df = spark.createDataFrame(rows, "article_id long, source_rank int, title string, sapo string, text string")
        for parts in (1, 8):
            got = {r.article_id: r.primary_id for r in news.cluster_articles(df.repartition(parts), F.lit("b")).collect()}
            assert got == {1: 1, 2: 1, 3: 3}

    def test_confirmation(self, spark):
        ok = lambda t, k="VCB", c="CTCP Sông Hồng": one(spark, t, news.company_confirmed(F.lit(k), F.lit(c), F.col("x"), F.lit(""), F.lit("")))
        assert ok("tin (VCB) hôm nay") and ok("nhà máy Sông Hồng mở rộng") and not ok("XVCBX và sông khác")
        assert one(spark, "Tiêu đề - Báo mới", news.strip_branding(F.col("x"))) == "Tiêu đề"
        kw = lambda k: one(spark, "có rủi ro", news.keyword_confirmed([F.col("x")], k))
        assert kw(F.array(F.lit("Rủi ro"))) and not kw(F.array(F.lit("abc"))) and kw(F.array().cast("array<string>")) and kw(F.lit(None).cast("array<string>"))

    def test_panel(self, spark):
        p = spark.createDataFrame([("A", 2020, 3)], "ticker string, year int, n int")
        first = spark.createDataFrame([("A", 2019), ("B", None)], "ticker string, first_year int")
        assert {(r.ticker, r.year): r.n for r in news.gap_filled(p, first, 2018, 2020).collect()} == {("A", 2019): 0, ("A", 2020): 3, ("B", 2018): 0, ("B", 2019): 0, ("B", 2020): 0}
        links = spark.createDataFrame([("a", 1, "u1"), ("a", 2, "u2"), ("b", 1, "u1")], "source string, position int, url string")
        assert {(r.turn, r.url) for r in news.interleave(links).collect()} == {(1, "u1"), (2, "u2")}


def test_labor(spark):
    rows = [(1, 2019, "Vào cuối năm 2019, đơn vị có 2.590 người đang làm việc"), (2, 2020, "Total headcount was 45 at year end (2019: 60)."), (3, 2020, "Bộ phận // Cộng // 2.695 // 100,0"), (4, 2020, "không có số"), (5, 2020, None)]
    df = spark.createDataFrame(rows, "id int, year int, text string")
    got = {r.id: (r.labor, r.status) for r in labor.best(labor.scored(labor.candidates(df, ["id", "year"], "text"), "year"), ["id"]).collect()}
    assert got[1][0] == 2590 and got[2][0] == 45 and got[3][0] == 2695 and 4 not in got
    assert [p.page for p in one(spark, "x" * 6000, labor.split_pages(F.col("x")))] == [1, 2, 3] and len(one(spark, "a\fb", labor.split_pages(F.col("x")))) == 2


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 2019, "bs", "HNX", "i", 1.5), ("B", 2020, "is", "HSX", "j", None)], "ticker string, year int, statement string, exchange string, item_code string, value double")
    sinks.write(df, str(tmp_path), "facts", ["parquet", "csv", "csv_parts", "stata"], ["statement", "exchange"])
    got = readers.statements(spark, f"{tmp_path}/facts.parquet", statement=["bs"], years=(2019, 2019))
    assert got.count() == 1 and "PartitionFilters: [isnotnull(statement" in got._jdf.queryExecution().toString()
    assert (tmp_path / "facts.csv").read_bytes().startswith(b"\xef\xbb\xbf") and pd.read_stata(tmp_path / "facts.dta").shape == (2, 6)
    assert readers.csv_table(spark, f"{tmp_path}/facts_csv").count() == 2
    names = sinks.stata_names(["a b", "A_B", "x" * 40, "X" * 40, "1a"])
    assert len({n.lower() for n in names.values()}) == 5 and max(map(len, names.values())) <= 32
    assert sinks.excel_safe(spark.createDataFrame([("=1\x01",)], "x string")).first().x == "'=1"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("xin chào\n")
    assert readers.text_folder(spark, f"{tmp_path}/t").first().text.strip() == "xin chào"
    assert set(sinks.research_pack(df, str(tmp_path / "pack"))) >= {"panel", "codebook", "report"}


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "2020-01-01"), (1, "a", "2020-01-01"), (2, "b", "2020-01-02")], "id int, t string, d string").withColumn("at", F.to_timestamp("d"))
    docs.write.parquet(f"{tmp_path}/in")
    stream = incremental.once_each(incremental.read_documents(spark, f"{tmp_path}/in", docs.schema), "id", "at")
    q = incremental.run_available(stream, lambda b: b.groupBy("t").count(), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r.t, r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 1), ("b", 1)}


def test_works_without_extra_package(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "vellumspark", tmp_path / "vellumspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[0] == 'p' and k[1].isdigit()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.stdout.startswith("['p5_found']"), out.stderr
    assert not [p for p in (root / "vellumspark").rglob("*.py") if "llm" not in p.parts and re.search(r"(?:from|import)\s+\S*\bllm\b", p.read_text())]


class TestLaborTables:
    @pytest.mark.parametrize(
        ("strategy", "text", "value"),
        [
            ("year_columns", "Chỉ tiêu | 2019 | 2020 | 2021\nTổng số lao động 1.200 1.310 1.405 người\nThu nhập 9 10 11", 1310),
            ("year_run", "2019\n2020\n2021\nSố lượng nhân viên\nngười\n812\n835\n901", 835),
            ("beside_year", "Số lượng lao động\nNăm 2019: 27 người\nNăm 2020: 31.250 người", 31250),
            ("whole", "Cơ cấu lao động năm 2020\nĐại học // 300 // 40%\nTổng cộng // 750 // 100%", 750),
            ("total_row", "Năm 2020\nĐại học 300\nPhổ thông 450\nTổng cộng:\n750", 750),
            ("note", "Tại ngày 31 tháng 12 năm 2021, Tập đoàn có 5.806 nhân viên (1/1/2021: 6.191 nhân viên).", 6191),
            ("plan_actual", "2020\nTổng số lao động\nngười\n10.211 (KH)\n10.095 (TH)\n98,9%", 10095),
            ("callout", "2020\n64.727 nhân viên\nTỔNG SỐ NHÂN VIÊN THEO CHUỖI", 64727),
        ],
    )
    def test_strategies(self, strategy, text, value):
        page = labor_tables.Page(text)
        found = [f for s in labor_tables.STRATEGIES if s.__name__ == strategy for f in s(page, 2020)]
        assert value in [f.value for f in found if f.matched], found
        assert not any(list(s(labor_tables.Page(x), 2020)) for s in labor_tables.STRATEGIES for x in ("", "Doanh thu 2020 đạt 1.234 tỷ đồng", "Tổng cộng\n1.500"))

    def test_frame(self, spark):
        note = "Tại ngày 31/12/2020 là 47 người (31/12/2019: 50 người)"
        df = spark.createDataFrame([("a", 1, 2020, note), ("a", 1, 2020, note), ("b", 2, 2020, None), ("c", 3, None, note), ("d", 4, 2020, ""), ("e", 5, 2020, "Lao động nữ tại 31/12/2020 là 40 người, tỷ lệ 40%"), ("f", 6, 2020, "x " * 100_000 + note)], "k string, strategy int, y int, t string")
        rows = labor_tables.candidates(df, ["k"], "t", "y").collect()
        assert sorted((r.k, r.value, r.matched) for r in rows) == sorted([("a", 47, True), ("a", 50, False)] * 2 + [("f", 47, True), ("f", 50, False)])
        assert labor_tables.candidates(df.limit(0), ["k"], "t", "y").count() == 0

    def test_pages(self, spark):
        df = spark.createDataFrame([(1, 1, "Tổng số lao"), (1, 2, "động năm 2020"), (2, 1, "khác")], "d int, p int, t string")
        assert [r.context for r in labor_tables.with_tails(df, ["d"], "p", "t").orderBy("d", "p").collect()] == ["Tổng số lao động năm 2020", "Tổng số lao động năm 2020", "khác"]
        assert one(spark, "Tổng số lao động 31/12/2020: 9 người", labor_tables.page_score(F.col("x"), F.lit(2020))) == 65 and one(spark, "x", labor_tables.page_score(F.col("x"), F.lit(2020))) == 0


class TestDirectory:
    def test_edges(self, spark):
        local = lambda x, q: one(spark, x, directory.local_predicate(F.col("x"), q))
        assert local("ABCD", "BC") and local("ABCD", "XYZ, BC") and not local("ABCD", "XYZ, BCD") and local("ABCD", "XYZ, ABCD") and local("ABCD", None)
        df = spark.createDataFrame([(1, 2, 3)], "Company_Name int, b int, c int")
        assert directory.without(df, ["COMPANY_NAME"]).columns == ["b", "c"] and directory.company_info(df).columns == ["Company_Name", "b"]
        firms = spark.createDataFrame([("A", None, "s"), ("A", None, "s"), ("B", "HOSE", "t"), (None, None, None)], "ticker string, exchange_code string, industry string")
        sectors = spark.createDataFrame([("1010", "X", "s"), ("1020", "X", "t"), ("2010", "Y", "u")], "icb_code string, icb_l1 string, sector_name string")
        nodes = {(r.level, r.icb_l1, r.icb_l4): r.n for r in directory.tree(firms, sectors, F.lit(1)).collect()}
        assert nodes[1, "X", None] == 2 and nodes[4, "Y", "u"] == 0 and nodes[1, "Y", None] == 0
        assert directory.tree(firms.limit(0), sectors, F.lit(1)).where("n > 0").count() == 0
        places = {r.icb_l1: r.place for r in directory.in_order(directory.tree(firms, sectors, F.lit(1))).where("level = 1").collect()}
        assert places == {"X": 1, "Y": 2}

    def test_templates(self, spark):
        names = spark.createDataFrame([(2020, "tổng tài sản"), (2020, "tổng tài sảm"), (2020, "khác hẳn"), (2021, "tổng tài sảm"), (2020, None)], "year int, name string")
        templates = spark.createDataFrame([(2020, "tổng tài sản", "bs1"), (2020, "tổng nợ", "bs2")], "year int, name string, item_code string")
        assert sorted((r.name, r.item_code) for r in finance.match_templates(names, templates).collect()) == [("tổng tài sảm", "bs1"), ("tổng tài sản", "bs1")]

    def test_brands(self, spark):
        assert one(spark, "x", news.brand_order(F.array(F.lit("ab"), F.lit("abc"), F.lit("aa"), F.lit("ab")))) == ["abc", "aa", "ab"]


class TestSmallSources:
    def test_office_files(self, spark, tmp_path):
        import sqlite3
        import zipfile

        from vellumspark.sources import office

        m, w = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>từ khóa</t></si><si><r><t>sổ</t></r><r><t> cái</t></r></si></sst>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>trọng số</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row/></sheetData></worksheet>')
        rows = office.workbook_rows(tmp_path / "a.xlsx")
        assert rows == [["từ khóa", "", "trọng số"], ["sổ cái", "", "2.5"], []]
        assert [(r.keyword, r.weight) for r in dictionary.from_sheet(spark, office.as_sheet(rows)).collect()] == [("sổ cái", 2.5)]
        p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
        with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Đầu")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>{p("")}</w:body></w:document>')
        assert office.document_rows(tmp_path / "a.docx") == [["Đầu"], ["a", "b"]]
        with sqlite3.connect(tmp_path / "a.db") as db:
            db.execute("create table k (a text, b int)")
            db.execute("insert into k values ('x', 1), (null, null)")
        assert [tuple(r) for r in office.database_table(spark, tmp_path / "a.db", "k").collect()] == [("x", "1"), (None, None)]
        with pytest.raises(ValueError):
            office.database_table(spark, tmp_path / "a.db", "k; drop table k")
        assert office.local_first(tmp_path / "a.db", "s3") == "s3" and office.local_first(tmp_path / "a.db", "s3", 10).endswith("a.db")

    def test_dictionary_store(self, spark, tmp_path):
        store = dictionary.Store(spark, str(tmp_path / "topics"))
        assert store.topics() == []
        old = dictionary.from_list(spark, ["Sổ cái", "AI"])
        store.save("a", old)
        store.save("a", dictionary.put(store.load("a"), dictionary.from_list(spark, ["sổ CÁI", "ML"])))
        assert store.topics() == ["a"] and sorted(r.keyword for r in store.load("a").collect()) == ["AI", "ML", "sổ CÁI"]
        assert sorted(r.keyword for r in dictionary.without(old, spark.createDataFrame([("ai",)], "keyword string")).collect()) == ["Sổ cái"]
        assert dictionary.import_entries(old, old).count() == 2 and dictionary.import_entries(old, old.limit(0), "new").count() == 0
        assert [r.keyword for r in dictionary.resolve(spark, " x ", "y", "a", None, store).collect()] == ["x"]
        assert dictionary.resolve(spark, "", None, "missing", "a", store).count() == 3
        with pytest.raises(LookupError):
            dictionary.resolve(spark, store=store)
        assert store.delete("a") and store.topics() == []

    def test_corrections_and_lines(self, spark):
        from vellumspark.functions import corrections

        assert one(spark, "CÔNO TY CỎ PIIẦN cổ  phản http:llwww.x", corrections.correct_headings(F.col("x"))) == "CÔNG TY CỔ PHẦN cổ  phần http://www.x"
        assert one(spark, "Một\n\n Xem thêm: hai\nTin khácx\nTags: y", news.without_boilerplate(F.col("x"))) == "Một\n\nTin khácx"
        said = lambda t, s=None: one(spark, t, news.company_confirmed(F.lit("ABC"), F.lit(None).cast("string"), F.col("x"), F.lit(""), F.lit(""), F.lit(s)))
        assert said("mã ck abc tăng") and said("(ABC)") and not said("abc tăng") and not said("XABC") and said("gì", "custom_feed") and not said("gì", "x")
