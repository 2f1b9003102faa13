"""Small cases of the training-data operators."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

chars = pytest.importorskip("vellumspark.llm.chars")
from vellumspark.llm import encoding, leakage, packing, scanned, survivors, truncation  # noqa: E402
from vellumspark.llm.words import hashed_words  # noqa: E402

VI = "Đơn vị tuyển thêm kỹ sư và tổ chức lớp đào tạo trong năm. Khoản chi cho sổ cái số hóa do phòng kinh doanh phụ trách. Trước rủi ro thanh khoản, ban kiểm soát lựa chọn lập quỹ dự phòng."


def norm(*texts):
    out, changed = chars.normalise(pa.array(list(texts), pa.string()))
    return out.to_pylist(), changed.tolist()


class TestChars:
    def test_forms(self):
        texts, changed = norm("ｄｅｐｏｔ", "chi\u00a0phí", "sma\u200brt", "сhi phí", "tiê\u0301t", "e\u0302\u0323", "ﬁnal", "a\u0323\u0302")
        assert texts == ["depot", "chi phí", "smart", "chi phí", "tiết", "ệ", "final", "ậ"]
        assert all(changed)

    def test_what_stays(self):
        kept = ["m² và ½", "Россия", "β-glucan", "25 °C", "hóa và hoá", "“On time – in full”", "", "VÃ\xad thanh toÃ¡n", "plain", "tr\xadêng, ®éi ngò kü thuËt"]
        texts, changed = norm(*kept)
        assert texts == kept and not any(changed)

    def test_null_long_and_order(self):
        long = "ａ" * 100_000
        texts, changed = norm(None, long, "", "x")
        assert texts == [None, "a" * 100_000, "", "x"] and changed == [False, True, False, False]

    def test_equals_rule_by_rule(self):
        import unicodedata

        r = random.Random(3)
        letters = "aăâeêioôơuưyđAĂÂEÊOÔƠUƯ"
        marks = "\u0300\u0301\u0303\u0309\u0323\u0306\u0302\u031b"
        for _ in range(300):
            t = "".join(r.choice(letters) + "".join(r.sample(marks, r.choice((0, 0, 1, 2)))) for _ in range(8))
            assert unicodedata.normalize("NFC", norm(t)[0][0]) == unicodedata.normalize("NFC", t)

    def test_frame(self, spark):
        df = spark.createDataFrame([(1, "sma\u200brt", None), (2, None, "x"), (2, None, "x")], "id long, text string, field_name string")
        rows = chars.consistent(df, "id", {"text": "t.text", "field_name": "t.field_name"}).collect()
        assert len(rows) == 6 and sum(r.changed for r in rows) == 1
        assert chars.consistent(df.limit(0), "id", {"text": "t"}).count() == 0


class TestEncoding:
    def maps(self, *garbled):
        clean = [VI, VI.upper(), "The board signed the plan. Costs reached a new level."] * 30
        counts = next(encoding._pairs(iter([pa.RecordBatch.from_arrays([pa.array([*clean, *garbled])], names=["t"])]))).to_pylist()
        return encoding.learn([tuple(r.values()) for r in counts])

    @pytest.mark.parametrize("page", ["cp1252", "cp437", "mac_roman", "cp1258"])
    def test_round_trip(self, page):
        byte = {v: k for k, v in encoding._readings()[page][0].items()}
        bad = "".join(chr(b) if b < 0x80 else byte[b] for b in VI.encode())
        text, source, whole = encoding.restore(bad, self.maps(*[bad] * 20))
        assert text == VI and source in (page, "cp1252") and whole

    @pytest.mark.parametrize(("page", "listed"), [("cp1250", True), ("koi8_r", True), ("koi8_r", False), ("cp852", False)])
    def test_page_is_recognised_by_the_mapping(self, monkeypatch, page, listed):
        """The learned mapping tells the page; without a page that agrees, it restores by itself; without it, nothing is found."""
        r = random.Random(4)
        words = (VI + " Lợi nhuận gộp đạt mức cao hơn do khách hàng lớn lùi lịch nhận hàng. Khối sản xuất đã hoàn tất hợp đồng. Bộ phận nhân sự chủ động cắt giảm chi phí cố định. Hội đồng quản trị thông qua kế hoạch tái cấu trúc ở miền Đông và các tỉnh lân cận.").split()
        texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(600)]
        byte = {v: k for k, v in encoding._readings()[page][0].items()}
        garble = lambda t: "".join(chr(b) if b < 0x80 else byte[b] for b in t.encode())
        if not listed:
            known = {k: v for k, v in encoding._readings().items() if k not in (page, "kz1048", "ptcp154", "koi8_u")}
            encoding._roles.cache_clear()
            monkeypatch.setattr(encoding, "_readings", lambda: known)
        bad = [garble(t) for t in texts[300:]]
        assert encoding.suspicious(pa.array(bad)).all()
        counts = next(encoding._pairs(iter([pa.RecordBatch.from_arrays([pa.array(texts[:300] + bad)], names=["t"])]))).to_pylist()
        maps = encoding.learn([tuple(x.values()) for x in counts])
        source = encoding.source_of(bad[0])[0]
        if listed:
            assert maps[encoding.PAGE][source][0] == page
            assert [encoding.restore(b, maps)[0] for b in bad] == texts[300:]
        else:
            same = [encoding.restore(b, maps) for b in bad]
            assert sum(x is not None for x in same) >= 0.95 * len(bad)
            right = [sum(a == b for a, b in zip(x[0].split(), t.split(), strict=False)) / 40 for x, t in zip(same, texts[300:], strict=True) if x]
            assert sum(right) / len(right) > 0.5
        assert encoding.restore(bad[0], {"": maps[""]}) is None
        encoding._roles.cache_clear()

    def test_twice(self):
        bad = VI.encode().decode("latin-1").encode().decode("latin-1")
        once = VI.encode().decode("latin-1")
        assert encoding.restore(bad, self.maps(bad, *[once] * 20))[0] == VI

    def test_lost_byte_and_capitals(self):
        # cp1258 leaves bytes undefined: U+FFFD stands for the last byte of đ's capital and of several vowels
        byte = {v: k for k, v in encoding._readings()["cp1258"][0].items()}
        undefined = (0x81, 0x8A, 0x8D, 0x8E, 0x8F, 0x90, 0x9A, 0x9D, 0x9E, 0x9F)
        bad = "".join(chr(b) if b < 0x80 else "\ufffd" if b in undefined else byte[b] for b in VI.encode())
        assert "Ä\ufffd" in bad
        maps = self.maps(*[bad] * 20)
        text, source, _ = encoding.restore(bad, maps)
        assert text == VI and source in encoding._readings()
        maps = self.maps(*[VI.encode().decode("latin-1")] * 20, *[bad] * 20)
        assert encoding.restore("Ä\ufffdÆ¡n vá»‹", maps) == ("Đơn vị", "cp1252", True)
        assert encoding.restore("tá»‘ chá»©c ngÆ°á»\ufffdi", maps)[2] is False
        assert encoding.restore("CÃ”NG TY LáºªCH, LáºCH Tá»•".replace("LáºCH", "Láº\u00a0CH"), maps)[0] == "CÔNG TY LẪCH, LẠCH Tổ"

    def test_lost_and_clean(self):
        maps = self.maps()
        assert encoding.restore("L?c l??ng nhân s? bình quân c?a n?m", maps)[1:] == ("lost", False)
        assert encoding.restore("so v\ufffd\ufffdi n\ufffdm", maps)[1] == "lost"
        for clean in (VI, "Hỏi ai? Hỏi gì?", "Café Orlané and the Ångmar desk", "São Tovaro, Çelmek", "(±2%) 25 °C m² ½ £5 µm", "ĐÃ\xa0QUA", "", "Россия"):
            assert encoding.restore(clean, maps) is None, clean

    def test_font_learned(self):
        font = {"á": "aù", "à": "aø", "ả": "aû", "ạ": "aï", "â": "aâ", "ấ": "aá", "ô": "oâ", "ố": "oá", "ổ": "oå", "ộ": "oä", "ọ": "oï", "ờ": "ôø", "ơ": "ô", "ớ": "ôù", "ê": "eâ", "ể": "eå", "ư": "ö", "ự": "öï", "ữ": "öõ", "đ": "ñ", "Đ": "Ñ", "ò": "oø", "ủ": "uû", "ụ": "uï", "ỹ": "yõ", "ậ": "aä", "ế": "eá", "í": "í", "ó": "où", "ướ": "öôù", "ị": "ò", "ỉ": "æ", "ĩ": "ó", "ũ": "uõ", "ù": "uø", "ì": "ì", "ă": "aê", "ề": "eà", "ệ": "eä"}
        r = random.Random(2)
        words = (VI + " Lợi nhuận gộp đạt mức cao hơn do khách hàng lớn lùi lịch nhận hàng. Khối sản xuất đã hoàn tất hợp đồng. Bộ phận nhân sự chủ động cắt giảm chi phí cố định.").split()
        texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(400)]
        clean, garbled = texts[:200], ["".join(font.get(c, c) for c in t) for t in texts[200:]]
        counts = next(encoding._pairs(iter([pa.RecordBatch.from_arrays([pa.array(clean + garbled)], names=["t"])]))).to_pylist()
        maps = encoding.learn([tuple(x.values()) for x in counts])
        bad = "".join(font.get(c, c) for c in VI)
        text, source, _ = encoding.restore(bad, maps)
        assert source == "mark" and sum(a == b for a, b in zip(text.split(), VI.split(), strict=False)) >= 0.8 * len(VI.split())

    def test_frame(self, spark):
        bad = VI.encode().decode("latin-1")
        df = spark.createDataFrame([(1, bad, "x"), (2, VI, "x"), (3, None, "x"), (3, "", "x")], "id long, text string, source string")
        maps = encoding.mapping(df.select("text"))
        rows = encoding.repaired(df, "id", {"text": "t.text"}, maps).collect()
        assert [(r.record_id, r.text) for r in rows] == [(1, VI)]
        assert encoding.repaired(df, "id", {"text": "t"}, maps, only_found=False).count() == 4
        assert encoding.repaired(df.limit(0), "id", {"text": "t"}, encoding.mapping(df.limit(0).select("text"))).count() == 0


class TestScanned:
    @pytest.fixture(scope="class")
    def know(self, spark):
        r = random.Random(1)
        rows = [(i, VI + f" Mục tiêu năm {2000 + i % 20} là doanh thu {i} tỷ đồng. low-carbon audit B2B.") for i in range(200)]
        words = VI.split()
        for i in range(60):
            k = r.randint(8, 30)
            body = "\n".join([" ".join(words[:k]), f"Trang {i}", " ".join(words[k:38]), f"[{i}]", " ".join(words[38:])])
            rows.append((1000 + i, body))
            rows.append((2000 + i, " ".join(words[:k]) + f"\nBÁO CÁO THƯỜNG NIÊN {2000 + i % 20}\n" + " ".join(words[k:])))
        return scanned.learn(spark.createDataFrame(rows, "id long, t string").select("t"))

    @pytest.mark.parametrize(
        ("bad", "good"),
        [
            ("Khoản chi cho sổ cái số hóa do ph-\nòng kinh doanh phụ trách.", "Khoản chi cho sổ cái số hóa do phòng kinh doanh phụ trách."),
            ("Khoản chi cho sổ cái số hóa do phò¬\r\n  ng kinh doanh phụ trách.", "Khoản chi cho sổ cái số hóa do phòng kinh doanh phụ trách."),
            ("Khoản chi cho sổ cái số hóa\nTrang 12\ndo phòng kinh doanh phụ trách.", "Khoản chi cho sổ cái số hóa do phòng kinh doanh phụ trách."),
            ("Khoản chi cho sổ cái\nBÁO CÁO THƯỜNG NIÊN 2011\nsố hóa do phòng kinh doanh phụ trách.", "Khoản chi cho sổ cái số hóa do phòng kinh doanh phụ trách."),
            ("Kliản kỹ sư và tổ cliức lớp đào tạo", "Kliản kỹ sư và tổ chức lớp đào tạo"),
            ("Trước rủi r0 thanh kh0ản, ban k|ểm soát", "Trước rủi ro thanh khoản, ban kiểm soát"),
        ],
    )
    def test_repairs(self, know, bad, good):
        assert scanned.repair(bad, know) == (good, True)

    @pytest.mark.parametrize("text", [VI, "Khoản chi cho sổ cái số hóa\ndo phòng kinh doanh phụ trách.", "low-\ncarbon audit", "B2B và 5S, Q3", "là doanh thu\n12\ntỷ đồng", "", "tuyển thêm kỹ sư và tổ"])
    def test_no_case(self, know, text):
        assert not scanned.repair(text, know)[1]

    def test_joins_ask_the_vocabulary(self, know):
        for text in ("zzq-\nxxk", "sổ-\nzzq"):
            assert scanned.repair(text, know) == (text.replace("\n", " "), False)
        assert scanned.repair("zz¬\nxxk", know) == ("zzxxk", True)  # such a mark parts one word only
        assert scanned.repair("ph-\nò-\nng kinh doanh", know) == ("phòng kinh doanh", True)
        assert scanned.repair("сh-\ni cho", know)[1]  # a look-alike letter in the first half

    def test_page_numbers_that_run_on(self, know):
        text = "Mục tiêu năm\n7\nlà doanh thu cao hơn mục tiêu năm\n8\nlà doanh thu"
        assert scanned.repair(text, know) == ("Mục tiêu năm là doanh thu cao hơn mục tiêu năm là doanh thu", True)
        assert not scanned.repair("Mục tiêu năm\n7\nlà doanh thu", know)[1]
        assert scanned._running(["a", "3/9", "b", "c", "4/9", "5", "7"]) == {1, 4} and scanned._running(["5", "6"]) == set()

    def test_misread_furniture(self, know):
        text = "Khoản chi cho sổ cái số hóa do phòng\nBÁO CÁO THƯỜNG NlÊN 2011\nkinh doanh phụ trách."
        assert scanned.repair(text, know) == ("Khoản chi cho sổ cái số hóa do phòng kinh doanh phụ trách.", True)

    def test_any_number_of_spots(self, know):
        know.words["ll" * 10 + "bin"], know.total = 500, 2_000_000
        know._start()
        assert know.true_form("1l" * 10 + "bln") == "ll" * 10 + "bin"
        del know.words["ll" * 10 + "bin"]
        know._start()

    def test_judged_by_shares(self):
        words = {"phòng": 400, "kinh": 300, "ho": 300, "rn": 1}
        small, large = scanned.Knowledge(words, {}, [], total=10**6), scanned.Knowledge({w: 10 * n for w, n in words.items()}, {}, [], total=10**7)
        for token in ("ph0ng", "phònq", "k1nh", "klnh", "h0", "rn", "x"):
            assert small.true_form(token) == large.true_form(token)
        assert small.true_form("phònq") == "phòng"

    def test_frame(self, spark, know):
        df = spark.createDataFrame([(1, "do ph-\nòng kinh doanh", "a"), (2, None, "b"), (3, "", "c"), (1, "do ph-\nòng kinh doanh", "a"), (4, VI * 400, "d")], "id long, text string, found string")
        rows = scanned.continuous(df, "id", {"text": "t.text"}, know).collect()
        assert len(rows) == 5 and [r.record_id for r in rows if r.found] == [1, 1]
        assert scanned.continuous(df, "id", {"text": "t.text"}, know, only_found=True).count() == 2
        empty = df.limit(0)
        assert scanned.continuous(empty, "id", {"text": "t"}, scanned.learn(empty.select("text"))).count() == 0


class TestSurvivors:
    COLUMNS = "report_id long, company_id long, ticker string, report_year int, pdf_path string, ocr_path string, total_pages int, total_words int, is_scanned boolean, ocr_status string, mining_status string, record_source string, updated_at timestamp, firm string"

    def rows(self, spark):
        at = pd.Timestamp("2021-01-01").to_pydatetime()
        return spark.createDataFrame(
            [
                (1, 7, "hsx:ABC1", 2019, "incoming/scan.pdf", None, None, 5, False, "done", "done", "issuer_site", at, "z"),
                (2, None, None, 2019, "D:\\kho\\ABC1\\ABC1_2019_BCTN.pdf", "ocr/a.txt", 80, None, True, "done", "done", "manual", at, "z"),
                (3, 7, "ＡＢＣ１", 2019, "x/ABC1/ABC1_2018_BCTN.pdf", None, 81, 9, True, "done", "done", "issuer_site", at, "z"),
                (4, None, "ABC1.VN", 2020, None, None, 3, None, None, None, None, None, None, "z"),
                (5, None, None, 2019, None, None, None, None, None, None, None, None, None, "z"),
                (6, None, "ABC1", None, None, None, None, None, None, None, None, None, None, "z"),
                (1, 7, "hsx:ABC1", 2019, "incoming/scan.pdf", None, None, 5, False, "done", "done", "issuer_site", at, "z"),
            ],
            self.COLUMNS,
        )

    def test_pairs(self, spark):
        got = {tuple(r) for r in survivors.duplicate_pairs(self.rows(spark)).collect()}
        assert got == {(1, 2), (1, 3), (2, 3)}

    def test_survivor(self, spark):
        sources = spark.createDataFrame([("issuer_site", 1), ("manual", 6), ("x", None)], "source string, trust_rank int")
        out = {(r.firm, r.report_year): r for r in survivors.survivors(self.rows(spark), sources).collect()}
        best = out["ABC1", 2019]
        # the path of another year is no candidate, a file without pages loses to one with them
        assert (best.pdf_path, best.total_pages, best.ticker, best.company_id) == ("D:\\kho\\ABC1\\ABC1_2019_BCTN.pdf", 80, "ABC1", 7)
        assert len(out) == 4 and out["ABC1", 2020].total_pages == 3
        assert survivors.survivors(self.rows(spark).limit(0), sources).count() == 0

    def test_firm_determines_company(self, spark):
        at = pd.Timestamp("2021-01-01").to_pydatetime()
        # the most trusted row of 2019 names a company that the firm's other rows contradict
        rows = [(1, 9, "ABC1", 2019, None, None, None, None, None, "a", "a", "one", at, "z"), (2, None, "HSX:ABC1", 2019, None, None, None, None, None, "a", "a", "two", at, "z")]
        rows += [(10 + k, 7, "ABC1", 2010 + k, None, None, None, None, None, "a", "a", "two", at, "z") for k in range(4)]
        sources = spark.createDataFrame([("one", 1), ("two", 2)], "source string, trust_rank int")
        out = {(r.firm, r.report_year): (r.ticker, r.company_id) for r in survivors.survivors(spark.createDataFrame(rows, self.COLUMNS), sources).collect()}
        assert out["ABC1", 2019] == ("ABC1", 7) and len(out) == 5

    def test_files_that_differ_in_scanned_only(self, spark):
        at = pd.Timestamp("2021-01-01").to_pydatetime()
        rows = [(1, None, "ABC1", 2019, "ABC1_2019.pdf", None, 80, None, False, "a", "a", "one", at, "z"), (2, None, "ABC1", 2019, "ABC1_2019_BCTN.pdf", None, 81, 9, True, "b", "b", "two", at, "z")]
        sources = spark.createDataFrame([("one", 1), ("two", 2)], "source string, trust_rank int")
        out = survivors.survivors(spark.createDataFrame(rows, self.COLUMNS), sources).collect()
        assert [(r.file_report_id, r.total_pages, r.is_scanned, r.total_words) for r in out] == [(2, 81, True, 9)]

    def test_pre_aggregation_loses_no_choice(self, spark):
        r = random.Random(11)
        at = pd.Timestamp("2021-01-01").to_pydatetime()
        rows, rank = [], {f"s{k}": k for k in range(6)}
        for i in range(240):
            firm = f"AB{i // 6}X"
            path = r.choice([None, f"{firm}_2019.pdf", f"{firm}_2018.pdf", "incoming/1.pdf"])
            rows.append((i, r.choice([None, 5]), r.choice([firm, "HSX:" + firm]), 2019, path, None, r.choice([None, 10 + i]), r.choice([None, i]), r.choice([None, True, False]), "a", "a", r.choice(list(rank)), at, "z"))
        sources = spark.createDataFrame(list(rank.items()), "source string, trust_rank int")
        out = {x.firm: x for x in survivors.survivors(spark.createDataFrame(rows, self.COLUMNS), sources).collect()}
        trust = lambda x: 1 / (1 + rank[x[11]])
        file = lambda x: 2 * trust(x) + 2 * (x[6] is not None) + 2 * (x[4] is not None) + (x[4] is not None and x[4][0] == "A")
        content = lambda x: trust(x) + (x[7] is not None)
        for firm, got in out.items():
            group = [x for x in rows if x[2].endswith(firm)]
            pairs = [(file(f) + content(c), f, c) for f in group if not (f[4] or "").endswith("2018.pdf") for c in group if None in (f[8], c[8]) or f[8] == c[8]]
            if pairs:
                best = max(p[0] for p in pairs)
                assert any(abs(w - best) < 1e-9 and f[0] == got.file_report_id and c[7] == got.total_words for w, f, c in pairs), firm

    def test_search_is_exhaustive(self):
        r = random.Random(5)
        for _ in range(200):
            make = lambda: sorted(({"w": r.random(), "firm_ok": r.random() < 0.7, "year_ok": r.random() < 0.7, "company_ok": r.random() < 0.7, "scanned": r.choice([None, True, False])} for _ in range(r.randint(1, 5))), key=lambda x: -x["w"])  # noqa: E731,B023
            a, b, c = make(), make(), make()
            a_ok = [x for x in a if x["company_ok"]]
            ok = lambda y, z: y["firm_ok"] and y["year_ok"] and (z["scanned"] is None or y["scanned"] is None or z["scanned"] == y["scanned"])
            best = max((x["w"] + y["w"] + z["w"] for x in a_ok for y in b for z in c if ok(y, z)), default=None)
            i, j, k = survivors._search(a, b, c)
            assert (best is None and (i, j, k) == (0, 0, 0)) or abs(a[i]["w"] + b[j]["w"] + c[k]["w"] - best) < 1e-9


class TestPacking:
    def test_plan(self):
        for seed in range(60):
            r = random.Random(seed)
            size = r.choice([10, 50, 512])
            counts = {r.randint(1, size): r.randint(1, 40) for _ in range(r.randint(1, 30))}
            fill, taken = {}, set()
            for length, a, b, first, each in packing.plan(counts, size):
                for k in range(a, b + 1):
                    box = first + (k - a) // each
                    fill[box] = fill.get(box, 0) + length
                    assert (length, k) not in taken
                    taken.add((length, k))
            assert max(fill.values()) <= size and len(taken) == sum(counts.values()) and sorted(fill) == list(range(1, len(fill) + 1))
            # best fit never leaves two containers that fit into one
            low = sorted(fill.values())[:2]
            assert len(low) < 2 or sum(low) > size

    def test_pack(self, spark):
        r = random.Random(2)
        rows = [(i, r.choice([0, 7, 7, 7, r.randint(1, 25)]), "x") for i in range(300)] + [(None, 3, "x")]
        out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, length string"), 10).toPandas()
        assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n, _ in rows if i is not None}
        assert out.groupby("container_id").n_tokens.sum().max() <= 10
        split = out[out.duplicated("doc_id", keep=False)]
        assert set(split.doc_id) == {i for i, n, _ in rows if i is not None and n > 10}

    def test_salted_ranks(self, spark, monkeypatch):
        monkeypatch.setattr(packing, "PART_ROWS", 20)
        out = packing.pack(spark.createDataFrame([(i, 5) for i in range(200)], "doc_id long, n_tokens long"), 10).toPandas()
        assert out.container_id.nunique() == 100 and (out.groupby("container_id").size() == 2).all()

    def test_slots_of_a_hot_length(self, spark):
        """One length is spread over many plan rows; documents meet few of them, and each takes one slot."""
        r = random.Random(6)
        rows = [(i, 3 if i % 3 else r.randint(4, 40)) for i in range(900)]
        out = packing.pack_lengths(spark.createDataFrame(rows, "doc_id long, n_tokens long"), {5: 41, 9: 16}).toPandas()
        for target, size in ((5, 41), (9, 16)):
            mine = out[out.target_id == target]
            assert mine.groupby("doc_id").n_tokens.sum().to_dict() == dict(rows) and mine.groupby("container_id").n_tokens.sum().max() <= size
            assert not mine.duplicated(["doc_id", "part"]).any()

    def test_texts(self, spark):
        docs = spark.createDataFrame([(1, VI), (2, None), (3, ""), (4, VI * 300)], "doc_id long, text string")
        targets = spark.createDataFrame([(1, 64), (2, 2048)], "target_id long, capacity_tokens int")
        out = packing.pack_all(docs, targets).toPandas()
        assert set(out[out.target_id == 1].doc_id) == {1, 2, 3, 4}
        assert out.groupby(["target_id", "container_id"]).n_tokens.sum().reset_index().query("target_id == 1").n_tokens.max() <= 64
        assert packing.pack_all(docs.limit(0), targets).count() == 0 and packing.pack_all(docs, targets.limit(0)).count() == 0


ITEM = "Once the daily wage passed 15, the Camwood lodge quietly returned 369 reams; the silk printers past the shrine reweighed the dew-dried tung oil because the pontoon snapped on the third night."


class TestLeakage:
    def frames(self, spark, texts):
        docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
        items = spark.createDataFrame([(1, ITEM, "x"), (2, "too short to leak", "x"), (3, None, "x")], "item_id long, text string, doc_id string")
        return {(r.doc_id, r.item_id, r.kind) for r in leakage.leaks(docs, items).collect()}

    def test_cases(self, spark):
        w = ITEM.split()
        altered = list(w)
        for k in (3, 11, 19):
            altered[k] = "xyz"
        dropped = [x for i, x in enumerate(w) if i not in (4, 12)]
        texts = [
            "Before. " + ITEM + " After.", ITEM.upper(), " ".join(altered), " ".join(dropped), " ".join(w[5:23]), " ".join(w[5:21]), None, "",
            " ".join(x if i % 3 else "zz" for i, x in enumerate(w)), VI * 500 + " " + ITEM, "Once the daily wage passed 80, the Camwood lodge quietly returned 12 reams; the silk printers past the shrine reweighed",
        ]
        got = self.frames(spark, texts)
        found = {d for d, i, kind in got if kind == "verbatim"}
        assert found >= {0, 1, 2, 3, 4, 9} and not found & {5, 6, 7, 8}
        assert {i for _, i, _ in got} == {1}

    def test_empty(self, spark):
        docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
        items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
        assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0
        assert leakage.leaks(docs.unionAll(docs), items).count() == 2

    @pytest.mark.parametrize("words", [1, 60, 400, 10**6])
    def test_blocks(self, spark, monkeypatch, words):
        """Rows of both kinds don't depend on the size of a block."""
        monkeypatch.setattr(leakage, "BLOCK_WORDS", words)
        pool = ["Astra", "Belo", "Corvo", "Dena", "Esto", "Fino", "Gano", "Hilo"]
        made = lambda k, n: "Today {} sold {} kg of figs to {} for {} coins while {} bought {} kg of salt from {} for {} coins at the old port.".format(*(x for j in range(4) for x in (pool[(k + 2 * j) % 8], n + 7 * j)))
        items = spark.createDataFrame([(i, made(i, 100 * i + 3)) for i in range(4)] + [(9, ITEM)], "item_id long, text string")
        docs = spark.createDataFrame([(1, "Well. " + made(0, 3)), (2, made(5, 911)), (3, ITEM)], "doc_id long, text string")
        got = {(r.doc_id, r.item_id, r.kind) for r in leakage.leaks(docs, items).collect()}
        assert {x for x in got if x[2] == "verbatim"} == {(1, 0, "verbatim"), (3, 9, "verbatim")}
        assert {x for x in got if x[2] != "verbatim"} == {(1, i, "reparameterised") for i in (1, 2, 3)} | {(2, i, "reparameterised") for i in range(4)}
        assert got == getattr(type(self), "seen", got)
        type(self).seen = got

    def test_numbers_alone(self):
        """A table of numbers against numeric items: no placeholder window seeds anything, equal numbers are counted in pieces."""
        import resource

        r = random.Random(3)
        texts = [" ".join(str(r.randint(0, 10**6)) for _ in range(100)) for _ in range(1000)]
        none = np.empty(0, np.uint64)
        items = leakage.Items(list(range(1000)), texts, none, none)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        found = leakage.find(pa.array([" ".join(str(r.randint(0, 10**6)) for _ in range(20_000)) + " " + texts[7]]), items)
        assert {f[1] for f in found} == {7}
        zeros = leakage.Items([1], ["0 " * 3000], none, none)
        assert leakage.find(pa.array(["0 " * 4000]), zeros)[0][1] == 0
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000

    def test_longest_run_brute_force(self):
        r = random.Random(4)
        for _ in range(300):
            same = [r.random() < 0.8 for _ in range(r.randint(1, 40))]
            want = 0
            for i in range(len(same)):
                for j in range(i + 1, len(same) + 1):
                    e = sum(not x for x in same[i:j])
                    if same[i] and same[j - 1] and (j - i) - leakage.ONE_IN * e >= -(leakage.ONE_IN // 2):
                        want = max(want, j - i)
            assert leakage.longest_run([], same)[0] == want


class TestTruncation:
    def test_alignment(self):
        text = " ".join(f"Câu số {i} nói về kế hoạch năm {2000 + i} của đơn vị." for i in range(40))
        for cut in range(len(text) - 120, len(text) - 1):
            short = text[:cut].rstrip()
            want = 1 if not (short.endswith(".") and text[len(short) : len(short) + 1] in (" ", "")) else 0
            assert truncation.align_end(short, text) in ((want,) if cut < len(text) - 4 else (want, 2)), short[-20:]
            assert truncation.align_end(short + "…", text) in (1, 2) or not want
        assert truncation.align_end(text, text) == 2 and truncation.align_end("Khác hẳn " * 30, text) is None
        assert truncation.align_end(text[:900] + ". " + "Lời kết khác hẳn của bản in lại do ban biên tập viết thêm.", text) == 2

    @staticmethod
    def bodies(n, words, seed=3):
        r = random.Random(seed)
        pool = ["".join(r.choice("bcdghklmnt") + r.choice("aeiouy") for _ in range(r.randint(1, 3))) for _ in range(3000)]
        out = []
        for _ in range(n):
            w = [r.choice(pool) for _ in range(words)]
            out.append(" ".join(x + "." if k % 11 == 10 else x for k, x in enumerate(w)) + " xong rồi nhé.")
        return out

    @pytest.mark.parametrize("altered", [0.0, 0.01])
    def test_cut_copies_are_found(self, spark, altered):
        r = random.Random(8)
        full = self.bodies(60, 400)
        rows, want = [], set()
        for k, text in enumerate(full):
            rows.append((k, "a", text))
            for n, share in enumerate((0.95, 0.8, 0.5, 0.2)):
                w = [x if r.random() >= altered else "zz." if x.endswith(".") else "zz" for x in text.split()]
                end = int(len(w) * share)
                while w[end - 1].endswith(".") or text.split()[end - 1].endswith(".") or w[end - 1] == "zz":
                    end -= 1
                # a doubtful end: the closing mark is a figure's
                rows.append((1000 + k * 10 + n, "b", " ".join(w[:end])))
                want.add(1000 + k * 10 + n)
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        found = {r.doc_id: r.by_copy for r in truncation.cut_documents(docs).collect()}
        by_copy = {d for d, c in found.items() if c}
        assert not by_copy - want and set(found) == want
        # brute force: the pairs that the alignment accepts
        texts = {d: t for d, _, t in rows}
        near = {d for d in want if truncation.align_end(texts[d], full[(d - 1000) // 10]) == 1}
        assert len(near) >= 0.6 * len(want) and len(by_copy & near) >= 0.9 * len(near)

    def test_copy_overrules_closing(self, spark):
        base = self.bodies(3, 120)
        # an address line closes no sentence, yet the longer copy ends a line there; figures end in a mark, yet the copy goes on
        rows = [(1, "s", base[0] + "\nhai bà trưng mới\n" + base[1]), (2, "s", base[0] + "\nhai bà trưng mới"), (3, "s", base[2] + " mức 3.512 tỷ nữa. " + base[1]), (4, "s", base[2] + " mức 3."), (5, None, None), (6, "", "")]
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        assert [(r.doc_id, r.by_copy) for r in truncation.cut_documents(docs).collect()] == [(4, True)]

    def test_terminality_decides(self, spark):
        lines = [f"{b}\nBan Thư ký hội đồng quản trị" for b in self.bodies(50, 30)] + [f"{b} do Ban Thư ký hội đồng quản trị" for b in self.bodies(5, 30, 9)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
        c = truncation.learn(docs.select("text"))
        c.terminal = truncation.terminality(truncation.sign(docs, c))
        assert [c.is_cut(t) for t in lines] == [False] * 50 + [True] * 5
        c.terminal = {}
        assert all(c.is_cut(t) for t in lines)

    def test_marks(self):
        assert truncation._closed("xong." + "”)" * 50) and not truncation._closed("xong”")
        for text, at in (("ab …", 2), ("ab...", 2), ("ab [" + " " * 90 + "... ]", 2), ("ab (x...)", None), ("ab.", None), ("", None), ("...", 0)):
            assert truncation._cut_at(text) == at, text

    def test_documents(self, spark):
        r = random.Random(1)
        body = lambda: " ".join(r.choice(["Doanh thu năm nay tăng.", "Ban điều hành ký hợp đồng mới.", "Chi phí giảm nhẹ.", "Thị trường hồi phục."]) for _ in range(12))
        rows = [(i, "a", body() + r.choice(["", "\n— Hết —", "\n(Theo bản tin nội bộ)", " Danh sách gồm kho, xe, v.v..."])) for i in range(200)]
        cut = [(300 + i, "b", body() + t) for i, t in enumerate((" Ban điều hành ký h", " Doanh thu năm", " Chi phí giảm…", " Chi ph [...]", " Doanh thu nă\ufffd"))]
        full = [(400, "c", body() + "\n— Hết —"), (401, "c", None), (402, "c", ""), (403, None, body())]
        docs = spark.createDataFrame(rows + cut + full, "doc_id long, source string, text string").withColumn("by_copy", F.lit(1)).withColumn("tid", F.lit("x"))
        assert {r.doc_id for r in truncation.cut_documents(docs).collect()} == {300, 301, 302, 303, 304}
        share = {r.source: (r.n_docs, r.n_cut) for r in truncation.share_by_source(docs).collect()}
        assert share["b"] == (5, 5) and share["a"] == (200, 0) and share[None] == (1, 0)
        assert truncation.cut_documents(docs.limit(0)).count() == 0
        twice = truncation.cut_documents(docs.unionAll(docs)).groupBy("doc_id").count().collect()
        assert {r["count"] for r in twice} == {2} and len(twice) == 5

    def test_hot_bucket(self, spark):
        """Open copies of a hot text meet one partner a round, never each other; a partner that fails is followed by the next."""
        text = " ".join(f"Mục {i} của kế hoạch đạt mức {i * 7} tỷ đồng." for i in range(60))
        docs = spark.createDataFrame([(i, "s", text[: 1400 + 2 * i] + f" phần {i}") for i in range(150)] + [(999, "s", text)], "doc_id long, source string, text string")
        c = truncation.learn(docs.select("text"))
        rows = truncation.buckets(truncation.sign(docs, c))
        assert rows.where("asks").select("tid").distinct().count() == 150
        assert truncation.verdicts(docs, truncation.sign(docs, c), c).count() <= 150

    def test_every_near_copy_is_asked(self, spark):
        """Near-copies that end there (1) or have an ending of their own (2) are longer than those that go on, but don't hide them."""
        a, b, other, more = (self.bodies(4, 700, 21)[k].split() for k in range(4))
        text = lambda w, end: " ".join(w[: end - 1] + ["tiếp"])
        rows = [
            (1, text(a, 150)), (10, text(a, 150) + "\n" + " ".join(other)), (11, text(a, 150) + " " + " ".join(a[150:600]) + "."),
            (2, text(b, 150)), (20, " ".join(b[:138] + more) + "."), (21, text(b, 150) + " " + " ".join(b[150:600]) + "."),
        ]
        texts = dict(rows)
        assert [truncation.align_end(texts[x], texts[y]) for x, y in ((1, 10), (1, 11), (2, 20), (2, 21))] == [0, 1, 2, 1]
        docs = spark.createDataFrame([(i, "s", t) for i, t in rows], "doc_id long, source string, text string")
        assert {(r.doc_id, r.by_copy) for r in truncation.cut_documents(docs).collect()} == {(1, True), (2, True)}

    def test_lines_behind_a_cut_hide_no_copy(self, spark):
        words = self.bodies(1, 200, 23)[0].split()
        full, short = " ".join(words), " ".join([*words[:35], words[35].strip(".")])
        line = "Xem tiếp bản đầy đủ tại trang điện tử của công ty"
        docs = spark.createDataFrame([(1, "s", full), (2, "s", short + "\n" + line)], "doc_id long, source string, text string")
        c = truncation.Closings([("d", "", 2), ("l", line, 3), ("c", line, 0)])
        got = truncation.verdicts(docs, truncation.sign(docs, c), c)
        assert truncation.align_end(short, full) == 1 and [r.early for r in got.collect()] == [True]

    def test_ids_follow_the_length(self, spark):
        sizes = [1, 2, truncation.LONG - 1, truncation.LONG, *range(2**20, 2**20 + 8)]
        got = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", truncation.text_id(F.expr("repeat('x', n)")).alias("tid")).orderBy("n").collect()
        assert [r.tid for r in got] == sorted({r.tid for r in got}) and got[0].tid > 0

    def test_shingles_of_a_large_batch(self):
        """A batch of the size that Spark hands over takes the memory of a slice of it."""
        texts = pa.array(self.bodies(20, 250) * 200)
        alone = list(truncation._shingles(texts[:20]))
        tracemalloc.start()
        got = list(truncation._shingles(texts))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == alone * 200 and peak < 200_000_000

    def test_signatures_hold_for_heads(self):
        text = self.bodies(1, 3000)[0]
        head = " ".join(text.split()[: truncation.HEAD * truncation.HEAD_STEP])
        (_, whole_heads), (_, own_heads) = truncation.signatures(pa.array([text, head]))
        assert len(whole_heads) == 4 and len(own_heads) == 2 and all((a == b).all() for a, b in zip(own_heads, whole_heads, strict=False))
        assert truncation.signatures(pa.array([None, "", "a b c"])) == [(pytest.approx([]), [])] * 3 or len(truncation.signatures(pa.array([None, "", "a b c"]))[2][0]) == 0


def test_hashed_words():
    a, bounds, starts, number = hashed_words(pa.array(["Điện Lực 12", "dien luc 12", None, "", "x" * 5000, "e\u0323n"]))
    assert bounds.tolist() == [0, 3, 6, 6, 6, 7, 8] and (a[:3] == a[3:6]).all() and number.tolist()[:3] == [False, False, True] and starts[:3].tolist() == [0, 5, 9]
    assert len(np.unique(a)) == 5
