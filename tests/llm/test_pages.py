from pyspark.sql import functions as F

from paragrid.llm import lines, mainbody, mojibake, scans


def test_repeated_lines(spark):
    blocks = [(f"d{n}", f"d{n}:0", "paragraph", f"본문 {chr(0xAC00 + n * 30)}{chr(0xAC00 + n * 77)} 이다\n 조회수 {n}\n12\n") for n in range(8)]
    blocks += [("e0", "e0:0", "paragraph", "조회수 5"), ("d0", "d0:9", "table_cell", "조회수 1"), ("d1", "d1:5", "paragraph", None), ("d0", "d0:0", *blocks[0][2:])]
    df = spark.createDataFrame(blocks, "document_id string, block_id string, block_type string, text string")
    chunks = spark.createDataFrame([(f"d{n}", "Host" if n % 2 else None) for n in range(8)] + [(f"d{n}", "HOST") for n in range(8)] + [("e0", "other")], "document_id string, source_host string")
    found = lines.found_lines(df, chunks)
    assert {tuple(r) for r in found.collect()} == {(f"d{n}:0", 1) for n in range(8)}
    cleaned = {r.block_id: r.text for r in lines.without_lines(df, found).collect()}
    assert cleaned["d0:0"].split("\n")[1:] == ["12", ""] and cleaned["d1:5"] is None and cleaned["e0:0"] == "조회수 5"
    assert lines.found_lines(df.limit(0), chunks).count() == 0 and lines.found_lines(df, chunks.limit(0)).count() == 0


def test_a_rare_line_goes_by_the_ratio_alone(spark):
    own = [(f"d{n}", f"d{n}:0", "paragraph", f"본문 {chr(0xAC00 + n)}이다" + ("\n쿠키를 저장합니다." if n < 20 else "")) for n in range(200)]
    other = [(f"e{n}", f"e{n}:0", "paragraph", f"글 {chr(0xB000 + n)}이다" + ("\n모두의 줄" if n % 2 else "")) for n in range(400)]
    df = spark.createDataFrame(own + other, "document_id string, block_id string, block_type string, text string")
    chunks = spark.createDataFrame([(r[0], r[0][0]) for r in own + other], "document_id string, source_host string")
    assert lines.found_lines(df, chunks).where("block_id like 'd%'").count() == 0
    cleaned = {r.block_id: r.text for r in lines.without_lines(df, lines.excess_lines(df, chunks)).collect()}
    assert cleaned["d3:0"] == own[3][3].split("\n")[0] and cleaned["e1:0"] == other[1][3].split("\n")[0] and len(cleaned) == 600
    # A line that all hosts have is in excess by its share alone; the two lines of one host each are by the ratio.
    common = df.withColumn("text", F.concat("text", F.lit("\n어디나 있는 줄"))).where("document_id <> 'd1'")
    excess = lines.repeated_lines(lines.lines_of(common), lines.hosts_of(chunks))
    mark = lambda text: spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert {r["mark"] for r in excess.where("log10_q <= -2").collect()} == {mark("쿠키를 저장합니다."), mark("모두의 줄")}
    assert excess.where(F.col("mark") == mark("어디나 있는 줄")).count() == 2


def test_main_body(spark):
    rows = []
    for n in range(12):
        rows += [(f"p{n}", f"p{n}:0", "list_item", [], f"홈 > 소식 > 글{n} 게시판"), (f"p{n}", f"p{n}:1", "heading", [], f"제목 {n}")]
        rows += [(f"p{n}", f"p{n}:{2 + k}", "paragraph", ["장"] if k else None, f"신청은 {n}월 {k}일까지 받습니다. 서류는 따로 냅니다.") for k in range(3)]
        rows += [(f"p{n}", f"p{n}:9", "paragraph", None, f"쿠키를 저장합니다.\n모두 허용\n필수만 허용 {n}"), (f"p{n}", f"p{n}:8", "paragraph", [], None)]
    df = spark.createDataFrame(rows + rows[:2], "document_id string, block_id string, block_type string, section_path array<string>, text string")
    pages = df.select("document_id").distinct()
    hosts = pages.selectExpr("document_id", "'h' AS host").where("document_id <> 'p3'")
    got = {r.block_id for r in mainbody.judged(df, pages, hosts).where("not body").collect()}
    assert got == {f"p{n}:{k}" for n in range(12) for k in (0, 9)}
    assert mainbody.judged(df.limit(0), pages, hosts).count() == 0


def _language():
    counts = {"학생은": 50, "학기": 40, "신청할": 30, "있습니다": 60, "수": 80, "서류를": 20, "제출하여야": 25, "합니다": 70, "건강검진": 15, "다시": 10}
    return mojibake.Language(counts)


def test_restores_text():
    language, text = _language(), "학생은 다시 서류를 제출하여야 합니다"
    for wrong in (
        text.encode().decode("latin-1"), text.encode("euc-kr").decode("latin-1"), text.encode().decode("cp949", "replace"), text.encode().decode("gbk", "replace"),
        text.encode().decode("latin-1").encode().decode("latin-1"),
    ):
        restored, damaged = mojibake.restore(wrong, language)
        assert damaged and restored == text, restored


def test_long_spans_are_restored_whole():
    language = _language()
    for wrong in (("학생은" * 200).encode().decode("latin-1"), ("학생은" * 200).encode("euc-kr").decode("latin-1"), ("학생은" * 200).encode().decode("gbk", "replace")):
        restored, damaged = mojibake.restore(wrong, language)
        assert damaged and restored == "학생은" * 200


def test_lost_bytes_are_found_by_words_and_pairs():
    language = _language()
    for text, wrong in (("건강검진", "latin-1"), ("제출하여야", "latin-1"), ("있습니다", "latin-1")):
        raw = list(text.encode().decode(wrong))
        for lost in ((1,), (0, 1, 2), (2, 4, 8)):
            shown = "".join(mojibake.LOST if n in lost else c for n, c in enumerate(raw))
            assert mojibake.restore(shown, language) == (text, True), (text, lost)
    assert mojibake.restore("학생은 합격자는".encode("euc-kr").decode("utf-8", "replace"), mojibake.Language({"학생은": 5, "합격자는": 9}))[0].endswith("합격자는")


def test_question_marks_that_follow_no_word_are_damage():
    language = _language()
    assert mojibake.restore("?? ??? 1?? ????", language) == ("?? ??? 1?? ????", True)
    for text in ("정말요?? 네!!", "why?", "(가)?? 나"):
        assert mojibake.restore(text, language) == (text, False)


def test_lattice_search_equals_all_readings():
    language = mojibake.Language({"가나": 5, "나다": 3, "다": 2, "가다나": 1})
    raw = [*"가나다".encode("cp949")]
    for lost in ((0,), (3,), (0, 1), (1, 2), (4, 5)):
        seen = [None if n in lost else b for n, b in enumerate(raw)]
        score, read = mojibake.viterbi(seen, "cp949", language)
        fits = [t for t in (a + b + c for a in "가나다" for b in "가나다" for c in "가나다") if all(x in (None, y) for x, y in zip(seen, t.encode("cp949")))]
        assert max(language.score(t) for t in fits) <= score + 1e-9 and read in fits


def test_sound_text_stays():
    language = _language()
    for text in ("年度 및 論文에 관한 café, naïve, Übung", "온도 20°C · 100±5", " 학생은", "can’t – “ok”", "", "ⓒ 2024"):
        assert mojibake.restore(text, language) == (text, False)


def test_restored_blocks(spark):
    rows = [("a", "café"), ("b", "학생은".encode().decode("latin-1")), ("b", "학생은".encode().decode("latin-1")), ("c", None), ("d", ""), ("e", "��")]
    df = spark.createDataFrame(rows, "block_id string, text string")
    got = {r.block_id: (r.restored, r.complete) for r in mojibake.restored_blocks(df, {"학생은": 9, "서류를": 3}).collect()}
    assert got == {"b": ("학생은", True), "e": ("��", False)}
    assert mojibake.restored_blocks(df.limit(0), {}).count() == 0


def test_numbers_and_lines():
    assert scans.misread_numbers("2O26년 l3:50 제4l조 AC-2OZ6-0743 HANIS-212건 POPE-X B동 e-Class") == "2026년 13:50 제41조 AC-2026-0743 HANIS-212건 POPE-X B동 e-Class"
    text = "신청은 영문-\n지원센터에서\n— 12 —\n받습니다."
    assert scans.repair(text, set(), "", {}, {}, None) == ("신청은 영문지원센터에서 받습니다.", True)
    assert scans.repair("1) 가나\n2) 다라", set(), "", {}, {}, None) == ("1) 가나\n2) 다라", False)
    assert scans.repair("요람 12", {"요람"}, "", {}, {}, None) == ("", True)
    assert scans.repair("", set(), "", {}, {}, None) == ("", False)


def test_line_pairs_learn_cuts():
    texts = ["학생은 신청서를 제출하여야 합니다 그리고 담당자가 확인하여 통보합니다 " * 6] * 40
    counts = {w: 500 for w in texts[0].split()}
    model = scans.train_pairs(texts, counts)
    ask = lambda a, b: model.predict(__import__("numpy").array([scans.pair_features(a, b, counts)]))[0]
    assert ask("학생은 신청", "서를") > 0.5 > ask("학생은", "신청서를")


def test_line_pairs_of_all_blocks_are_judged_at_once():
    """p3_found: the classifier ran once for each block, which cost most of its time."""

    class Judge:
        calls = 0

        def predict(self, features):
            self.calls += 1
            return features[:, 7] / 10  # the length of the left part

    texts = ["가나다라마바사\n아자", "가\n나", "한 줄", "", "가나다라마바\n아자\n차카", "가나다라마바사-\n아자"]
    blocks = [(text, set(), "", {}, {}, False, scan) for text in texts for scan in (True, False)]
    each = [scans.repair(*b[:5], Judge(), *b[5:]) for b in blocks]
    assert scans.repair_all(blocks, judge := Judge()) == each and judge.calls == 1
    assert each[0] == ("가나다라마바사아자", True) and each[1] == (texts[0], False) and each[8] == ("가나다라마바아자 차카", True)
    assert scans.repair_all([], None) == []


def test_words_beside_line_ends(spark):
    texts = ["학생은 신청-\n서를 낸다", "가나 -\n 다라\n\n마바", "한 줄 Abc1 de", "끝\n", "\n처음", "a--\nb c\nd", "하나\n둘\n셋", None]
    df = spark.createDataFrame([("paragraph", "cascade/ocr", t) for t in texts], "block_type string, parser string, text string")
    got = {r.word: (r.sound, r.noisy, r.edge) for r in scans.words(df).collect()}
    inner = dict.fromkeys(["학생은", "낸다", "가나", "한", "줄", "de", "a"], (0, 1, 0))
    assert got == inner | dict.fromkeys(["신청", "서를", "다라", "마바", "끝", "처음", "b", "c", "d", "하나", "둘", "셋"], (0, 0, 1))


def test_scanned_blocks(spark):
    good = "학생은 신청서를 제출하여야 합니다. 담당자가 확인하여 통보합니다. "
    rows = [(f"s{n}", f"s{n}:{k}", "paragraph", "cascade/OCR-korean", good + f"학생온 신청서를 {k}월") for n in range(6) for k in range(4)]
    rows += [(f"s{n}", f"s{n}:h{k}", "paragraph", "cascade/ocr-korean", f"업무편람 {k}") for n in range(6) for k in range(3)]
    rows += [(f"h{n}", f"h{n}:{k}", "paragraph", "native/html", good * 3) for n in range(10) for k in range(4)]
    rows += [("s0", "s0:x", "paragraph", "cascade/ocr-korean", None), ("s0", "s0:t", "table_cell", "cascade/ocr-korean", "12"), rows[0]]
    df = spark.createDataFrame(rows, "document_id string, block_id string, block_type string, parser string, text string")
    titles = spark.createDataFrame([("s0", None), ("s1", "안내")], "document_id string, source_title string")
    got = {r.block_id: r.text for r in scans.repaired_blocks(df, titles).collect()}
    assert {k for k in got if "h" in k} == {f"s{n}:h{k}" for n in range(6) for k in range(3)} and got["s0:h1"] == ""
    assert not any(k.startswith("h") for k in got) and "s0:t" not in got
    assert scans.repaired_blocks(df.limit(0), titles).count() == 0


def test_one_mark_is_enough(spark):
    good = "학생은 신청서를 제출하여야 합니다. 담당자가 확인하여 통보합니다. "
    rows = [(f"h{n}", f"h{n}:{k}", "paragraph", "native/html", good * 3) for n in range(10) for k in range(4)]
    rows += [("p", f"p:{k}", "paragraph", "native/pdf-text", good) for k in range(3)] + [("p", "p:9", "paragraph", "native/pdf-text", "번호는 TL-9884\n- 216 -\n문서에 따라 정합니다.")]
    rows += [("q", "q:0", "paragraph", "native/pdf-text", "신청은 영문-\n지원센터에서 받습니다."), ("q", "q:1", "paragraph", "native/pdf-text", good)]
    df = spark.createDataFrame(rows, "document_id string, block_id string, block_type string, parser string, text string")
    titles = spark.createDataFrame([("p", "안내")], "document_id string, source_title string")
    got = {r.block_id: r.text for r in scans.repaired_blocks(df, titles).collect()}
    assert got == {"p:9": "번호는 TL-9884 문서에 따라 정합니다.", "q:0": "신청은 영문지원센터에서 받습니다."}


def test_rare_words_count_as_frequent_ones(spark, monkeypatch):
    """words beyond the line classifier's table have their counts too."""
    from paragrid.llm import queries

    whole = sorted(map(tuple, queries.queries()["p3_repaired"](spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(scans, "VOCABULARY", 50)
    assert sorted(map(tuple, queries.queries()["p3_repaired"](spark, "/root/testdata/sf0.01").collect())) == whole
