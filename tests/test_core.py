import datetime
import io
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paragrid.functions import ids, text, urls
from paragrid.operators import chunking, curation, evaluation, index, retrieval
from paragrid.sources import parsing, sinks


def values(spark, column, *rows):
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, v string")
    return [r.x for r in df.select("n", column(F.col("v")).alias("x")).orderBy("n").collect()]


def test_terms(spark):
    assert values(spark, text.terms, "GPA 학생증 a 7 12개", "", None) == [["gpa", "학생증", "7", "12"], [], None]
    assert values(spark, text.search_terms, "학생증 학교") == [["학생증", "학생", "생증", "학교", "학교"]]
    ordered, bag = values(spark, text.search_terms, "가 나다 라마바x1")[0], values(spark, text.term_bag, "가 나다 라마바x1")[0]
    assert sorted(ordered) == sorted(bag)
    assert values(spark, text.stems, "학생은 학교에서 나는") == [["학생", "학교", "나는"]]


def test_text_forms(spark):
    assert values(spark, text.fold_space, "  가 　나\n", "", None) == ["가 나", "", None]
    assert values(spark, text.clean, "a\r\nb\x07c  d\n\n\n\n\ne ") == ["a\nb c d\n\n\ne"]
    assert values(spark, text.nfkc_casefold, "ＡStraße", None) == ["astrasse", None]
    assert values(spark, text.numbers, "1,234.5원 7") == [["1234.5", "7"]]
    assert values(spark, text.sentences, "하나입니다. 2024. 5. 1.까지.\n둘") == [["하나입니다.", "2024. 5. 1.까지.", "둘"]]
    assert values(spark, text.critical_values, "5월 3일 10:00 50명") == [["day:5월3일", "quantity:3일", "quantity:50명", "time:10:00"]]


def test_urls_and_ids(spark):
    got = values(spark, urls.canonical, "HTTP://A.example:80/x/?utm_source=1&b=2&a=1#f", "https://a.example", "ftp://a", None, "https://a.example:8443/y?")
    assert got == ["http://a.example/x?a=1&b=2", "https://a.example", None, None, "https://a.example:8443/y"]
    assert spark.range(1).select(ids.block_id(F.lit("d"), F.lit(7))).first()[0] == "d:b000007"
    assert values(spark, lambda c: urls.within(c, F.lit("b.kr")), "a.b.kr", "B.kr", "ab.kr") == [True, True, False]


def test_bm25_ties_and_empty(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "학교 안내"), (2, "학교 안내"), (3, "공지"), (4, None), (5, "")], "doc int, body string")
    made = lambda rows, name: index.build(rows, "doc", F.col("body"), str(tmp_path / name))
    assert made(docs, "i") and not made(docs, "i")
    own = index.load(spark, str(tmp_path / "i"))
    assert set(index.verify(own).first()) == {0} and own.documents == 3
    for rows in (docs.union(docs), docs.where("doc > 3")):
        with pytest.raises(ValueError):
            made(rows, "bad")
        with pytest.raises(FileNotFoundError):
            index.load(spark, str(tmp_path / "bad"))
    asked = retrieval.query_terms(spark.createDataFrame([(9, "학교"), (8, "")], "query int, q string"), "query", F.col("q"))
    for most, rows in ((index.BROADCAST_ASKED, index.TERM_ROWS), (0, 1)):  # both plans
        monkeypatch.setattr(index, "BROADCAST_ASKED", most)
        monkeypatch.setattr(index, "TERM_ROWS", rows)
        found = retrieval.top(index.bm25(own, asked, "query"), "query", "doc", 5).collect()
        assert [(r.query, r.doc, r.rank) for r in sorted(found, key=lambda r: r.rank)] == [(9, 1, 1), (9, 2, 2)]
        for cells in (index.CELLS, 1):
            monkeypatch.setattr(index, "CELLS", cells)
            assert [(r.query, r.doc, r.rank) for r in index.best(own, asked, "query", 1).collect()] == [(9, 1, 1)]
        assert index.best(own, asked.where("query = 8"), "query", 1).count() == 0


@pytest.mark.parametrize("most, cells, block", [(10**6, 10**6, 2_048), (40, 50, 7), (0, 1, 1)])
def test_best_of_any_number_of_questions_joins_no_postings(spark, tmp_path, monkeypatch, most, cells, block):
    import random

    random.seed(5)
    words = [a + b for a in "가나다라마" for b in "바사아자"]
    docs = spark.createDataFrame([(f"d{n % 7}-{n}", " ".join(random.choices(words, k=random.randint(0, 9)))) for n in range(90)], "doc string, body string")
    index.build(docs, "doc", F.col("body"), str(tmp_path / "i"))
    own = index.load(spark, str(tmp_path / "i"))
    asked = retrieval.query_terms(spark.createDataFrame([(n, " ".join(random.choices(words, k=3))) for n in range(6)], "query int, q string"), "query", F.col("q"))
    rows = lambda df: sorted((r.query, r.rank, r.doc, r.score) for r in df.collect())
    wanted = rows(retrieval.top(index.bm25(own, asked, "query"), "query", "doc", 4))
    for name, value in (("BROADCAST_ASKED", most), ("CELLS", cells), ("DOCUMENT_BLOCK", block), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(index, name, value)
    found = index.best(own, asked, "query", 4)
    assert rows(found) == wanted
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, k string, rank int")
    fused = retrieval.fused_order(retrieval.fuse({"a": a, "b": b}, "q", "k"), "q", "k").orderBy("rank").collect()
    assert [r.k for r in fused] == ["y", "x", "z"] and fused[0].lanes == 2
    rows = spark.createDataFrame([(1, n, g, n) for n, g in enumerate("aaab", 1)] + [(1, 5, None, 5), (1, 6, None, 6), (1, 7, None, 7)], "q int, k int, g string, rank int")
    assert [r.k for r in retrieval.diverse(rows, "q", "g", 9).orderBy("rank").collect()] == [1, 2, 4, 5, 6, 7]
    assert [r.k for r in retrieval.diverse(rows, "q", "g", 9, backfill=True).orderBy("rank").collect()] == [1, 2, 4, 5, 6, 7, 3]


def test_dense_equals_brute_force(spark):
    import random

    random.seed(1)
    rows = [(n, [random.random() - 0.5 for _ in range(8)]) for n in range(60)] + [(99, None), (98, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.dense_top(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 3).collect()}
    unit = {k: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] for k, v in rows if v}
    for q in (0, 20, 40):
        best = sorted((k for k in unit if k != q), key=lambda k: (-round(sum(a * b for a, b in zip(unit[q], unit[k])), 6), k))[:3]
        assert [got[q, n] for n in (1, 2, 3)] == best


def test_dense_exchanges_no_vectors(spark, monkeypatch):
    rows = [(n, [float((n * 7 + i * 3) % 11 - 5) for i in range(4)]) for n in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lambda: retrieval.dense_top(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", 3)
    values = lambda d: sorted(map(tuple, d.select("query_id", "rank", "vec_id", "score").collect()))
    whole = values(found())
    assert len(whole) == 30
    monkeypatch.setattr(retrieval, "SENT", 8)  # several passes
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    assert values(found()) == whole
    plan = found()._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_dense_rows_exchange_no_terms(spark):
    rows = spark.createDataFrame([(1, "가나 다라 가나 ab"), (2, "1"), (3, ""), (4, None)], "k int, v string")
    held = {}
    for r in retrieval.hashed_vector(rows.select("k", text.terms(F.col("v")).alias("t")), "k", "t").collect():
        held.setdefault(r.k, {})[r.dim] = r.weight
    found = retrieval.dense_rows(rows, "k", text.terms(F.col("v")))
    got = {r.k: {n: round(x, 6) for n, x in enumerate(r.vector) if x} for r in found.collect()}
    assert got == held and set(got) == {1, 2}
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_curation(spark):
    rows = spark.createDataFrame([("a", "g", 1), ("b", "g", 2), ("c", None, 3), ("d", None, 4), ("a", "g", 1)], "id string, g string, t int").distinct()
    got = {r.id: r.duplicate_of for r in curation.duplicates(rows, F.col("g"), F.col("t"), winner="id").collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None}
    budget = spark.createDataFrame([(1, n, s) for n, s in enumerate((5, 4, 3, 9))], "g int, n int, s int")
    assert [(r.n, r.taken) for r in curation.budget_prefix(budget, "g", F.col("s"), 10, F.col("n")).orderBy("n").collect()] == [(0, 5), (1, 4), (2, 1)]


def test_packing_of_blocks(spark):
    rows = [("d", f"d:{n}", k, t, n, 1, ["s"] if n < 3 else []) for n, (k, t) in enumerate([("heading", "제목"), ("paragraph", "가" * 1000), ("paragraph", "나" * 900), ("paragraph", "다" * 4000), ("table", "머리\n" + "행 하나\n" * 600), ("table_cell", "x"), ("paragraph", None)])]
    df = spark.createDataFrame(rows + rows[:1], "document_id string, block_id string, block_type string, text string, reading_order int, page int, section_path array<string>")
    got = sorted(chunking.pack_blocks(df).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in got] == list(range(len(got))) and max(r.char_count for r in got) <= 1800
    assert got[0].text == "제목\n\n" + "가" * 1000 and got[1].text == "나" * 900
    assert all(r.text.startswith("머리\n") for r in got if r.block_ids == ["d:4"])
    assert chunking.pack_blocks(df.limit(0)).count() == 0


def test_statistics(spark):
    one = spark.createDataFrame([(1, 5, 0), (2, 0, 0), (3, 3, 3)], "k int, a int, b int")
    p = {r.k: r.p for r in one.select("k", evaluation.exact_mcnemar(F.col("a"), F.col("b")).alias("p")).collect()}
    assert p == {1: 0.0625, 2: 1.0, 3: 1.0}
    holm = evaluation.holm(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double"), "p").orderBy("p").collect()
    assert [round(r.p_holm, 6) for r in holm] == [0.03, 0.06, 0.06]
    flips = evaluation.sign_flip(spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0), ("g", 0.0)], "g string, d double"), "g", "d").first()
    assert (flips.n, flips.p) == (3, 0.25)
    labels = spark.createDataFrame([(1, 1), (0, 0), (1, 1), (None, 1)], "a int, b int")
    assert evaluation.kappa(labels, F.col("a"), F.col("b")).first().kappa == 1.0
    assert evaluation.kappa(labels.where("a = 1"), F.col("a"), F.col("b")).first().kappa is None
    mode = evaluation.unique_mode(spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "x")], "g string, v string"), "g", "v")
    assert {r.g: r["mode"] for r in mode.collect()} == {"g": None, "h": "x"}


def test_tests_hold_at_any_size(spark):
    pairs = spark.createDataFrame([(600, 600), (745, 749), (0, 2000), (100_000, 99_000)], "a int, b int")
    p = {r.a: r.p for r in pairs.select("a", evaluation.exact_mcnemar(F.col("a"), F.col("b")).alias("p")).collect()}
    assert p[600] == 1.0 and abs(p[745] - 0.938) < 2e-3 and 0 <= p[0] < 1e-300 and abs(p[100_000] - 0.0250) < 1e-3
    some = [float(v) for v in range(-5, 16) if v]
    deltas = spark.createDataFrame([("few", v) for v in some] + [("many", v) for v in some for _ in range(2)] + [("none", 0.0), ("none", None)], "g string, d double")
    got = {r.g: (r.n, r.p) for r in evaluation.sign_flip(deltas, "g", "d").collect()}
    assert got["few"][0] == 20 and got["many"][0] == 40 and got["none"] == (0, 1.0) and got["many"][1] < got["few"][1]
    drawn = {r.g: r.p for r in evaluation.sign_flip(deltas, "g", "d", most=10).collect()}
    assert abs(drawn["few"] - got["few"][1]) < 0.01
    three = spark.createDataFrame([(0, 0)] * 3 + [(1, 2)] * 2 + [(2, 1), (2, 2), (1, 1)], "a int, b int")
    assert evaluation.kappa(three, F.col("a"), F.col("b"), "quadratic", 3).first().kappa == 0.727273
    assert evaluation.kappa(three.where("a > 5"), F.col("a"), F.col("b")).first().n == 0


def test_html_and_others(spark):
    html = "<html><head><title>제목</title><style>x</style></head><body><h2>장</h2><p>본문 <b>굵게</b></p><ul><li>하나</li></ul><table><tr><th>a</th><td>b</td></tr></table></body></html>"
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("word/document.xml", '<d xmlns:w="w"><w:body><w:p><w:r><w:t>단락</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>칸</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></d>')
    rows = spark.createDataFrame([("h", bytearray(html.encode())), ("k", bytearray(html.encode("cp949"))), ("n", None)], "document_id string, content binary")
    got = [(r.block_type, r.text, r.section_path) for r in parsing.parse(rows, "native/html").where("document_id = 'h'").orderBy("reading_order").collect()]
    assert got[:4] == [("heading", "제목", ["제목"]), ("heading", "장", ["제목", "장"]), ("paragraph", "본문 굵게", ["제목", "장"]), ("list_item", "하나", ["제목", "장"])]
    assert [g[:2] for g in got[4:]] == [("table", "a\tb"), ("table_cell", "a"), ("table_cell", "b")]
    assert parsing.parse(rows, "native/html").where("document_id = 'k'").count() == len(got)
    office = spark.createDataFrame([("o", bytearray(archive.getvalue())), ("bad", bytearray(b"PK\x03\x04zzz"))], "document_id string, content binary")
    assert [r.text for r in parsing.parse(office, "native/office").orderBy("reading_order").collect()] == ["단락", "칸", "칸"]
    assert [r[0] for r in office.select(parsing.sniff(F.col("content"))).collect()] == ["zip", "zip"]
    kinds = [b[0] for b in parsing.markdown_blocks("# A\n\ntext\nmore\n- x\n|a|b|\n|-|-|\n|1|2|\n".encode())]
    assert kinds == ["heading", "paragraph", "list_item", "table", *["table_cell"] * 4]


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(2, "=1"), (1, None)], "b int, a string")
    for _ in range(2):
        sinks.publish(df, str(tmp_path / "t"))
        sinks.publish_json_lines(df, str(tmp_path / "j"), "b")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"=1","b":2}', '{"a":null,"b":1}']
    with pytest.raises(Exception):
        spark.createDataFrame([("not json",)], "v string").write.text(str(tmp_path / "bad"))
        parsing.strict_json_lines(spark, str(tmp_path / "bad"), "a int").collect()


def test_streams_equal_tables(spark, tmp_path):
    from paragrid.streaming import state

    base = datetime.datetime(2024, 1, 1)
    rows = [(n, base + datetime.timedelta(minutes=7 * n), n % 3, "click" if n % 2 else "view", float(n)) for n in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    stream = state.stream_of(spark, str(tmp_path), "events", df.schema)
    want = {(r.start, r.event_type): r.n for r in state.windowed_counts(df, "ts", "1 hour", "event_type").collect()}
    state.run_available(state.windowed_counts(stream, "ts", "1 hour", "event_type", late="0 seconds"), str(tmp_path / "out"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # the windows that the watermark has closed
    totals = state.running_totals(state.stream_of(spark, str(tmp_path), "events", df.schema), "user_id")
    query = totals.writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.user_id: r.total for r in spark.sql("SELECT user_id, max(total) AS total FROM totals GROUP BY 1").collect()} == {k: sum(r[4] for r in rows if r[2] == k) for k in range(3)}


def test_registry(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 60


def test_pieces_exchange_repeated_keys_only(spark, tmp_path, monkeypatch):
    """a chunk that stands once stays where it is read; of repeated ones each column's least value counts."""
    from paragrid.plans import context as plans

    rows = spark.createDataFrame([("a", "z", 3), ("a", "y", None), ("b", None, 1), (None, "n", 1), (None, "m", 2), ("c", "only", None)], "chunk_id string, text string, chunk_index int")
    for name in ("document_id", "section_path_json", "institution", "file_name", "relative_path", "file_extension", "source_title", "source_host", "category"):
        rows = rows.withColumn(name, F.lit(name))
    rows.write.parquet(f"{tmp_path}/chunks.parquet")
    for most in (curation.REPEATED, 0):  # both plans
        monkeypatch.setattr(curation, "REPEATED", most)
        pieces = plans._pieces(spark, str(tmp_path))
        found = {(r.chunk_id, r.text, r.chunk_index) for r in pieces.collect()}
        assert pieces.count() == 4 and found == {("a", "y", 3), ("b", None, 1), (None, "m", 1), ("c", "only", None)}
        assert ("LeftAnti" in pieces._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)


def test_best_travel_packed(spark, tmp_path, monkeypatch):
    """tasks exchange packed blocks of their best documents, no row for each; ranks are those of all tasks."""
    docs = spark.createDataFrame([(f"d{n:02}", "학교 " + "안내 " * (n % 3)) for n in range(40)], "doc string, body string").repartition(5)
    index.build(docs, "doc", F.col("body"), str(tmp_path / "i"))
    own = index.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(q, t) for q in "abc" for t in ("학교", "안내")], "query string, term string")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    want = index.bm25(own, asked, "query").withColumn("rank", order).where("rank <= 7").select("query", "doc", "score", "rank").collect()
    for size in (index.QUERY_BLOCK, 2):
        monkeypatch.setattr(index, "QUERY_BLOCK", size)
        found = index.best(own, asked, "query", 7)
        assert sorted(found.collect()) == sorted(want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "FlatMapGroupsInArrow" in plan


def test_wanted_titles_come_by_wording(spark):
    """what a claim's title may be is made per wording, pairs of claim and chunk are not exchanged."""
    from paragrid.plans import context as plans

    found = plans.title_hits(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(titled" in plan and found.count() == 19


def test_searches_of_documents_exchange_no_postings(spark, tmp_path):
    """F4 and the other searches of 1 GB: postings went through an exchange when the index was built and searched."""
    from paragrid import catalog

    (tmp_path / "documents.parquet").symlink_to("/root/testdata/sf0.01/documents.parquet")  # a path of its own, so the index is built here
    context, none = spark.sparkContext, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(stages.apply(n).stageId(), stages.apply(n).attemptId()): stages.apply(n).shuffleWriteRecords() for n in range(stages.size())}

    queries, postings = catalog.queries(), None
    for name in (
        "ends_first_order", "document_diverse", "document_diverse_backfill", "stable_demotion", "rrf_fusion", "lane_report",
        "anchor_protection", "fallback_slots", "fallback_rerank", "hit_at_k", "category_precision",
    ):
        before = written()
        assert queries[name](spark, str(tmp_path)).collect()
        moved = sum(n for stage, n in written().items() if stage not in before)
        postings = postings or queries["index_stats"](spark, str(tmp_path)).first()["postings"]
        assert moved * 2 < postings, (name, moved, postings)
