from hypothesis import given, settings
from hypothesis import strategies as st

from paragrid.llm import pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="가나 .\n", min_size=0, max_size=900))
def test_cut_covers_the_text_within_the_limit(text):
    spans = pieces.cut(text, 100, 20)
    assert all(e - b <= 100 for b, e in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b2 <= e1 and b1 < b2 and e1 <= e2 for (b1, e1), (b2, e2) in zip(spans, spans[1:]))


def test_long_text_without_any_break():
    spans = pieces.cut("가" * 10_000)
    assert max(e - b for b, e in spans) <= 1800
    assert all(e1 - b2 == 250 for (_, e1), (b2, _) in zip(spans, spans[1:]))


def test_cuts_fall_on_sentences():
    text = " ".join(f"문장 {n}은 여기에서 끝납니다." for n in range(400))
    spans = pieces.cut(text)
    assert all(text[:e].rstrip().endswith(".") for _, e in spans)
    assert all(200 <= e1 - b2 <= 300 for (_, e1), (b2, _) in zip(spans, spans[1:]))


def test_split_items(spark):
    rows = [("a", ["s"], "가 " * 1000, 1), ("a", ["s"], "가 " * 1000, 1), ("b", None, "x" * 1801, 2), ("c", [], "x" * 1800, 3), ("d", [], None, 4)]
    df = spark.createDataFrame(rows, "item string, section_path array<string>, text string, piece_no int")
    got = pieces.split_items(df, "item", "text", "section_path").collect()
    assert {r.item_id for r in got} == {"a", "b"}
    assert all(len(r.text) == r.char_count <= 1800 for r in got)
    assert {tuple(r.section_path) if r.section_path is not None else None for r in got} == {("s",), None}
    assert sum(r.item_id == "a" and r.piece_no == 0 for r in got) == 1
    assert pieces.split_items(df.limit(0), "item", "text", "section_path").count() == 0
