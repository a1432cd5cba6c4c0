import unicodedata
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paragrid.llm import unify


@pytest.mark.parametrize(
    "a, b",
    [
        ("２０２６년 ＡＢ", "2026년 AB"), ("한글", "한글"), ("가​나", "가나"), ("a b", "a b"),
        ("СОВ", "COB"), ("naїve", "naïve"), ("吏", "吏"), ("HN‑2024", "HN-2024"), ("가・나", "가·나"), ("é", "é"),
    ],
)
def test_same_on_the_page(a, b):
    assert unify.appearance(a) == unify.appearance(b)
    assert unify.consistent(a) == unify.consistent(b)


@pytest.mark.parametrize("a, b", [("a b", "a  b"), ("AB", "ab"), ("x²", "x2"), ("①", "1"), ("-", "—"), ("1", "2")])
def test_different_on_the_page(a, b):
    assert unify.appearance(a) != unify.appearance(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_forms_are_stable(text):
    assert unify.appearance(unify.appearance(text)) == unify.appearance(text)
    assert unify.consistent(unify.consistent(text)) == unify.consistent(text)


def test_pairs_keep_every_copy(spark):
    rows = [("a", "２점", 1), ("b", "2점", 2), ("c", "2점", 3), ("c", "2점", 3), ("d", None, 4), (None, "2점", 5), ("e", "", 6), ("f", "​", 7)]
    df = spark.createDataFrame(rows, "key string, text string, form int")
    got = {tuple(r) for r in unify.look_alike_pairs(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("e", "f")}
    assert unify.look_alike_pairs(df.limit(0)).count() == 0


def test_unify_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "Ａ"), (1, "Ａ"), (2, None), (3, "")], "unified int, text string")
    got = sorted(map(tuple, unify.unify(df.withColumnRenamed("unified", "id")).collect()), key=str)
    assert got == [(1, "Ａ", "a"), (1, "Ａ", "a"), (2, None, None), (3, "", "")]
    assert unify.unify(df).columns == ["text", "unified"]


def test_equal_appearance_has_one_form(spark):
    form_of = {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        look, form = unify.appearance(chr(code)), unify.consistent(chr(code))
        assert form_of.setdefault(look, form) == form == unify.consistent(look), hex(code)
    rows = [("a", "가\u318d나"), ("b", "가\u00b7나"), ("c", "\u03f2at"), ("d", "cat")]
    df = spark.createDataFrame(rows, "key string, text string")
    assert {tuple(r) for r in unify.look_alike_pairs(df).collect()} == {("a", "b"), ("c", "d")}


def test_the_form_is_blind_to_case_and_idempotent():
    assert unify.consistent("МОСКВА") == unify.consistent("москва") == "mockba"
    assert unify.consistent("ΝΟΤΕ") == unify.consistent("NOTE") == "note" and unify.consistent("ΑΒΓ") == unify.consistent("αβγ")
    assert unify.consistent("5 µm") != unify.consistent("5 mm")
    for code in (*range(0x370, 0x590), *range(0x1C80, 0x1C8A)):
        c = chr(code)
        if not any(f in unify.OWN_LOOK for f in (c.casefold(), unicodedata.normalize("NFKC", c).casefold())):
            assert unify.consistent(c) == unify.consistent(c.upper()) == unify.consistent(c.lower()), c
    for code in range(0x20, 0x30000):
        if not 0xD800 <= code < 0xE000:
            once = unify.consistent(f"a{chr(code)}b")
            assert unify.consistent(once) == once, hex(code)
    assert unify.consistent("a\tb\rc\x85d\u3000e\nf") == "a b c d e\nf"
