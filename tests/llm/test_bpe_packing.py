import os

import pytest

from paragrid.llm import bpe, packing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary file")
TEXTS = [
    "", None, " ", "  a  b ", "don't  CAN'T", "한국어 문장입니다.\n\n다음 줄", "a" * 999, "가" * 500, "\x1c z\t y \x85k", "🙂🙂 emoji", "<|endoftext|>",
    "x 　y", "1234567 89", "HN-2025-1696이며", " ", "\n", "é", "word" * 80 + " tail",
]


@needs_vocabulary
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.TOKENIZER)
    reference.encode_special_tokens = True
    ids, sizes = bpe.Encoder(bpe.TOKENIZER).encode(TEXTS)
    at = 0
    for text, size in zip(TEXTS, sizes):
        assert ids[at : at + size].tolist() == reference.encode(text or "", add_special_tokens=False).ids, text
        at += size


@needs_vocabulary
def test_encode_rows(spark):
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)] + [(0, "", "x")], "doc_id long, text string, ids string")
    got = bpe.encode(df).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.ids == [] for r in got if r.doc_id in (0, 1))
    counts = {r.doc_id: r.tokens for r in bpe.count_tokens(df).collect()}
    assert all(len(r.ids) == counts[r.doc_id] for r in got)
    assert bpe.encode(df.limit(0)).count() == 0


def test_packing_is_whole_and_tight(spark):
    sizes = [(n, 1 + (n * 7919) % 3000) for n in range(800)] + [(900, 20_000), (901, 8192), (902, 0), (903, None)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int")
    rows = packing.pack(df, "doc_id", "tokens", group_items=300).collect()
    fill, of = {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 8192
    assert {k: sum(r.tokens for r in v) for k, v in of.items()} == {k: s or 0 for k, s in sizes}
    assert all(len(v) == 1 for k, v in of.items() if k != 900) and len(of[900]) == 3
    assert of[902][0].container is None and of[903][0].container is None
    assert len(fill) <= -(-sum(s or 0 for _, s in sizes) // 8192) + 1
    assert packing.pack(df.limit(0), "doc_id", "tokens").count() == 0


def test_packing_ends_where_no_bin_gets_full(spark):
    df = spark.range(2_001).selectExpr("id AS doc_id", "if(id < 1900, 5000, 3000) AS tokens")
    rows = packing.pack(df, "doc_id", "tokens", group_items=300).collect()
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert len(rows) == 2_001 and len(fill) == 1_900 and max(fill.values()) == 8_000


def test_local_search_reaches_every_underfull_bin():
    # the 60 emptiest bins can't empty each other; the two fullest can be emptied into them
    sizes = [6] * 60 + [7, 2, 4, 4]
    bins = [[n] for n in range(60)] + [[60], [61, 62], [63]]
    packed = packing.local_search(bins, sizes, 10)
    assert len(packed) == 61 and sorted(i for b in packed for i in b) == list(range(64))
    assert all(sum(sizes[i] for i in b) <= 10 for b in packed)
