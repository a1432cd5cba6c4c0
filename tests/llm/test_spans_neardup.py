import random
import re

from paragrid.llm import neardup, spans


def _brute(rows, length=150):
    windows = {}
    for key, text in rows:
        for i in range(len(text or "") - length + 1):
            windows.setdefault(text[i : i + length], set()).add(key)
    return {(a, b) for s in windows.values() for a in s for b in s if a < b}, windows


def test_cover_is_perfect():
    differences = {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER}
    assert differences == set(range(spans.PERIOD)) and spans.PERIOD + spans.WINDOW - 1 == spans.LENGTH


def test_shared_passages(spark):
    random.seed(4)
    noise = lambda n: "".join(random.choice("가나다라마바사 아자차카타파하") for _ in range(n))
    base, near, hot = noise(150), noise(149), noise(400)
    rows = [(1, noise(33) + base + noise(90)), (2, noise(71) + base), (3, base), (4, noise(40) + near + noise(20)), (5, near + noise(77))]
    rows += [(10 + n, noise(n * 3) + hot + noise(50)) for n in range(12)] + [(30, None), (31, ""), (32, "짧다"), (3, base)]
    rows += [(33, noise(200) + "x" * 400)]
    want, windows = _brute(rows)
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, start int")
    assert {tuple(r) for r in spans.sharing_pairs(df).collect()} == want
    share = {r.doc_id: r for r in spans.shared_share(df).collect()}
    assert share[3].shared_chars == 150 and share[3].share == 1.0 and share[4].shared_chars == 0 and share[30].n_chars == 0
    assert share[12].shared_chars == 400
    assert spans.sharing_pairs(df.limit(0)).count() == 0


def _likeness(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates_equal_brute_force(spark):
    random.seed(9)
    words = ["".join(random.choice("가나다라마바사아자차카타파하거너더러머버") for _ in range(random.randint(2, 4))) for _ in range(800)]
    texts = {f"d{n}": " ".join(random.choice(words) for _ in range(120)) for n in range(40)}
    for n in range(12):
        parts = texts[f"d{n}"].split(" ")
        for _ in range(n):
            parts[random.randrange(len(parts))] = random.choice(words)
        texts[f"e{n}"] = " ".join(parts)
    texts |= {"short": "가나", "short2": "가나", "copy": texts["d0"] + "\n"}
    rows = [(k, f"{k}:{i}", "paragraph", i, t) for k, v in texts.items() for i, t in enumerate([v[:200], v[200:]])]
    rows += rows[:3] + [("n", "n:0", "paragraph", 0, None), ("c", "c:0", "table_cell", 0, texts["d1"])]
    df = spark.createDataFrame(rows, "document_id string, block_id string, block_type string, reading_order int, text string")
    import re

    whole = {k: re.sub(r"\s+", " ", v[:200] + "\n" + v[200:]) for k, v in texts.items()}
    want = {(a, b) for a in whole for b in whole if a < b and _likeness(whole[a], whole[b]) >= 0.7}
    assert {tuple(r) for r in neardup.alike_pairs(df).collect()} == want and want
    groups = {r.document_id: r.group_id for r in neardup.groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    assert neardup.alike_pairs(df.limit(0)).count() == 0


def test_tree_finds_all_within_the_radius():
    random.seed(2)
    values = [random.getrandbits(32) for _ in range(300)]
    values += [v ^ 5 for v in values[:40]]
    tree = neardup.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[:50]:
        assert sorted(tree.within(v, 6)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 6]


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 4)
    base = " ".join(f"문장{n}입니다" for n in range(90))
    rows = [(f"k{n:02d}", f"k{n}:0", "paragraph", 0, base + f" 끝{n}") for n in range(14)]
    df = spark.createDataFrame(rows, "document_id string, block_id string, block_type string, reading_order int, text string")
    assert neardup.alike_pairs(df).count() == 14 * 13 // 2


BLOCKS = "document_id string, block_id string, block_type string, reading_order int, text string"


def test_documents_of_many_blocks_are_kept(spark):
    rows = [(f"k{n}", f"k{n}:{i}", "paragraph", i, f"제{i}조 내용은 다음과 같다 {i * 7}") for n in range(10) for i in range(60)]
    df = spark.createDataFrame(rows, BLOCKS)
    assert neardup.alike_pairs(df).count() == 45
    groups = neardup.groups(df.union(spark.createDataFrame([("none", "n:0", "table_cell", 0, "x"), ("short", "s:0", "paragraph", 0, "가")], BLOCKS))).collect()
    assert len(groups) == 12 and len({r.group_id for r in groups}) == 3


def test_large_documents_are_measured_in_parts(spark, monkeypatch):
    random.seed(4)
    lines = [" ".join(random.choice("가나다라마바사아자차카") * random.randint(1, 4) for _ in range(6)) for _ in range(120)]
    changed = lines[:100] + [f"새로운 조문 {n} " for n in range(8)]
    odd = ["", " ", "가", "  나", "다 ", "라"] + lines + ["끝", " "]
    texts = {"a": lines, "b": changed, "c": odd, "d": list(lines), "e": [f"다른 글 {n * n}" for n in range(90)]}
    rows = [(k, f"{k}:{i:04d}", "paragraph", i if i % 9 else None if i == 0 else i, t) for k, v in texts.items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows + rows[:5], BLOCKS)
    plain = {tuple(r) for r in neardup.alike_pairs(df).collect()}
    monkeypatch.setattr(neardup, "LARGE_BLOCKS", 95)
    monkeypatch.setattr(neardup, "GROUP_CHARS", 200)
    assert {tuple(r) for r in neardup.alike_pairs(df).collect()} == plain and ("a", "d") in plain and ("a", "b") in plain
    whole = {k: re.sub(r"\s+", " ", "\n".join(v)) for k, v in texts.items()}
    assert plain == {(x, y) for x in whole for y in whole if x < y and _likeness(whole[x], whole[y]) >= 0.7}
