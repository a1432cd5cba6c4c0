from pyspark.sql import functions as F

from paragrid.operators import grounding, rules


def test_first_rule(spark):
    df = spark.createDataFrame([(0, "장학금 휴학"), (1, "Tuition fee"), (2, "intuition"), (3, None), (4, "")], "n int, t string")
    got = df.select("n", rules.first_rule(F.col("t"), [("leave", "휴학"), ("aid", "장학금"), ("tuition", "tuition")]).alias("r")).orderBy("n")
    assert [r.r for r in got.collect()] == ["leave", "tuition", None, None, None]


def test_caller_order(spark):
    asked = spark.createDataFrame([("q", ["b", "a", "b", "zz"]), ("e", []), ("n", None)], "q string, ids array<string>")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [(r.q, r.place, r.v) for r in rules.in_order(asked, "ids", rows, "id").orderBy("place").collect()] == [("q", 0, 2), ("q", 1, 1)]


def test_multisets(spark):
    df = spark.createDataFrame([("g", "x", 0), ("g", "x", 0), ("g", "x", 1), ("g", "y", 1)], "g string, v string, late int")
    assert tuple(rules.multiset_difference(df, "g", "v", F.col("late") == 1).first()) == ("g", 1, 1, 1)


def test_claims(spark):
    schema = "id string, claim string, sources array<struct<chunk_id:string,text:string>>"
    cases = spark.createDataFrame([
        ("a", "신청은 5명이 한다", [("x", "다른 글"), ("y", "앞  신청은 5명이 한다 뒤")]), ("b", "신청은 6명이 한다", [("x", "신청은 5명이 한다")]),
        ("c", "아무", []), ("d", None, [("x", None)]), ("a", "신청은 5명이 한다", [("x", "다른 글"), ("y", "앞  신청은 5명이 한다 뒤")]),
    ], schema)
    judged = grounding.reasons(cases, grounding.attribute(grounding.support(grounding.claim_sources(cases))))
    got = {r.id: (r.supported, r.reason) for r in judged.collect()}
    assert got["a"] == (True, "supported") and got["b"] == (False, "critical_value_mismatch") and got["c"] == (False, "no_source")
    assert got["d"][0] is False
    assert judged.count() == 4


def test_vectors_and_samples(spark):
    df = spark.createDataFrame([(n, [3.0, 4.0], n % 2) for n in range(10)] + [(11, [float("nan"), 1.0], 0)], "k int, v array<double>, g int")
    report = {r.g: r for r in rules.vector_report(df, "v", "g").collect()}
    assert report[1].least_norm == 5.0 and report[0].bad == 1 and report[1].bad == 0
    once, again = (rules.seeded_sample(df, F.col("k"), 4, "s").select("k").collect() for _ in range(2))
    assert once == again and len(once) == 4
    arms = rules.balanced_assignment(df.withColumn("id", F.col("k").cast("string")), "g", "id", "s").groupBy("g", "first_arm").count().collect()
    assert all(r["count"] in (2, 3) for r in arms)
