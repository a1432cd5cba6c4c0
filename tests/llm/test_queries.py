from paragrid.llm import queries


def test_names_and_sql():
    names = set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} | {"p8_ids"} <= names
    assert set(queries.oracle_sql()) <= names
