import __spark_entry__ as entry


def test_every_problem_has_its_query():
    names = set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 9)} <= names
    assert set(entry.oracle_sql()) <= names
