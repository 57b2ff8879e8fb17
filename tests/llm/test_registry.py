import __spark_entry__ as entry


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in entry.queries()
