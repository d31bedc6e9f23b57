import __spark_entry__ as entry


def test_queries_and_sql_fit():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {f"p{n}_found" for n in (2, 3, 4, 5)} <= set(names)


def test_nothing_else_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "tidelog"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "tidelog.llm" not in file.read_text()
