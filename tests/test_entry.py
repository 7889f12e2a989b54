import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 90


def test_the_library_doesnt_import_its_text_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "fieldloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "fieldloom.llm" not in path.read_text(), path
