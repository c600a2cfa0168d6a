import __spark_entry__ as e


def test_queries_have_their_sql():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["bx", "by_", "rank", "nx", "ny"] and df.limit(1).count() == 1


def test_nothing_else_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(e.__file__).parent / "slidespark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "slidespark.llm" in p.read_text()]
