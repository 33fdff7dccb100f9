import inspect

import __spark_entry__ as entry
import pytest
from helpers import SMALL, same_rows
from quillmill.plans import registry


def test_flagship_has_a_row_per_author(spark):
    df = entry.entry(spark)
    assert df.count() == 20
    assert "lexical_density_pct" in df.columns


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck.execute(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_queries_take_a_session_and_a_folder():
    for f in entry.queries().values():
        assert list(inspect.signature(f).parameters) == ["spark", "sf_dir"]


def test_nothing_else_imports_the_llm_package():
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p
