import pytest
from helpers import SMALL, same_rows
from quillmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.execute(queries.ORACLES[name]))


def test_all_eleven_are_registered():
    numbers = {n.split("_")[0] for n in queries.QUERIES}
    assert numbers == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
