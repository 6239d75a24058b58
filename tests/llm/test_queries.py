import re

import pytest

from recordlens.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF
from tests.oracle import compare, connect


def test_one_query_per_operator():
    import __spark_entry__ as entry

    numbers = [int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))]
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None
