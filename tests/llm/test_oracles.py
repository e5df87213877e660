import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import same

from gridloom.llm import queries

SF = os.environ.get("GRIDLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0
