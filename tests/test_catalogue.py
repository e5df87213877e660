import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import same

from gridloom.plans import catalogue

SF = os.environ.get("GRIDLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_as_sql(spark, name):
    assert same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF) > 0
