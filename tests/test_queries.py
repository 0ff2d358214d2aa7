"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest
from compare import explain_difference, run_pair, type_differences
from conftest import SF

from parlance.plans.catalog import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    left, right = run_pair(spark, duck, SF, QUERIES[name], SQL.get(name))
    assert left[1], "no rows"
    assert explain_difference(left, right) is None


def test_types(spark, duck):
    for name in ("vad_segments", "transcript", "merge_repeats", "min_chunk_gate"):
        assert type_differences(QUERIES[name](spark, SF), duck.execute(SQL[name])) is None
