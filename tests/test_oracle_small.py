"""Every registered query against its DuckDB oracle on the smallest scale factor.

The driver runs the same comparison at sf0.01; here it is the regression gate."""

import pytest

from tidewater.plans import ORACLES, QUERIES
from compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF)
    assert key in ORACLES, f"{key} has no oracle"
    r = compare(df, ORACLES[key], duck)
    assert r["ok"], r
