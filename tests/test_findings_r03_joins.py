"""What round 3's findings on larger tables found in joins: nothing that grows with the library is broadcast by its files' size."""

import pytest

from veridag.operators import graph, payload, programme
from veridag.sources.testbed import Library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, SF)


# Parts of H7, A12 and A13 stand for them: their walks broadcast rows that were counted.
@pytest.mark.parametrize("make", [payload.broad_records, graph.answered, programme.answered_in_aims, programme.aspirational, programme.tests_at_risk, programme.programme_labels, programme.claim_groups, programme.clean], ids=lambda f: f.__name__)
def test_no_join_is_left_to_a_size(lib, make):
    """F28, F15, F25, F33, F20, F27."""
    assert "Broadcast" not in make(lib)._jdf.queryExecution().executedPlan().toString()
