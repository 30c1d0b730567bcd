"""Every registered query of the domain against its oracle, or at least that it runs."""

import colloquy.plans.checks  # noqa: F401 -- adds its queries to the registry's
import colloquy.plans.multimodal  # noqa: F401 -- and so does this
import pytest
from colloquy.plans.registry import ORACLES, QUERIES

from oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
