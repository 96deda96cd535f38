"""Parsers and rules against the expected values of small literal tables."""

import pytest

import literal_cases
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(literal_cases)  # workers don't have the tests


@pytest.mark.parametrize("name", sorted(literal_cases.QUERIES))
def test_case(spark, name):
    got = {r.n: r.out for r in literal_cases.QUERIES[name](spark).collect()}
    assert got == dict(enumerate(literal_cases.EXPECTED[name]))
