"""Every registered panel query against its SQL over the smallest tables."""

import os

import pytest

from tests.oracle import ROOT, difference
from tidewater.plans.model_queries import ORACLES as MODEL_SQL, QUERIES as MODELS
from tidewater.plans.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="the test tables aren't there")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, "sf0.001", name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{ROOT}/sf0.001").count() > 0


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_queries_give_rows(spark, name):
    assert MODELS[name](spark, f"{ROOT}/sf0.001").count() > 0


@pytest.mark.parametrize("name", sorted(MODEL_SQL))
def test_model_queries_equal_sql(spark, name):
    assert difference(spark, "sf0.001", name, MODELS[name], MODEL_SQL[name]) is None
