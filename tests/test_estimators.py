from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from affinity.functions import estimators as E


def one(spark, values):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")
    return E.concentration(E.histogram(df, "x")).first()


def test_known_values(spark):
    r = one(spark, [1.0] * 20)
    assert (r["gini"], r["hhi"], r["top_k_share"], r["entropy"]) == (0.0, 0.0, 0.5, round(math.log(20), 4))
    assert one(spark, [10.0])["hhi"] == 1.0
    assert one(spark, [3, 3, 3])["effective"] == 3.0
    assert one(spark, [1, 2, 3])["alpha"] is None
    assert one(spark, [1, 2, 3, 4])["median"] == 2.5


def test_empty_and_nulls(spark):
    r = one(spark, [])
    assert (r["gini"], r["hhi"], r["entropy"], r["evenness"], r["effective"], r["alpha"], r["median"], r["n"]) == (0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0)
    assert one(spark, [None, float("nan"), 2.0])["n"] == 1
    assert one(spark, [0.0, 0.0])["gini"] == 0.0


def test_modified_z(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([2, 2, 3, 2, 40, 2, 3])], "k int, v long")
    z = {r["k"]: r["z"] for r in E.modified_z(df, "v").collect()}
    assert max(z, key=z.get) == 4 and z[4] > 3.5
    same = spark.createDataFrame([(5,)] * 4, "v long")
    assert {r["z"] for r in E.modified_z(same, "v").collect()} == {0.0}


def test_ols(spark):
    line = lambda rows: tuple(E.ols(spark.createDataFrame(rows, "x double, y double"), "x", "y").first())[:3]
    assert line([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (4.0, 9.0)]) == (2.0, 1.0, 1.0)
    assert line([(1.0, 4.0), (2.0, 4.0)]) == (0.0, 4.0, 0.0)
    assert line([(2.0, 1.0), (2.0, 2.0)]) == (0.0, 1.5, 0.0)
    assert line([(1.0, 1.0)]) == (0.0, 0.0, 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), min_size=2, max_size=40))
def test_against_plain_formulas(spark, values):
    r = one(spark, values)
    n, total = len(values), sum(values)
    gini = sum(abs(a - b) for a in values for b in values) / (2 * n * total)
    h = -sum(v / total * math.log(v / total) for v in values)
    assert r["gini"] == pytest.approx(gini, abs=1e-4)
    assert r["entropy"] == pytest.approx(h, abs=1e-4)
    assert r["top_k_share"] == pytest.approx(sum(sorted(values)[-10:]) / total, abs=1e-4)
