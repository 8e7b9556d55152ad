"""Tail probabilities as expressions against the numeric forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions.special import chi2_sf, ks_sf
from kestrel.operators import drift, scale


def test_chi_square_tail(spark):
    rows = [(float(x), d) for d in (1, 2, 3, 4, 5, 8, 13, 40, 101) for x in (0, 1e-9, .01, .5, 1, 3.8, d, 2 * d, 30, 90, 300)]
    got = spark.createDataFrame(rows, "x double, d long").select("x", "d", chi2_sf(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(drift.chi2_pvalue(r["x"], r["d"]), rel=1e-8, abs=1e-12), r
    odd = spark.createDataFrame([(None, 1), (float("nan"), 1), (1.0, 0), (-1.0, 3)], "x double, d long")
    assert [r[0] for r in odd.select(chi2_sf(F.col("x"), F.col("d"))).collect()] == [None, None, None, 1.0]


def test_kolmogorov_tail(spark):
    rows = [(d, a, b) for a, b in ((1200, 300), (10, 7), (10 ** 6, 10 ** 6)) for d in (0.0, 1e-4, .01, .03, .086, .3, 1.0)]
    got = spark.createDataFrame(rows, "d double, a long, b long").select("*", ks_sf(F.col("d"), F.col("a"), F.col("b")).alias("p"))
    for r in got.collect():
        lam = r["d"] * math.sqrt(r["a"] * r["b"] / (r["a"] + r["b"]))
        if lam > 0.15:  # below, the numeric form's series has not settled
            assert r["p"] == pytest.approx(drift.ks_pvalue(r["d"], r["a"], r["b"]), rel=1e-8, abs=1e-12), r
        else:
            assert r["p"] == pytest.approx(1.0, abs=1e-9)
    none = spark.createDataFrame([(0.5, 0, 3)], "d double, a long, b long")
    assert none.select(ks_sf(F.col("d"), F.col("a"), F.col("b"))).first()[0] is None


@pytest.mark.parametrize("marks", [[1.0], [1.0, 2.0], [0.0, 1.0, 1.0, 1.0, 2.0, 5.0], [3.0] * 7, list(np.linspace(-1, 9, 500))])
def test_quantile_transform_equals_interpolation(spark, marks):
    values = [-5.0, -1.0, 0.0, .3, 1.0, 1.0 + 5e-8, 1.5, 2.0, 3.0, 4.9, 5.0, 7.77, 9.0, 20.0]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    got = [r[0] for r in scale.apply_quantile_transform(df, {"x": marks}).collect()]
    q, refs, x = np.array(marks), np.linspace(0, 1, len(marks)), np.array(values)
    want = .5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    want[x + 1e-7 > q[-1]], want[x - 1e-7 < q[0]] = 1.0, 0.0
    assert got[-2:] == [None, None] and np.allclose(got[:-2], want, atol=1e-12)
    assert "Python" not in scale.apply_quantile_transform(df, {"x": marks})._jdf.queryExecution().toString()
