"""The paths for many distinct values give the same rows as the small ones: every
query that chooses by ``ranks.SMALL_NDV`` is held against DuckDB with a bound of 10."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, duck  # noqa: E402

from kestrel.operators import ranks  # noqa: E402
from kestrel.plans.oracle import ORACLE  # noqa: E402
from kestrel.plans.queries import REGISTRY  # noqa: E402


@pytest.mark.parametrize("name", ["drift_ks", "drift_psi", "pct_rank", "label_encode", "median_fill", "robust_scale",
                                  "winsorize", "qcut_bins", "mutual_info", "knn_fill"])
def test_large_path(spark, sf_small, monkeypatch, name):
    monkeypatch.setattr(ranks, "SMALL_NDV", 10)
    ok, why = compare(REGISTRY[name](spark, sf_small).toPandas(), duck(sf_small).execute(ORACLE[name]).df())
    assert ok, why
