"""Beyond the bound of a broadcast the same rows come out of a shuffled join."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from data import rows_of  # noqa: E402

from kestrel.llm import common, queries  # noqa: E402


@pytest.mark.parametrize("name", ["op2_lm_scoring", "op5_mixing", "op6_quality_rules", "op8_toxicity"])
def test_without_broadcasts(spark, sf_small, monkeypatch, name):
    def rounded(df):
        return df.select(*[c if t != "double" else df[c].cast("decimal(30,9)").alias(c) for c, t in df.dtypes])
    want = rows_of(rounded(queries.REGISTRY[name](spark, sf_small)))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert rows_of(rounded(queries.REGISTRY[name](spark, sf_small))) == want
