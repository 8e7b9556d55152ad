"""The first k rows by value and key, found by counting, against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import score


@pytest.mark.parametrize("bins", [2, 4096])
@pytest.mark.parametrize("values", ["continuous", "ties", "one value", "tiny gaps"])
def test_first_k_equals_a_sort(spark, monkeypatch, bins, values):
    monkeypatch.setattr(score, "BINS", bins)
    rng = random.Random(bins)
    draw = {"continuous": rng.random, "ties": lambda: rng.choice([0.0, -0.0, 0.25, 0.5]), "one value": lambda: 0.3,
            "tiny gaps": lambda: 0.5 + rng.randint(0, 3) * 2.0 ** -52}[values]
    rows = [(f"k{i:03d}", draw()) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, p double").cache()
    for k in (1, 77, 199, 200, 500):
        got = df.where(score._first_k(df, -F.col("p"), "id", k)).collect()
        assert {r["id"] for r in got} == {r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_missing_values_take_the_ordered_way(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", 0.2, 0), ("c", 0.9, 0), ("d", 0.5, 0)], "id string, p double, label int")
    assert score._first_k(df, -F.col("p"), "id", 2) is None
    out = score._relabel_top(df, "id", "label", "p", F.lit(True), 2, 1)
    assert {r["id"] for r in out.where("label = 1").collect()} == {"c", "d"}
