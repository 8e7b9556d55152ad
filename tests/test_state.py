"""Saved and loaded state gives the same scores; the input contract and the
boosting patience hold."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import evaluate, learn, profile
from kestrel.sources.state import load_or_fit, load_state


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(600).select(
        F.concat(F.lit("TRAIN_"), F.col("id")).alias("id"), (F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * 53 % 89).cast("double").alias("b"))
    df = df.withColumn("support_needs", F.when(F.col("a") < 40, 0).when(F.col("b") < 45, 1).otherwise(2))
    return learn.assemble(df, ["a", "b"], keep=[]).withColumn("is_val", F.crc32("id") % 4 == 0).cache()


def test_round_trip(spark, frame, tmp_path):
    path = str(tmp_path / "state")

    def fit():
        return {"forest": learn.fit_forest(frame, "validation", numTrees=5, maxDepth=4),
                "boosted": learn.fit_boosted(frame, "classic", maxIter=3, patience=None),
                "codes": spark.createDataFrame([("x", 0), ("y", 1)], "category string, code int"), "names": ["a", "b"]}
    state, loaded = load_or_fit(spark, path, fit)
    again, loaded2 = load_or_fit(spark, path, lambda: pytest.fail("must not fit anew"))
    assert not loaded and loaded2 and again["names"] == ["a", "b"] and again["codes"].count() == 2
    first = fit()
    for name in ("forest", "boosted"):
        want = sorted(map(tuple, learn.predict(first[name], frame, "id").collect()))
        assert sorted(map(tuple, learn.predict(again[name], frame, "id").collect())) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_state(spark, str(tmp_path / "none"))


def test_patience():
    assert learn.best_round([5, 4, 3, 4, 4, 4, 1], 3) == (2, True)
    assert learn.best_round([5, 4, 3, 4, 4], 3) == (2, False)
    assert learn.best_round([3.0], 3) == (0, False)


def test_boosting_waits_for_its_patience(frame):
    m = learn.fit_boosted(frame, "classic", val_col="is_val", maxIter=12, patience=3, maxDepth=2)
    for (seen, kept), model in zip(m.rounds, m.models):
        assert kept == len(model.trees) and (seen >= kept + 3 or seen == 12)
        d = frame.withColumn("label", (F.col("label") == m.models.index(model)).cast("double")).filter("is_val")
        losses = model.evaluateEachIteration(d)
        assert losses[-1] == min(losses)


def test_contract(spark):
    rows = {(r.rule, r.subject): r.passed for r in profile.contract_check(
        spark.createDataFrame([], "id string, a int"), "train", ["id", "b"]).collect()}
    assert rows == {("column", "id"): True, ("column", "b"): False, ("rows", "all"): False}


def test_too_few_runs_give_zero(spark):
    runs = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)] * 5, "accuracy double, f1_macro double, distribution_score double, class_balance double")
    r = evaluate.stability_or_default(runs).first()
    assert not r.enough and r.overall_stability == 0 and r.n_runs == 5
    assert evaluate.stability_or_default(runs.union(runs)).first().overall_stability > 0.7
