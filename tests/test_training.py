"""The training plan on a small frame: failures are listed, the rest is blended."""

from pyspark.sql import functions as F

from kestrel.operators import learn
from kestrel.plans import pipeline


def test_a_failed_learner_is_listed(spark, monkeypatch):
    df = spark.range(2400).select(
        F.concat(F.lit("TRAIN_"), F.col("id")).alias("id"), (F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * 53 % 89).cast("double").alias("b"))
    df = df.withColumn("support_needs", F.when(F.col("a") < 40, 0).when(F.col("b") < 45, 1).otherwise(2))
    test = df.where("id like '%7'").drop("support_needs")

    def broken(d, n):
        raise ValueError("no such library")
    small = {"random_forest": lambda d, n: pipeline.learn.fit_forest(d.filter("not is_val"), "train", numTrees=4, maxDepth=4),
             "lightgbm": broken,
             "gradient_boosting": lambda d, n: pipeline.learn.fit_boosted(d, "classic", val_col="is_val", maxIter=4, maxDepth=2)}
    monkeypatch.setattr(pipeline, "MODEL_FITS", small)
    monkeypatch.setattr(pipeline, "STACK_FITS", {"random_forest": lambda d: pipeline.learn.fit_forest(d, "stack", numTrees=3, maxDepth=3)})
    probs, table, fitted = pipeline.train_and_score(df, test, models=tuple(small))
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {*small, "stacking"} and rows["lightgbm"].weight == 0 and "no such library" in rows["lightgbm"].failure
    assert abs(sum(r.weight for r in rows.values()) - 1) < 1e-9 and rows["random_forest"].accuracy > 0.8
    got = probs.collect()
    assert len(got) == test.count() and all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-6 for r in got)
    assert set(pipeline.end_to_end.__defaults__[1]) == {
        "lightgbm", "xgboost", "catboost", "random_forest", "extra_trees", "gradient_boosting", "neural_network"}


def test_prefix_of_a_boosted_model_is_the_shorter_fit(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    rows = [(float(i % 3 == 0), Vectors.dense([i % 7, i % 11, i % 3 + i % 5])) for i in range(300)]
    df = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)

    def fit(n):
        return GBTClassifier(seed=3, maxIter=n, maxDepth=3, subsamplingRate=0.8).fit(df)
    short, prefix = fit(4), learn.first_rounds(fit(9), 4)
    cols = ["rawPrediction", "probability", "prediction"]
    assert prefix.getNumTrees == 4
    assert prefix.transform(df).select(*cols).collect() == short.transform(df).select(*cols).collect()
    assert learn.first_rounds(short, 4) is short


def test_resampled_runs_all_schemes_on_one_frame(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(f"k{i:03d}", float(i % 3), 1.0, Vectors.dense([i % 3, i % 5])) for i in range(120)]
    df = spark.createDataFrame(rows, ["id", "label", "weight", "features"])
    ahead = spark.createDataFrame([(f"k{i:03d}", f, "train" if i < 40 * (f + 1) else "val")
                                   for f in range(2) for i in range(40 * (f + 2))], "id string, fold int, role string")
    seen = []

    def fit(d):
        seen.append(d.count())
        return learn.fit_forest(d, "validation", numTrees=3, maxDepth=3)
    out = learn.resampled(df, "id", fit, {"kfold": learn.kfold_roles(df, "id", (1, 2), 3), "ahead": ahead}).collect()
    assert sorted((r["scheme"], r["rep"], r["fold"]) for r in out) == sorted(
        [("kfold", i, f) for i in range(2) for f in range(3)] + [("ahead", 0, f) for f in range(2)])
    assert all(sum(r["n_val"] for r in out if r["scheme"] == "kfold" and r["rep"] == i) == 120 for i in range(2))
    assert {r["fold"]: r["n_val"] for r in out if r["scheme"] == "ahead"} == {0: 40, 1: 40}
    assert len(seen) == 8 and sum(seen) == 4 * 120 + 40 + 80 and all(r["accuracy"] > 0.9 for r in out)
    frame, side = learn.shared_frame(df.repartition(6))
    assert frame.rdd.getNumPartitions() == 1 and side >= 1 and frame.count() == 120


def test_fits_take_no_more_partitions_than_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(400).repartition(8 * cores)
    assert learn.fit_frame(df) is df  # a small table
    monkeypatch.setattr(learn, "FIT_ROWS", 1)
    got = learn.fit_frame(df)
    assert got.rdd.getNumPartitions() == cores and got.count() == 400
    few = spark.range(400).repartition(1)
    assert learn.fit_frame(few) is few
    assert learn.shared_frame(df)[0].rdd.getNumPartitions() == cores
    # beyond that, a task holds MOST_FIT_ROWS at most
    monkeypatch.setattr(learn, "MOST_FIT_ROWS", 400 // (2 * cores))
    wide = learn.fit_frame(df)
    assert wide.rdd.getNumPartitions() >= 2 * cores and wide.count() == 400


def test_walking_a_tree_anew_grows_the_same_trees(spark):
    from pyspark.ml.classification import GBTClassifier
    df = spark.range(600).select(F.concat(F.lit("a"), F.col("id")).alias("id"), (F.col("id") % 3).cast("int").alias("support_needs"),
                                 (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 89).cast("double").alias("y"))
    d = learn.assemble(df, ["x", "y"]).coalesce(2)
    got = learn.fit_boosted(d, "baseline", maxIter=3, maxDepth=3)
    prm = {k: v for k, v in learn.BOOST_PROFILES["baseline"].items() if k not in ("patience", "maxIter", "maxDepth")}
    kept = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=learn.C.SEED, maxBins=64,
                         lossType="logistic", maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10, maxIter=3, maxDepth=3, **prm)
    one = kept.fit(d.withColumn("label", (F.col("label") == 0).cast("double")))
    assert [t.toDebugString.split("\n", 1)[1] for t in got.models[0].trees] == [t.toDebugString.split("\n", 1)[1] for t in one.trees]
