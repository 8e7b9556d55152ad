"""Distributed learners (MLlib): weighted random forest, per-class boosted
trees with patience on validation rows, multilayer perceptron, weighted
multinomial logistic regression, out-of-fold stacking, blend weights, model
choice, the two baselines and the importance summary; plus the resampling
evaluations (k-fold, repeated k-fold, walk-forward, repeated hold-out).

All fits read a feature frame that holds a ``features`` vector, a ``label``
double and a ``weight`` double; class weights are joined in from a 3-row
table (broadcast). Predictions come back as three double columns p0, p1, p2
next to the key, so evaluation and score correction stay in SQL.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_ROLES, Roles
from ..functions.exprs import argmax3, clean_num, clip_label
from ..session import reliable_checkpoint
from . import evaluate, profile, split

P = ("p0", "p1", "p2")

# ---------------------------------------------------------------------------
# Learner profiles (trees, depth, leaf size, feature share,
# row share, impurity) and boosting settings (depth, rate, row share, rounds,
# early stop)
# ---------------------------------------------------------------------------
FOREST_PROFILES = {
    "train": dict(numTrees=480, maxDepth=11, minInstancesPerNode=2, featureSubsetStrategy="0.79",
                  subsamplingRate=0.92, impurity="gini"),
    "validation": dict(numTrees=320, maxDepth=10, minInstancesPerNode=3, featureSubsetStrategy="0.79",
                       subsamplingRate=0.90, impurity="gini"),
    "baseline": dict(numTrees=500, maxDepth=12, minInstancesPerNode=4, featureSubsetStrategy="0.8",
                     subsamplingRate=1.0, impurity="gini"),
    "fallback": dict(numTrees=600, maxDepth=13, minInstancesPerNode=2, featureSubsetStrategy="sqrt",
                     subsamplingRate=1.0, impurity="gini"),
    "entropy": dict(numTrees=420, maxDepth=11, minInstancesPerNode=1, featureSubsetStrategy="0.81",
                    subsamplingRate=0.90, impurity="entropy"),
    "stack": dict(numTrees=200, maxDepth=30, minInstancesPerNode=1, featureSubsetStrategy="sqrt",
                  subsamplingRate=1.0, impurity="gini"),
}
BOOST_PROFILES = {
    "leaf_wise": dict(maxDepth=6, stepSize=0.027, subsamplingRate=0.86, featureSubsetStrategy="0.8",
                      maxIter=2200, patience=140),
    "depth_wise": dict(maxDepth=5, stepSize=0.027, subsamplingRate=0.86, featureSubsetStrategy="0.8",
                       maxIter=2200, patience=140),
    "symmetric": dict(maxDepth=6, stepSize=0.022, subsamplingRate=0.87, featureSubsetStrategy="0.83",
                      maxIter=2200, patience=140),
    "classic": dict(maxDepth=6, stepSize=0.048, subsamplingRate=0.89, featureSubsetStrategy="sqrt",
                    maxIter=320, patience=40),
    "baseline": dict(maxDepth=7, stepSize=0.06, subsamplingRate=0.85, featureSubsetStrategy="all",
                     maxIter=300, patience=None),
}
MLP_HIDDEN = (140, 70, 35)
META_C = 0.8


@dataclass
class Fitted:
    name: str
    models: list
    kind: str
    features: list[str] = field(default_factory=list)
    rounds: list[tuple[int, int]] = field(default_factory=list)  # boosting: (evaluated, kept) per class


def align_features(df: DataFrame, feature_cols: list[str]) -> list:
    """The columns a model was fitted on, in its order: cleaned numbers, 0 for a
    column that ``df`` does not have."""
    return [(clean_num(c) if c in df.columns else F.lit(0.0)).alias(c) for c in feature_cols]


def assemble(df: DataFrame, feature_cols: list[str], roles: Roles = DEFAULT_ROLES,
             weights: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, [label], [weight], features) with NULL/NaN/inf -> 0 on every
    feature and the label clipped to 0..2. ``weights`` is the (label, weight)
    class-weight table (3 rows, broadcast)."""
    keep = keep or []
    y = roles.label
    cols = [roles.key, *keep, *align_features(df, feature_cols)]
    has_y = y in df.columns
    if has_y:
        cols.append(clip_label(F.coalesce(F.col(y), F.lit(0))).cast("double").alias("label"))
    out = df.select(*cols)
    if has_y and weights is not None:
        out = out.join(F.broadcast(weights.select(F.col("label").cast("double").alias("label"), "weight")),
                       "label", "left").fillna(1.0, ["weight"])
    elif has_y:
        out = out.withColumn("weight", F.lit(1.0))
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    return va.transform(out).drop(*feature_cols)


def weight_table(train: DataFrame, profile_name: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return profile.class_weights(train, profile_name, roles).select("label", "weight")


def _probs(pred: DataFrame, key: str, col: str = "probability", keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    arr = vector_to_array(F.col(col))
    return pred.select(key, *keep, *[arr[i].alias(p) for i, p in enumerate(P)])


#: Rows that one task of a fit is given. A tree fit's passes send the split statistics of
#: every open node from every task, so a small table is fitted fastest in one task, with as
#: many fits side by side as there are cores.
FIT_ROWS = 50_000


def shared_frame(df: DataFrame) -> tuple[DataFrame, int]:
    """(``df`` written once for many fits, in as many partitions as its rows need; how many
    fits to run side by side so that all cores have work)."""
    df = reliable_checkpoint(df)
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-rows // FIT_ROWS), max(cores, -(-rows // MOST_FIT_ROWS))))
    have = df.rdd.getNumPartitions()
    if have > parts:
        df = df.coalesce(parts)
    elif have < parts:
        df = reliable_checkpoint(df.repartition(parts))
    return df, max(1, cores // parts)


#: Rows that one task of a fit holds at most, where there are more than cores many tasks.
MOST_FIT_ROWS = 500_000


def fit_frame(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than cores, or than its rows need: the split statistics of
    every open node are sent from every partition in every pass of a tree fit, so more of
    them only send the same nodes more often. A small table keeps its partitions, on which
    the draws of a forest depend."""
    have, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    if have <= cores:
        return df
    rows = df.count()
    return df if rows <= FIT_ROWS else df.coalesce(max(cores, -(-rows // MOST_FIT_ROWS)))


def _parallel(tasks, parallelism: int):
    """Run independent fits concurrently (each submits its own Spark jobs, as
    CrossValidator's ``parallelism`` does); results keep task order."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(tasks)))) as ex:
        return list(ex.map(lambda t: t(), tasks))


# ---------------------------------------------------------------- forest
def fit_forest(data: DataFrame, profile_name: str = "train", seed: int = C.SEED, **over) -> Fitted:
    prm = {**FOREST_PROFILES[profile_name], **over}
    # maxMemoryInMB / cacheNodeIds only change how many tree nodes are split per
    # data pass (fewer passes over the cached rows), not the model
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                seed=seed, bootstrap=True, maxBins=64, maxMemoryInMB=256,
                                cacheNodeIds=True, checkpointInterval=10, **prm)
    return Fitted("random_forest", [rf.fit(fit_frame(data))], "forest")


# ---------------------------------------------------------------- boosting
def fit_boosted(data: DataFrame, profile_name: str = "leaf_wise", seed: int = C.SEED,
                val_col: str | None = None, key: str = "id", **over) -> Fitted:
    """Multiclass boosting as one binary GBT per class (one-vs-rest) with the class
    weights; probabilities are normalised across classes at prediction time.

    With a patience, validation rows (``val_col``) choose the number of rounds: the
    best round is kept once ``patience`` rounds after it brought nothing better, or
    the profile's rounds are used up. Fits go on with twice the rounds until that
    is known; a round's tree depends on the seed and the rounds before it only, so
    every longer fit begins with the same trees. The model kept is the best prefix of
    the trees already grown."""
    prm = {**BOOST_PROFILES[profile_name], **over}
    patience = prm.pop("patience", None)
    if val_col is None and patience and key in data.columns:
        # no validation rows given: hold out a deterministic 10 % of the fit
        # rows (hash of the key) for early stopping, as a boosting library's
        # internal validation fraction does
        data = data.withColumn("_es_val", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10)) == 0)
        val_col = "_es_val"
    most = prm.pop("maxIter")
    data = fit_frame(data)

    def fit_one(c):
        d = data.withColumn("label", (F.col("label") == c).cast("double"))
        fit_rows = d.filter(~F.col(val_col)) if val_col else d

        # a round grows one shallow tree: walking it anew costs less than writing every
        # row's node down in each pass; the trees are the same
        def rounds(n):
            return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=seed,
                                 maxBins=64, lossType="logistic", maxMemoryInMB=1024, cacheNodeIds=False,
                                 checkpointInterval=10, maxIter=n, **prm).fit(fit_rows)
        if not (patience and val_col):
            return rounds(most), (most, most)
        n = min(most, 2 * patience)
        while True:
            model = rounds(n)
            best, settled = best_round(model.evaluateEachIteration(d.filter(F.col(val_col))), patience)
            if settled or n == most:
                break
            n = min(most, 2 * n)
        return first_rounds(model, best + 1), (n, best + 1)
    # the per-class boosters are independent: fit them concurrently
    got = _parallel([lambda c=c: fit_one(c) for c in C.CLASSES], len(C.CLASSES))
    return Fitted("boosted", [m for m, _ in got], "ovr", rounds=[r for _, r in got])


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model of the first ``n`` trees of ``model``: what a fit of ``n`` rounds with
    the same seed gives, without growing them again."""
    if n >= model.getNumTrees:
        return model
    java = model._java_obj
    gw = SparkContext._active_spark_context._gateway
    tree = gw.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = gw.new_array(tree, n), gw.new_array(gw.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    prefix = gw.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{java.uid()}_first{n}", trees, weights, java.numFeatures(), 2)
    return GBTClassificationModel(java.copyValues(prefix, java.extractParamMap()))


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(round with the smallest loss, from 0, before ``patience`` rounds without a
    smaller one; whether those rounds have been seen)."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


# ---------------------------------------------------------------- neural network / logistic
def fit_mlp(data: DataFrame, n_features: int, seed: int = C.SEED, max_iter: int = 200) -> Fitted:
    """Multilayer perceptron 140-70-35 (sigmoid hidden units, L-BFGS; MLlib
    takes no row weights)."""
    m = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                       layers=[n_features, *MLP_HIDDEN, len(C.CLASSES)],
                                       seed=seed, maxIter=max_iter, blockSize=128)
    return Fitted("neural_network", [m.fit(data)], "single")


def fit_logistic(data: DataFrame, c: float = META_C) -> Fitted:
    """Weighted multinomial logistic regression, L2 with regParam = 1 / (C n)."""
    n = data.count()
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
                            maxIter=200)
    return Fitted("logistic", [lr.fit(data)], "single")


def predict(fitted: Fitted, data: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., p0, p1, p2) for one fitted learner."""
    keep = keep or []
    if fitted.kind in ("forest", "single"):
        return _probs(fitted.models[0].transform(data), key, keep=keep)
    out = data.select(key, *keep, "features")
    for c, m in zip(C.CLASSES, fitted.models):
        out = (m.setProbabilityCol(f"_prob{c}").setPredictionCol(f"_pred{c}").setRawPredictionCol(f"_raw{c}")
               .transform(out).withColumn(f"_s{c}", vector_to_array(F.col(f"_prob{c}"))[1])
               .drop(f"_prob{c}", f"_pred{c}", f"_raw{c}"))
    tot = F.col("_s0") + F.col("_s1") + F.col("_s2")
    return out.select(key, *keep, *[F.when(tot > 0, F.col(f"_s{c}") / tot).otherwise(F.lit(1.0 / 3)).alias(p)
                                    for c, p in zip(C.CLASSES, P)])


def with_pred(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred", argmax3(*P))


# ---------------------------------------------------------------- stacking
def stack(train: DataFrame, val: DataFrame, key: str, base: dict, k: int = 5, seed: int = C.SEED,
          roles: Roles = DEFAULT_ROLES, parallelism: int | None = None) -> tuple[Fitted, DataFrame]:
    """Out-of-fold stacking: for each base learner ``base[name] = fit_fn(data)``
    fit k times on k-1 folds and predict the held-out fold; the union of the
    fold predictions (keyed on the row key) feeds a weighted multinomial
    logistic meta learner. The same fit functions are used for the validation
    columns, so train and validation meta features come from one profile.

    All fits, of every learner and fold and of the whole table, read one written
    frame and run side by side; boosters, which take longest, come first."""
    folds = split.strat_folds(train.select(key, F.col("label").alias(roles.label)), k, seed, roles)
    tr, side = shared_frame(train.join(folds, key))
    plan = [(name, f) for name in sorted(base, key=lambda n: "boost" not in n) for f in [*range(k), None]]
    fits = _parallel([lambda name=name, f=f: base[name](tr if f is None else tr.filter(F.col("fold") != f)) for name, f in plan],
                     parallelism or side)
    fitted = dict(zip(plan, fits))
    meta_tr, meta_val = None, None
    for name in base:
        oof = None
        for f in range(k):
            part = predict(fitted[name, f], tr.filter(F.col("fold") == f), key)
            oof = part if oof is None else oof.unionByName(part)
        oof = oof.select(key, *[F.col(p).alias(f"{name}_{p}") for p in P])
        vp = predict(fitted[name, None], val, key).select(key, *[F.col(p).alias(f"{name}_{p}") for p in P])
        meta_tr = oof if meta_tr is None else meta_tr.join(oof, key)
        meta_val = vp if meta_val is None else meta_val.join(vp, key)
    mcols = [c for c in meta_tr.columns if c != key]
    # the meta tables hold every fold prediction: cut lineage once so the
    # iterative meta fit reads files instead of re-scoring the base models
    mt = reliable_checkpoint(VectorAssembler(inputCols=mcols, outputCol="features").transform(
        meta_tr.join(train.select(key, "label", "weight"), key)))
    meta = fit_logistic(mt)
    mv = reliable_checkpoint(VectorAssembler(inputCols=mcols, outputCol="features").transform(meta_val))
    return meta, predict(meta, mv, key)


# ---------------------------------------------------------------- blend weights / choice
def blend_weights(scored: dict[str, DataFrame], y: DataFrame, key: str, prior=C.PRIOR_MIX) -> DataFrame:
    """(model, score, weight): score = .60 acc + .20 macro F1 - .20 L1(mix,
    prior), weights = score / sum (equal when the sum is not positive)."""
    a, b, c = C.BLEND_SCORE
    rows = None
    for name, s in scored.items():
        rep = evaluate.report(with_pred(s).join(y, key), "y", "pred", prior=prior)
        r = rep.select(F.lit(name).alias("model"),
                       (a * F.col("accuracy") + b * F.col("f1_macro") - c * F.col("distribution_error")).alias("score"),
                       "accuracy")
        rows = r if rows is None else rows.unionByName(r)
    tot = rows.agg(F.sum("score").alias("tot"), F.count(F.lit(1)).alias("k"))
    return rows.crossJoin(tot).select(
        "model", "score", "accuracy",
        F.when(F.col("tot") > 0, F.col("score") / F.col("tot")).otherwise(1.0 / F.col("k")).alias("weight"))


def best_model(weights: DataFrame) -> DataFrame:
    return weights.agg(F.max_by("model", F.struct("accuracy", "model")).alias("best_model"),
                       F.max("accuracy").alias("best_accuracy"))


# ---------------------------------------------------------------- importance
def importance_summary(fitted: Fitted, feature_cols: list[str]) -> dict:
    """Mean / population std / max of the forest importances, share of the top
    10 and top 5, concentration (share not above the mean) and diversity."""
    import numpy as np
    imp = np.asarray(fitted.models[0].featureImportances.toArray(), dtype=float)
    tot = imp.sum() or 1.0
    srt = np.sort(imp)
    return {"mean_importance": float(imp.mean()), "std_importance": float(imp.std()),
            "max_importance": float(imp.max()), "top_10_ratio": float(srt[-10:].sum() / tot),
            "top_5_ratio": float(srt[-5:].sum() / tot),
            "concentration": float(1 - (imp > imp.mean()).sum() / len(imp)),
            "diversity_score": float(1 - imp.max() / tot), "n_features": int(len(imp))}


# ---------------------------------------------------------------- resampling evaluations
def resampled(data: DataFrame, key: str, fit_fn, schemes: dict[str, DataFrame],
              parallelism: int | None = None) -> DataFrame:
    """(scheme, rep, fold, accuracy, n_val): ``fit_fn``'s accuracy for every fold of every scheme.

    ``schemes[name]`` has (key, fold, role) and, where a scheme is repeated, rep; a row may have
    a role in several folds or in none. Every fold is a role column of one frame that is
    written once, and all fits of all schemes run side by side on it."""
    plan, wide = [], None
    for name, s in schemes.items():
        s = s if "rep" in s.columns else s.withColumn("rep", F.lit(0))
        parts = [(name, r["rep"], r["fold"]) for r in s.select("rep", "fold").distinct().orderBy("rep", "fold").collect()]
        cols = [F.max(F.when((F.col("rep") == rep) & (F.col("fold") == f), F.col("role"))).alias(f"_role_{len(plan) + i}")
                for i, (_, rep, f) in enumerate(parts)]
        plan += parts
        one = s.groupBy(key).agg(*cols) if parts else s.select(key).distinct()
        wide = one if wide is None else wide.join(one, key, "full")
    frame, side = shared_frame(data.join(wide, key))

    def task_for(i, scheme, rep, f):
        def task():
            role = F.col(f"_role_{i}")
            m = fit_fn(frame.filter(role == "train"))
            pr = with_pred(predict(m, frame.filter(role == "val"), key, keep=["label"]))
            r = pr.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("a"),
                       F.count(F.lit(1)).alias("n")).first()
            return (scheme, int(rep), int(f), r["a"], int(r["n"]))
        return task
    rows = _parallel([task_for(i, *p) for i, p in enumerate(plan)], parallelism or side)
    return data.sparkSession.createDataFrame(rows, "scheme string, rep int, fold int, accuracy double, n_val long")


def kfold_roles(data: DataFrame, key: str, seeds=(C.SEED,), k: int = 5, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """(key, rep, fold, role) of stratified k-fold, a repetition for each seed."""
    out = None
    for i, sd in enumerate(seeds):
        f = split.strat_folds(data.select(key, F.col("label").alias(roles.label)), k, sd, roles)
        part = f.select(key, F.lit(i).alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"),
                        F.col("fold").alias("own"))
        part = part.select(key, "rep", "fold", F.when(F.col("fold") == F.col("own"), "val").otherwise("train").alias("role"))
        out = part if out is None else out.unionByName(part)
    return out


def cv_scores(data: DataFrame, key: str, fit_fn, seeds=(C.SEED,), k: int = 5,
              roles: Roles = DEFAULT_ROLES, folds: DataFrame | None = None, parallelism: int | None = None) -> DataFrame:
    """Accuracy per (rep, fold) of ``fit_fn`` under stratified k-fold (one rep
    per seed) or a precomputed (key, fold, role) table (``folds``, e.g.
    walk-forward)."""
    scheme = folds if folds is not None else kfold_roles(data, key, seeds, k, roles)
    return resampled(data, key, fit_fn, {"cv": scheme}, parallelism).drop("scheme")


def holdout_runs(data: DataFrame, key: str, fit_fn, seeds, size: float = 0.20,
                 roles: Roles = DEFAULT_ROLES, parallelism: int | None = None) -> DataFrame:
    """Per run: fit on the stratified (1 - size) part, report on the rest
    (accuracy, macro F1, distribution score, class balance)."""
    sp = split.repeated_holdout(data.select(key, F.col("label").alias(roles.label)), list(seeds), size, roles)
    cols = ["accuracy", "f1_macro", "distribution_score", "class_balance"]
    frame, side = shared_frame(data.join(sp.groupBy(key).agg(
        *[F.max(F.when(F.col("run") == r, F.col("role"))).alias(f"_role_{r}") for r in range(len(seeds))]), key))

    def task_for(run):
        def task():
            role = F.col(f"_role_{run}")
            try:
                m = fit_fn(frame.filter(role == "train"))
            except Exception as e:  # noqa: BLE001  a failed run is left out and counted by what is missing
                warnings.warn(f"hold-out run {run} failed: {e}", stacklevel=2)
                return None
            pr = with_pred(predict(m, frame.filter(role == "val"), key, keep=["label"]))
            r = evaluate.report(pr.withColumn("y", F.col("label").cast("int")), "y", "pred").select(*cols).first()
            return (run, *[r[c] for c in cols])
        return task
    rows = [r for r in _parallel([task_for(r) for r in range(len(seeds))], parallelism or side) if r is not None]
    return data.sparkSession.createDataFrame(
        rows, "run int, accuracy double, f1_macro double, distribution_score double, class_balance double")
