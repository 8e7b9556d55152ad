"""End-to-end plans: the feature pipeline, the preprocessing pipeline, model
training and the scoring chain, composed from the operators.

Shape: read once -> one feature plan for both tables (statistics per table
in the same aggregations) -> one reliable checkpoint of the wide feature
frame -> small fitted state (quantiles, encodings, centres, loadings,
models) -> scored frame -> write. Nothing row-sized passes through the
driver; lineage is cut once after the feature plan and once after
preprocessing, so lost executors recompute from those files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_ROLES, Roles
from ..functions.exprs import clean_num, clip_label
from ..operators import encode, features, impute, learn, profile, reduce, scale, score, select, split
from ..session import reliable_checkpoint


@dataclass
class FeatureState:
    suspect_safe: bool = False
    suspect_bounds: tuple | None = None
    kmeans: dict = field(default_factory=dict)


def feature_pipeline(train: DataFrame, test: DataFrame, cutoff: int | None, roles: Roles = DEFAULT_ROLES,
                     clusters: bool = True, n_init: int = 10) -> tuple[DataFrame, DataFrame, FeatureState]:
    """Suspect gate and transforms -> temporal -> business -> statistical ->
    interactions -> out-of-fold target encoding -> k-means features -> label
    codes -> cleaning. Per-table statistics (position, quantile bins, ranks,
    z-scores) are computed for both tables in one pass keyed by ``split``."""
    st = FeatureState()
    key, y, sus = roles.key, roles.label, roles.suspect
    gate = profile.suspect_gate(train, cutoff, sus, roles).first() if sus in train.columns else None
    st.suspect_safe = bool(gate and gate["is_safe"])
    tr = train.withColumn("split", F.lit("train"))
    te = test.withColumn("split", F.lit("test"))
    if y not in te.columns:
        te = te.withColumn(y, F.lit(None).cast("int"))
    # cut 0: the narrow input, read once; every statistic below re-reads only this
    both = reliable_checkpoint(tr.unionByName(te))
    if st.suspect_safe:
        st.suspect_bounds = features.suspect_bounds(train, sus)
        both = features.suspect_features(both, sus, st.suspect_bounds)
    elif sus in both.columns:
        both = both.drop(sus)
    base = both
    both = features.temporal_features(both, roles, by=["split"], src=base)
    both = features.business_features(both)
    both = features.stat_features(both, list(roles.numeric), by=["split"], src=base)
    both = features.interaction_features(both)
    # cut 1: row-local and per-table statistical families
    both = reliable_checkpoint(both)
    tr2 = both.filter(F.col("split") == "train")
    te2 = both.filter(F.col("split") == "test")
    tr2, te2 = encode.target_encode(tr2, te2, list(roles.categorical), roles)
    # cut 2: encodings joined in (keeps the plan small for the k-means fits)
    both = reliable_checkpoint(tr2.unionByName(te2, allowMissingColumns=True))
    tr2 = both.filter(F.col("split") == "train")
    te2 = both.filter(F.col("split") == "test")
    if clusters:
        tr2, te2, st.kmeans = reduce.kmeans_features(tr2, te2, list(roles.numeric), n_init=n_init)
    tr2, te2 = encode.label_encode(tr2, te2, list(roles.categorical))
    both = tr2.unionByName(te2, allowMissingColumns=True)
    num = [f.name for f in both.schema.fields
           if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in (key, y)]
    both = both.select(key, "split", clip_label(F.coalesce(F.col(y), F.lit(0))).alias(y),
                       *[clean_num(c).alias(c) for c in num])
    both = reliable_checkpoint(both)
    return both.filter(F.col("split") == "train").drop("split"), \
        both.filter(F.col("split") == "test").drop("split", y), st


WINSOR_FAMILIES = ("_log", "_sqrt", "_rank", "customer_value", "payment_stability", "usage_intensity")


@dataclass
class PrepState:
    selected: list = field(default_factory=list)
    stage: str = ""
    scaling: dict = field(default_factory=dict)
    pca: dict = field(default_factory=dict)
    route: dict = field(default_factory=dict)


def preprocess(train: DataFrame, test: DataFrame, cutoff: int | None, roles: Roles = DEFAULT_ROLES,
               missing: str = "zero", max_features: int = C.MAX_FEATURES,
               pca: bool = True) -> tuple[DataFrame, DataFrame, PrepState]:
    """Time filter -> routed fill -> train winsorising -> selection cascade ->
    family scaling -> PCA components -> (quality check on demand)."""
    ps = PrepState()
    key, y = roles.key, roles.label
    tr = profile.time_filter(train, cutoff, roles)
    feats = [c for c in tr.columns if c not in (key, y)]
    tr, te, ps.route = impute.routed_fill(tr, test, [c for c in roles.numeric if c in feats], missing, key)
    wcols = [c for c in feats if c in roles.numeric or any(k in c for k in WINSOR_FAMILIES)]
    tr = scale.apply_clip(tr, scale.fit_winsor(tr, wcols))
    ps.selected, ps.stage = select.cascade(tr, feats, max_features, roles=roles)
    keep = [c for c in ps.selected if c in te.columns]
    tr = tr.select(key, y, *keep)
    te = te.select(key, *keep)
    scal = [c for c in keep if c != "temporal_id"]
    ps.scaling = scale.fit_scaling(tr, scal)
    tr, te = scale.apply_scaling(tr, ps.scaling), scale.apply_scaling(te, ps.scaling)
    if pca and len(scal) >= 3:
        ps.pca = reduce.fit_pca(tr, scal)
        tr, te = reduce.apply_pca(tr, ps.pca), reduce.apply_pca(te, ps.pca)
    tr, te = reliable_checkpoint(tr), reliable_checkpoint(te)
    return tr, te, ps


def quality(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return profile.quality_check(train, "train", roles).unionByName(profile.quality_check(test, "test", roles))


#: The seven learner roles, each (frame with validation rows, number of features) -> Fitted.
MODEL_FITS = {
    "lightgbm": lambda d, n: learn.fit_boosted(d, "leaf_wise", val_col="is_val"),
    "xgboost": lambda d, n: learn.fit_boosted(d, "depth_wise", val_col="is_val"),
    "catboost": lambda d, n: learn.fit_boosted(d, "symmetric", val_col="is_val"),
    "random_forest": lambda d, n: learn.fit_forest(d.filter("not is_val"), "train"),
    "extra_trees": lambda d, n: learn.fit_forest(d.filter("not is_val"), "entropy"),
    "gradient_boosting": lambda d, n: learn.fit_boosted(d, "classic", val_col="is_val"),
    "neural_network": lambda d, n: learn.fit_mlp(d.filter("not is_val"), n),
}
#: Base learners of the stack.
STACK_FITS = {
    "random_forest": lambda d: learn.fit_forest(d, "stack"),
    "extra_trees": lambda d: learn.fit_forest(d, "entropy"),
    "gradient_boosting": lambda d: learn.fit_boosted(d, "classic"),
}


def train_and_score(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES,
                    models=tuple(MODEL_FITS), stack: bool = True, gap: float = C.GAP_SIZE_MAIN):
    """Time-ordered split with a gap -> class weights -> one fit per learner
    (boosters wait for their patience on the validation rows) and the stack ->
    validation report, blend weights and best model -> test probabilities blended
    with those weights.

    A learner that fails does not end the run: it is listed with score, accuracy
    and weight 0 and takes no part in the blend. Returns (probabilities, the table
    of models, fitted learners)."""
    key = roles.key
    roles_split = split.gap_split(train, C.VAL_SIZE, gap, roles)
    tr = train.join(roles_split, key).filter(F.col("role") != "gap")
    feats = [c for c in train.columns if c not in (key, roles.label, "temporal_id")]
    w = learn.weight_table(tr.filter(F.col("role") == "train"), "train", roles)
    data = learn.assemble(tr, feats, roles, w, keep=["role"]).withColumn("is_val", F.col("role") == "val")
    data = reliable_checkpoint(data)
    val_rows = data.filter(F.col("is_val"))
    test_x = reliable_checkpoint(learn.assemble(test, feats, roles))
    both = val_rows.select(key, "features", F.lit(True).alias("is_val")).unionByName(
        test_x.select(key, "features", F.lit(False).alias("is_val")))
    fitted, val_scores, test_scores, failed = {}, {}, {}, {}

    def attempt(name, run):
        try:
            scored = reliable_checkpoint(run())
        except Exception as e:  # noqa: BLE001  the run goes on; the table of models says so
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            return
        val_scores[name] = scored.filter("is_val").select(key, *learn.P)
        test_scores[name] = scored.filter("not is_val").select(key, *learn.P)

    def single(m):
        fitted[m] = MODEL_FITS[m](data, len(feats))
        return learn.predict(fitted[m], both, key, keep=["is_val"])

    def stacked():
        # a letter before the key tells fit, validation and test rows apart
        letter = F.when(F.col("is_val"), F.lit("v")).otherwise(F.lit("t"))
        fit_rows = data.filter(~F.col("is_val")).withColumn(key, F.concat(F.lit("f"), key))
        fitted["stacking"], probs = learn.stack(
            fit_rows, both.select(F.concat(letter, key).alias(key), "features"), key, STACK_FITS)
        return probs.select(F.substring(key, 2, 1 << 20).alias(key), (F.substring(key, 1, 1) == "v").alias("is_val"), *learn.P)
    for m in models:
        attempt(m, lambda m=m: single(m))
    if stack:
        attempt("stacking", stacked)
    if not val_scores:
        raise RuntimeError(f"every learner failed: {failed}")
    yv = val_rows.select(key, F.col("label").cast("int").alias("y"))
    bw = reliable_checkpoint(learn.blend_weights(val_scores, yv, key))
    weights = {r["model"]: r["weight"] for r in bw.collect()}
    table = bw.withColumn("failure", F.lit(None).cast("string"))
    if failed:
        table = table.unionByName(bw.sparkSession.createDataFrame(
            [(m, 0.0, 0.0, 0.0, why) for m, why in failed.items()],
            "model string, score double, accuracy double, weight double, failure string"))
    wide = None
    for m, s in test_scores.items():
        s = s.select(key, *[F.col(p).alias(f"{m}_{p}") for p in learn.P])
        wide = s if wide is None else wide.join(s, key)
    only = next(iter(test_scores))
    blended = score.blend(wide, weights) if len(weights) > 1 else wide.select(
        key, *[F.col(f"{only}_{p}").alias(p) for p in learn.P])
    return blended.select(key, *learn.P), table, fitted


def score_chain(probs: DataFrame, key: str = "id") -> DataFrame:
    """Temperature -> confidence blend -> mix correction -> argmax with the
    class-1 / class-0 floors and the class-2 cap -> (ID, support_needs)."""
    p = score.temperature(probs)
    p = score.confidence_blend(p)
    p = score.mix_correction(p)
    lab = score.quota_labels(p, key=key, label="support_needs")
    return lab.select(F.col(key).alias("ID"), F.col("support_needs").cast("int"))


def end_to_end(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES,
               models=tuple(MODEL_FITS), stack: bool = True, clusters: bool = True):
    """Parquet tables -> submission (ID, support_needs) plus the run report."""
    cutoff = profile.seq_cutoff(train, roles)
    ftr, fte, fst = feature_pipeline(train, test, cutoff, roles, clusters=clusters)
    ptr, pte, pst = preprocess(ftr, fte, cutoff, roles)
    probs, bw, _ = train_and_score(ptr, pte, roles, models, stack)
    sub = score_chain(probs, roles.key)
    return sub, bw, (fst, pst)

