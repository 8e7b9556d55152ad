"""Score correction on probability columns (p0, p1, p2): per-model one-hot /
binary expansion, blending, temperature, confidence blend, mix correction,
argmax, label floors / cap and the submission check.

Row maths are single ``select`` expressions. Table-level steps need one small
aggregate (the argmax mix, label counts) and, for the floors and the cap, one
exact top-k per step, done with the distributed row-number helper (ties on
probability broken by key) instead of a global sort in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import argmax3, clip
from ..session import reliable_checkpoint
from . import ranks

P = ("p0", "p1", "p2")


def one_hot(label_col: str, out=P) -> list:
    """Hard label -> one-hot probabilities; out-of-range -> (.33, .34, .33)."""
    y = F.col(label_col)
    ok = y.isin(*C.CLASSES)
    return [F.when(ok, F.when(y == i, 1.0).otherwise(0.0)).otherwise(F.lit(C.ZERO_ROW_PROBS[i])).alias(o)
            for i, o in enumerate(out)]


def binary_expand(score_col: str, out=P) -> list:
    """1-D score s -> (1 - s, s, 0)."""
    s = F.col(score_col).cast("double")
    return [(1 - s).alias(out[0]), s.alias(out[1]), F.lit(0.0).alias(out[2])]


def ensemble_weights(models: list[str], saved: dict | None = None) -> dict | None:
    """Blend weights for the available models: saved weights (unknown model
    0.1) or the default table (unknown model 0.02), renormalised; None when
    fewer than two models are available."""
    if len(models) < 2:
        return None
    if saved:
        w = {m: saved.get(m, C.UNKNOWN_MODEL_WEIGHT_SAVED) for m in models}
    else:
        w = {m: C.DEFAULT_BLEND.get(m, C.UNKNOWN_MODEL_WEIGHT_DEFAULT) for m in models}
    tot = sum(w.values())
    return {m: v / tot for m, v in w.items()} if tot > 0 else w


def blend(df: DataFrame, weights: dict, prefix_fmt: str = "{m}_p{i}", out=P) -> DataFrame:
    """Weighted sum of per-model probability columns, row-normalised; a row
    whose sum is not positive becomes (.33, .34, .33)."""
    sums = [sum(F.lit(float(w)) * F.col(prefix_fmt.format(m=m, i=i)) for m, w in weights.items())
            for i in range(3)]
    tmp = df.select("*", *[s.alias(f"_b{i}") for i, s in enumerate(sums)])
    tot = F.col("_b0") + F.col("_b1") + F.col("_b2")
    return tmp.select(*df.columns, *[
        F.when(tot > 0, F.col(f"_b{i}") / tot).otherwise(F.lit(C.ZERO_ROW_PROBS[i])).alias(o)
        for i, o in enumerate(out)])


def temperature(df: DataFrame, t: float = C.TEMPERATURE, cols=P) -> DataFrame:
    """softmax(ln(clip(p, 1e-7, 1 - 1e-7)) / T) per row."""
    ex = [F.exp(F.log(clip(F.col(c), C.PROB_CLIP, 1 - C.PROB_CLIP)) / F.lit(t)) for c in cols]
    tot = ex[0] + ex[1] + ex[2]
    return df.select(*[(ex[cols.index(c)] / tot).alias(c) if c in cols else F.col(c) for c in df.columns])


def confidence_blend(df: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD,
                     keep: float = C.CONFIDENCE_BLEND, prior=C.PRIOR_MIX, cols=P) -> DataFrame:
    """Rows whose largest probability is below ``threshold`` move toward the
    prior: keep * p + (1 - keep) * prior."""
    low = F.greatest(*[F.col(c) for c in cols]) < threshold

    def one(c):
        i = cols.index(c)
        return F.when(low, F.lit(keep) * F.col(c) + F.lit(1 - keep) * F.lit(prior[i])).otherwise(F.col(c)).alias(c)
    return df.select(*[one(c) if c in cols else F.col(c) for c in df.columns])


def argmax_mix(df: DataFrame, cols=P) -> DataFrame:
    """Share of rows whose argmax is each class: one row (m0, m1, m2, n)."""
    a = argmax3(*cols)
    return df.agg(*[F.avg((a == i).cast("double")).alias(f"m{i}") for i in range(3)],
                  F.count(F.lit(1)).alias("n"))


def mix_factors(mix: DataFrame, prior=C.PRIOR_MIX) -> DataFrame:
    """Correction factors from diff = prior - current mix (one row f0, f1, f2)."""
    d = [F.lit(prior[i]) - F.col(f"m{i}") for i in range(3)]
    (t00, f00), (t01, f01) = C.MIX_STEPS[0]
    (t20, f20), (t21, f21) = C.MIX_STEPS[2]
    (t10, f10), (t11, f11) = C.MIX_STEPS[1]
    f0 = F.when(d[0] > t00, f00).when(d[0] > t01, f01).otherwise(1.0)
    f2 = F.when(d[2] < t20, f20).when(d[2] < t21, f21).otherwise(1.0)
    f1 = F.when(d[1] > t10, f10).when(d[1] < t11, f11).otherwise(1.0)
    return mix.select(f0.alias("f0"), f1.alias("f1"), f2.alias("f2"))


def apply_factors(df: DataFrame, factors: DataFrame, cols=P) -> DataFrame:
    """Multiply by per-class factors (a one-row table, broadcast) and
    renormalise; a row summing to 0 stays as it is."""
    j = df.crossJoin(F.broadcast(factors))
    adj = [F.col(c) * F.col(f"f{i}") for i, c in enumerate(cols)]
    tot = adj[0] + adj[1] + adj[2]
    return j.select(*[F.when(tot > 0, adj[cols.index(c)] / tot).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def mix_correction(df: DataFrame, prior=C.PRIOR_MIX, cols=P) -> DataFrame:
    return apply_factors(df, mix_factors(argmax_mix(df, cols), prior), cols)


def fixed_factors(df: DataFrame, factors=C.BASELINE_FACTORS, cols=P) -> DataFrame:
    """Baseline path: fixed factors (1.15, 1.05, .92), renormalised."""
    f = df.sparkSession.range(1).select(*[F.lit(float(v)).alias(f"f{i}") for i, v in enumerate(factors)])
    return apply_factors(df, f, cols)


def with_label(df: DataFrame, out: str = "label", cols=P) -> DataFrame:
    return df.withColumn(out, argmax3(*cols))


def _counts(df: DataFrame, label: str) -> dict:
    r = df.agg(*[F.count_if(F.col(label) == i).alias(f"c{i}") for i in range(3)],
               F.count(F.lit(1)).alias("n")).first()
    return {k: int(r[k] or 0) for k in ("c0", "c1", "c2", "n")}


#: Bins of one pass of the search for a k-th value.
BINS = 4096


def _first_k(cand: DataFrame, x, key: str, k: int):
    """A condition on ``x`` and ``key`` that holds for the first ``k`` rows of ``cand`` by both, and
    for no others of them; None where x has missing values.

    The k-th value is found by counting: each pass counts the rows of the range that is
    left in ``BINS`` bins and goes on with the bin that holds the k-th, until that is one
    value. Only if a part of that value's rows is wanted, these alone are ordered by key."""
    r = cand.agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull() | F.isnan(x)).alias("bad"),
                 F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if r["n"] <= k:
        return F.lit(True)
    if r["bad"]:
        return None
    lo, hi, ahead, here = r["lo"], r["hi"], 0, r["n"]
    while lo < hi:
        at = F.least(F.lit(BINS - 1), F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BINS))
        bins = (cand.where((x >= F.lit(lo)) & (x <= F.lit(hi))).groupBy(at.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect())
        for b in sorted(bins, key=lambda b: b["b"]):
            if ahead + b["n"] >= k:
                break
            ahead += b["n"]
        lo, hi, here = b["lo"], b["hi"], b["n"]
    if ahead + here == k:
        return x <= F.lit(lo)
    same = ranks.global_row_number(cand.where(x == F.lit(lo)).select(key), [F.col(key)], "_r")
    last = same.where(F.col("_r") == k - ahead).first()[key]
    return (x < F.lit(lo)) | ((x == F.lit(lo)) & (F.col(key) <= F.lit(last)))


def _relabel_top(df: DataFrame, key: str, label: str, prob: str, eligible, k: int, new_label,
                 ascending: bool = False) -> DataFrame:
    """Set ``label`` to ``new_label`` on the k eligible rows with the highest
    (or lowest) ``prob``; ties broken by key. k <= 0 changes nothing."""
    if k <= 0:
        return df
    cand = df.filter(eligible).select(key, prob)
    nl = new_label if not isinstance(new_label, (int, float)) else F.lit(new_label)
    first = _first_k(cand, F.col(prob) if ascending else -F.col(prob), key, k)
    if first is not None:
        return df.withColumn(label, F.when(eligible & first, nl).otherwise(F.col(label)))
    # missing probabilities: by the order of all candidates
    order = [F.col(prob).asc() if ascending else F.col(prob).desc(), F.col(key)]
    picked = ranks.global_row_number(cand, order, "_r").filter(F.col("_r") <= k).select(key, F.lit(1).alias("_pick"))
    j = df.join(picked, key, "left")
    return j.withColumn(label, F.when(F.col("_pick") == 1, nl).otherwise(F.col(label))).drop("_pick")


def quota_labels(df: DataFrame, key: str = "id", label: str = "label", cols=P, mode: str = "exact",
                 floor1: float = C.FLOOR_CLASS1, floor0: float = C.FLOOR_CLASS0,
                 cap2: float = C.CAP_CLASS2) -> DataFrame:
    """Argmax labels, then: class-1 floor (25 %: the top ``int(.25 n) - c1``
    rows by p1 become 1), class-0 floor (42 %, shortfall from the counts
    before the first step, picked among rows not labelled 1), class-2 cap (30 %:
    the lowest-p2 excess of class 2 moves to the larger of p0 / p1).

    ``mode='exact'`` picks only rows that do not already carry the target
    label, so the floor is reached; ``'as_observed'`` picks from all eligible
    rows, as the original did, and may fall short.
    """
    p0, p1, p2 = cols
    # every step counts and searches the rows again, so their plan is cut once
    out = reliable_checkpoint(with_label(df, label, cols))
    c = _counts(out, label)
    n = c["n"]
    if c["c1"] < n * floor1:
        need = int(n * floor1) - c["c1"]
        elig = (F.col(label) != 1) if mode == "exact" else F.lit(True)
        out = _relabel_top(out, key, label, p1, elig, need, 1)
    if c["c0"] < n * floor0:
        need = int(n * floor0) - c["c0"]
        elig = (F.col(label) == 2) if mode == "exact" else (F.col(label) != 1)
        out = _relabel_top(out, key, label, p0, elig, need, 0)
    out = class_cap(out, key, label, cols, cap2, relabel=False)
    return out


def class_cap(df: DataFrame, key: str = "id", label: str = "label", cols=P, cap2: float = C.CAP_CLASS2,
              relabel: bool = True) -> DataFrame:
    """Class-2 cap: if more than ``cap2`` of rows are class 2, the
    ``c2 - int(cap2 n)`` class-2 rows with the lowest p2 take the larger of
    p0 / p1 (p0 on ties)."""
    p0, p1, p2 = cols
    out = with_label(df, label, cols) if relabel else df
    c = _counts(out, label)
    n = c["n"]
    if c["c2"] > n * cap2:
        excess = c["c2"] - int(n * cap2)
        alt = F.when(F.col(p0) >= F.col(p1), F.lit(0)).otherwise(F.lit(1))
        out = _relabel_top(out, key, label, p2, F.col(label) == 2, excess, alt, ascending=True)
    return out


def baseline_floors(df: DataFrame, key: str = "id", label: str = "label", cols=P,
                    floor0: float = C.BASELINE_FLOOR0, floor1: float = C.BASELINE_FLOOR1) -> DataFrame:
    """Baseline path: if class 0 is under 40 % the top floor(.40 n) rows by p0
    become 0; then if class 1 (counted before) is under 22 % the top
    floor(.22 n) rows by p1 become 1 (whole share, not the shortfall)."""
    out = with_label(df, label, cols)
    c = _counts(out, label)
    n = c["n"]
    if c["c0"] < n * floor0:
        out = _relabel_top(out, key, label, cols[0], F.lit(True), int(n * floor0), 0)
    if c["c1"] < n * floor1:
        out = _relabel_top(out, key, label, cols[1], F.lit(True), int(n * floor1), 1)
    return out


def submission_check(df: DataFrame, key: str = "ID", label: str = "support_needs") -> DataFrame:
    """One row: required columns present, integer label type, labels within
    {0,1,2}, no NULLs, at least two classes, and the overall verdict."""
    has = key in df.columns and label in df.columns
    spark = df.sparkSession
    if not has:
        return spark.createDataFrame([(False, False, False, False, 0, False)],
                                     "has_columns boolean, integer_label boolean, labels_valid boolean, "
                                     "no_nulls boolean, n_classes long, valid boolean")
    is_int = dict(df.dtypes)[label] in ("int", "bigint", "smallint", "tinyint")
    y = F.col(label).cast("bigint")
    r = df.agg(F.count_if(y.isNotNull() & ~y.isin(*C.CLASSES)).alias("bad"),
               F.count_if(F.col(key).isNull() | F.col(label).isNull()).alias("nulls"),
               F.count_distinct(y).alias("n_classes"))
    return r.select(F.lit(True).alias("has_columns"), F.lit(is_int).alias("integer_label"),
                    (F.col("bad") == 0).alias("labels_valid"), (F.col("nulls") == 0).alias("no_nulls"),
                    "n_classes",
                    ((F.col("bad") == 0) & (F.col("nulls") == 0) & (F.col("n_classes") >= 2)).alias("valid"))


def prior_labels(df: DataFrame, key: str = "id", seed: int = C.SEED, prior=C.PRIOR_SAMPLING,
                 out: str = "support_needs") -> DataFrame:
    """Baseline labels drawn from the prior mix: u = first 32 bits of
    md5(seed || key) / 2^32, class = first cumulative threshold above u."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    t0, t1 = prior[0], prior[0] + prior[1]
    return df.select(key, F.when(u < t0, 0).when(u < t1, 1).otherwise(2).alias(out))
