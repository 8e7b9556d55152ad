"""Derived feature families: suspect transforms, temporal position / quantile
bins, business ratios, statistical transforms, pair interactions and the
baseline ratios. Row-local families are one ``select`` each (whole-stage
codegen); the ones that need table statistics (z-score, position, quantile
bins, percent rank, suspect clip) compute them in one aggregation and apply
them as literals or a broadcast join.

Statistics are per table (``by=['split']``, as observed). ``src`` names the
frame the statistics are fitted on (default: the input itself); pipelines
pass their narrow checkpointed base so that fitting never re-executes the
upstream feature families.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_ROLES, Roles
from ..functions.exprs import clean_num, clip, parse_seq_or_zero, safe_div
from . import ranks


# ---------------------------------------------------------------- suspect column
def suspect_bounds(train: DataFrame, col: str, q=C.SUSPECT_CLIP_Q) -> tuple[float, float]:
    v = train.select(clean_num(col).alias("v"), F.lit(1).alias("g"))
    qm = ranks.quantile_map(v, ["g"], "v", list(q))
    lo, hi = qm.get(1, [0.0, 0.0])
    return lo, hi


def suspect_features(df: DataFrame, col: str, bounds: tuple[float, float]) -> DataFrame:
    """``x_log = log1p|x|``, ``x_sqrt = sqrt|x|`` and ``x_clipped`` (train
    quantile bounds), NULL read as 0."""
    v = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    lo, hi = bounds
    return df.select("*", F.log1p(F.abs(v)).alias(f"{col}_log"), F.sqrt(F.abs(v)).alias(f"{col}_sqrt"),
                     F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))).alias(f"{col}_clipped"))


# ---------------------------------------------------------------- temporal
def qcut_edges(values: DataFrame, col: str, q: int, by: list[str] | None = None) -> DataFrame:
    """Distinct interior quantile edges for ``qcut(q)`` per group: (by..., edges)."""
    by = by or []
    probs = [i / q for i in range(1, q)]
    g = by or ["_g"]
    v = values if by else values.withColumn("_g", F.lit(1))
    qs = ranks.exact_quantiles(v, g, col, probs)
    return qs.groupBy(*g).agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))


def temporal_features(df: DataFrame, roles: Roles = DEFAULT_ROLES, by: list[str] | None = None,
                      src: DataFrame | None = None) -> DataFrame:
    """``temporal_id`` (parsed key, 0 if unparseable), ``temporal_position``
    (min-max scaled, 0.5 without range) and right-closed quantile bins
    ``temporal_quartile`` / ``temporal_decile`` (duplicate edges dropped;
    1 and 5 without range). Statistics are per table, or per ``by`` group."""
    by = by or []
    g = by or ["_g"]
    t = df.withColumn("temporal_id", parse_seq_or_zero(roles.key))
    s0 = (src if src is not None else df).select(*by, parse_seq_or_zero(roles.key).alias("temporal_id"))
    if not by:
        t = t.withColumn("_g", F.lit(1))
        s0 = s0.withColumn("_g", F.lit(1))
    mm = s0.groupBy(*g).agg(F.min("temporal_id").alias("_mn"), F.max("temporal_id").alias("_mx"))
    e4 = qcut_edges(s0, "temporal_id", 4, g).withColumnRenamed("edges", "_e4")
    e10 = qcut_edges(s0, "temporal_id", 10, g).withColumnRenamed("edges", "_e10")
    # statistic tables: one row per table/group -> broadcast
    st = mm.join(e4, g).join(e10, g)
    x = F.col("temporal_id")
    rng = F.col("_mx") > F.col("_mn")

    def bins(e):
        return F.aggregate(F.col(e), F.lit(0),
                           lambda acc, v: acc + ((x > v) & (v > F.col("_mn"))).cast("int")).cast("bigint")

    # qcut bins are right-closed and the lowest one includes the minimum: bin =
    # number of distinct edges strictly between the minimum and the value
    out = (t.join(F.broadcast(st), g)
           .withColumn("temporal_position",
                       F.when(rng, (x - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(F.lit(0.5)))
           .withColumn("temporal_quartile", F.when(rng, bins("_e4")).otherwise(F.lit(1).cast("bigint")))
           .withColumn("temporal_decile", F.when(rng, bins("_e10")).otherwise(F.lit(5).cast("bigint")))
           .drop("_mn", "_mx", "_e4", "_e10"))
    return out.drop("_g") if not by else out


# ---------------------------------------------------------------- business
def business_features(df: DataFrame) -> DataFrame:
    """Customer value / stability / activity, payment stability / frequency /
    risk, usage intensity / monthly usage / trend, age group / risk / square /
    log. Inputs are cleaned (NULL, NaN, inf -> 0) first, as observed."""
    t = clip(clean_num("tenure"), 1, 2000)
    f = clip(clean_num("frequent"), 1, 200)
    cl = clip(clean_num("contract_length"), 1, 1000)
    p = clip(clean_num("payment_interval"), 1, 365)
    f2 = clip(clean_num("frequent"), 0.1, 200)
    a = clip(clean_num("age"), 18, 100)
    b = C.AGE_BINS
    age_group = (F.when(a <= b[0], 0).when(a <= b[1], 1).when(a <= b[2], 2)
                 .when(a <= b[3], 3).when(a <= b[4], 4).otherwise(2))
    young, old = C.AGE_YOUNG, C.AGE_OLD
    ry, ro, rm = C.AGE_RISK
    return df.select(
        "*",
        clip(F.log1p(t) * F.sqrt(f) * F.cbrt(cl), 0, 200).alias("customer_value"),
        clip(t * cl / (f + 1), 0, 10000).alias("customer_stability"),
        clip(f * 30 / (t + 1), 0, 100).alias("customer_activity"),
        clip(cl / p, 0, 50).alias("payment_stability"),
        clip(F.lit(365.0) / p, 0, 365).alias("payment_frequency"),
        clip(p / (cl + 1), 0, 10).alias("payment_risk"),
        clip(f2 / (t / 30 + 1), 0, 100).alias("usage_intensity"),
        clip(f2 / (t / 30 + 1) * 30, 0, 300).alias("monthly_usage"),
        clip(f2 / (F.sqrt(t) + 1), 0, 50).alias("usage_trend"),
        age_group.cast("int").alias("age_group"),
        F.when(a < young, ry).when(a > old, ro).otherwise(rm).alias("age_risk"),
    )


# ---------------------------------------------------------------- statistical
def _stat_value(c):
    return clip(clean_num(c), *C.STAT_CLIP)


def stat_features(df: DataFrame, cols: list[str] = C.NUMERIC, by: list[str] | None = None,
                  with_rank: bool = True, src: DataFrame | None = None) -> DataFrame:
    """Per column v = clip(clean(x), 0, 10000): ``_log`` (log1p), ``_sqrt``,
    ``_rank`` (average-tie percent rank), ``_zscore`` (sample std; 0 when the
    std is 0), ``_squared``, ``_cubed``. Rank and z-score statistics are per
    table (or ``by`` group)."""
    by = by or []
    g = by or ["_g"]
    t = df if by else df.withColumn("_g", F.lit(1))
    s0 = src if src is not None else df
    s0 = s0 if by else s0.withColumn("_g", F.lit(1))
    st = s0.groupBy(*g).agg(*[x for c in cols for x in (
        F.avg(_stat_value(c)).alias(f"_m_{c}"), F.stddev_samp(_stat_value(c)).alias(f"_s_{c}"))])
    t = t.join(F.broadcast(st), g)
    sel = ["*"]
    for c in cols:
        v = _stat_value(c)
        s = F.col(f"_s_{c}")
        sel += [F.log1p(v).alias(f"{c}_log"), F.sqrt(v).alias(f"{c}_sqrt"),
                F.when(s > 0, (v - F.col(f"_m_{c}")) / s).otherwise(F.lit(0.0)).alias(f"{c}_zscore"),
                (v * v).alias(f"{c}_squared"), (v * v * v).alias(f"{c}_cubed")]
    out = t.select(*sel).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
    if with_rank:
        out = pct_rank(out, cols, g, value_fn=_stat_value, src=s0)
    return out.drop("_g") if not by else out


def pct_rank(df: DataFrame, cols: list[str], by: list[str], value_fn=None, suffix: str = "_rank",
             src: DataFrame | None = None) -> DataFrame:
    """Average-tie percent rank (rank / n, ties get the mean of their ranks)
    per column within ``by`` groups.

    All columns go through one (by, feature, value) -> count table and one
    prefix sum over its distinct values; each column then joins back by value.
    A hot value is one row of the value-count table, so no task sees more than
    its share; the rank tables are joined without a hint, so Spark broadcasts one
    only if its bytes, known at run time, are few."""
    value_fn = value_fn or (lambda c: F.col(c))
    if not cols:
        return df
    long = (src if src is not None else df).select(*by, *[value_fn(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(by), list(cols), "_feat", "_v")
    vc = long.groupBy(*by, "_feat", "_v").agg(F.count(F.lit(1)).alias("_c"))
    grp = [*by, "_feat"]
    ndv = ranks.max_ndv(vc, grp, "_v")
    small = ndv <= ranks.SMALL_NDV
    cum = ranks.cumulative_counts(vc, grp, "_v", ["_c"], small)
    n = vc.groupBy(*grp).agg(F.sum("_c").alias("_n"))
    rk = (cum.join(F.broadcast(n), grp)
          .select(*grp, "_v", ((F.col("_c_before") + (F.col("_c") + 1) / 2.0) / F.col("_n")).alias("_rk")))
    out = df
    for c in cols:
        r = rk.filter(F.col("_feat") == c).select(*by, "_v", F.col("_rk").alias(c + suffix))
        out = out.withColumn("_v", value_fn(c).cast("double")).join(r, [*by, "_v"], "left").drop("_v")
    return out


# ---------------------------------------------------------------- interactions
def interaction_features(df: DataFrame, pairs=C.INTERACTION_PAIRS) -> DataFrame:
    """For each pair a, b = clip(clean(.), 0, 2000): ratio a/b (b = 0 -> 1)
    clipped to [0, 100], product clipped to [0, 100000], |a - b|, a + b."""
    sel = ["*"]
    for x, y in pairs:
        a = clip(clean_num(x), *C.PAIR_CLIP)
        b = clip(clean_num(y), *C.PAIR_CLIP)
        bs = F.when(b == 0, F.lit(1.0)).otherwise(b)
        sel += [clip(a / bs, 0, 100).alias(f"{x}_{y}_ratio"),
                clip(a * b, 0, 100000).alias(f"{x}_{y}_product"),
                F.abs(a - b).alias(f"{x}_{y}_diff"), (a + b).alias(f"{x}_{y}_sum")]
    return df.select(*sel)


def baseline_ratios(df: DataFrame) -> DataFrame:
    """The small baseline's two ratios on raw values: age / (tenure + 1) and
    frequent / (payment_interval + 1) (NULL propagates)."""
    return df.select("*",
                     safe_div(F.col("age"), F.col("tenure") + 1, None).alias("age_tenure_ratio"),
                     safe_div(F.col("frequent"), F.col("payment_interval") + 1, None)
                     .alias("frequency_payment_ratio"))
