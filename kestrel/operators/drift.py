"""Train/test drift: PSI, two-sample KS, moments, the per-feature stability
verdict, the chi-square homogeneity test on categories and category shares.

All numeric tests run on one long frame (table, feature, value) so every
feature is handled by the same aggregation instead of a loop of scans.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.exprs import nan_to_null, r6
from ..functions.special import chi2_sf, ks_sf
from . import ranks

TRAIN, TEST = "train", "test"


def tagged_long(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """(t, feature, value) for both tables, NaN/inf normalised to NULL and NULLs
    dropped (the tests compare observed values only)."""
    def one(df, tag):
        return (df.select(F.lit(tag).alias("t"), *[nan_to_null(c).alias(c) for c in cols])
                .unpivot(["t"], list(cols), "feature", "value"))
    return one(train, TRAIN).unionByName(one(test, TEST)).filter(F.col("value").isNotNull())


def _basic_stats(long: DataFrame) -> dict:
    """One tiny aggregate: per feature n_train, n_test, min, max, approx ndv.
    (#features rows -> driver-side fitted state.)"""
    rows = long.groupBy("feature").agg(
        F.count_if(F.col("t") == TRAIN).alias("n1"), F.count_if(F.col("t") == TEST).alias("n2"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.approx_count_distinct("value", 0.05).alias("ndv")).collect()
    return {r["feature"]: r.asDict() for r in rows}


def psi(train: DataFrame, test: DataFrame, cols: list[str], bins: int = C.PSI_BINS,
        stats: dict | None = None) -> DataFrame:
    """Population stability index per feature.

    Equal-width bins over the joint [min, max] (edge i = min + i*(max-min)/bins,
    the last bin closed), +1 smoothing (h+1)/(n+bins), sum (q-p) ln(q/p) with p
    the train share. 0 when min = max or the train table has no value. Empty bins
    still contribute: counts are joined to a full (feature x bin) spine.
    """
    long = tagged_long(train, test, cols)
    st = stats or _basic_stats(long)
    spark = long.sparkSession
    feats = [c for c in cols if c in st]
    if not feats:
        return spark.createDataFrame([], "feature string, psi double")
    # per-feature bin index with the bounds as literals
    bin_expr = None
    for f in feats:
        lo, hi = float(st[f]["lo"]), float(st[f]["hi"])
        step = (hi - lo) / bins
        b = sum((F.col("value") >= F.lit(lo + i * step)).cast("int") for i in range(1, bins)) \
            if hi > lo else F.lit(0)
        bin_expr = (F.when(F.col("feature") == f, b) if bin_expr is None
                    else bin_expr.when(F.col("feature") == f, b))
    hist = (long.withColumn("bin", bin_expr)
            .groupBy("feature", "bin")
            .agg(F.count_if(F.col("t") == TRAIN).alias("h1"),
                 F.count_if(F.col("t") == TEST).alias("h2")))
    meta = spark.createDataFrame(
        [(f, int(st[f]["n1"]), int(st[f]["n2"]), bool(st[f]["hi"] > st[f]["lo"])) for f in feats],
        "feature string, n1 long, n2 long, has_range boolean")
    spine = meta.crossJoin(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    j = spine.join(hist, ["feature", "bin"], "left").fillna(0, ["h1", "h2"])
    p = (F.col("h1") + 1) / (F.col("n1") + bins)
    q = (F.col("h2") + 1) / (F.col("n2") + bins)
    out = (j.groupBy("feature", "n1", "has_range")
           .agg(F.sum((q - p) * F.log(q / p)).alias("s"))
           .select("feature", F.when(F.col("has_range") & (F.col("n1") > 0), F.col("s"))
                   .otherwise(F.lit(0.0)).alias("psi")))
    return out


def ks(train: DataFrame, test: DataFrame, cols: list[str], stats: dict | None = None, with_p: bool = False) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic D = max |F_train - F_test| per
    feature, on (value, count) pairs so a hot value is a single row; ``with_p`` adds
    its asymptotic p-value."""
    long = tagged_long(train, test, cols)
    st = stats or _basic_stats(long)
    spark = long.sparkSession
    vc = long.groupBy("feature", "value").agg(
        F.count_if(F.col("t") == TRAIN).alias("c1"), F.count_if(F.col("t") == TEST).alias("c2"))
    small = max([st[f]["ndv"] for f in st] or [0]) <= ranks.SMALL_NDV
    cum = ranks.cumulative_counts(vc, ["feature"], "value", ["c1", "c2"], small)
    meta = spark.createDataFrame([(f, int(st[f]["n1"]), int(st[f]["n2"])) for f in st],
                                 "feature string, n1 long, n2 long")
    d = F.abs((F.col("c1_before") + F.col("c1")) / F.col("n1")
              - (F.col("c2_before") + F.col("c2")) / F.col("n2"))
    both = cum.join(F.broadcast(meta), "feature").filter((F.col("n1") > 0) & (F.col("n2") > 0))
    if not with_p:
        return both.groupBy("feature").agg(F.max(d).alias("ks"))
    return (both.groupBy("feature", "n1", "n2").agg(F.max(d).alias("ks"))
            .select("feature", "ks", ks_sf(F.col("ks"), F.col("n1"), F.col("n2")).alias("p_value")))


def ks_pvalue(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p-value of the KS statistic (Kolmogorov series)."""
    if n1 == 0 or n2 == 0:
        return float("nan")
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = d * en
    if lam < 1e-3:
        return 1.0
    s = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return max(0.0, min(1.0, 2.0 * s))


def moments(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, sample std, median, q25, q75 and count per (feature, table) in one
    aggregation plus one exact-quantile pass."""
    long = tagged_long(train, test, cols)
    base = long.groupBy("feature", "t").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"))
    q = ranks.exact_quantiles(long, ["feature", "t"], "value", [0.5, 0.25, 0.75])
    qw = q.groupBy("feature", "t").agg(
        *[F.max(F.when(F.col("pidx") == i, F.col("q"))).alias(n)
          for i, n in enumerate(["median", "q25", "q75"])])
    return base.join(qw, ["feature", "t"], "left").withColumnRenamed("t", "split")


def stability_report(train: DataFrame, test: DataFrame, cols: list[str],
                     min_rows: int = C.STABILITY_MIN_ROWS) -> DataFrame:
    """Per feature with more than ``min_rows`` observed values in both tables:
    KS, PSI and the verdict ``ks < .12 and psi < .20``."""
    long = tagged_long(train, test, cols)
    st = _basic_stats(long)
    keep = [f for f in cols if f in st and st[f]["n1"] > min_rows and st[f]["n2"] > min_rows]
    spark = long.sparkSession
    if not keep:
        return spark.createDataFrame(
            [], "feature string, n_train long, n_test long, ks double, psi double, is_stable boolean")
    sub = {f: st[f] for f in keep}
    k = ks(train, test, keep, stats=sub)
    p = psi(train, test, keep, stats=sub)
    meta = spark.createDataFrame([(f, int(st[f]["n1"]), int(st[f]["n2"])) for f in keep],
                                 "feature string, n_train long, n_test long")
    return (meta.join(k, "feature").join(p, "feature")
            .withColumn("is_stable", (F.col("ks") < C.KS_STABLE) & (F.col("psi") < C.PSI_STABLE)))


def category_mix(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Share of each observed category per table; the denominator counts every
    row of the table, NULLs included."""
    def one(df, tag):
        return df.select(F.lit(tag).alias("split"), *[F.col(c).cast("string") for c in cols]) \
            .unpivot(["split"], list(cols), "feature", "category")
    long = one(train, TRAIN).unionByName(one(test, TEST))
    tot = long.groupBy("split", "feature").agg(F.count(F.lit(1)).alias("n"))
    cnt = long.filter(F.col("category").isNotNull()).groupBy("split", "feature", "category") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    return cnt.join(F.broadcast(tot), ["split", "feature"]) \
        .select("split", "feature", "category", "cnt", (F.col("cnt") / F.col("n")).alias("share"))


def chi2_pvalue(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (closed forms by parity)."""
    if dof <= 0 or x is None or math.isnan(x):
        return float("nan")
    h = x / 2.0
    if dof % 2 == 0:
        term, s = 1.0, 1.0
        for j in range(1, dof // 2):
            term *= h / j
            s += term
        return math.exp(-h) * s
    s = math.erfc(math.sqrt(h))
    if dof > 1:
        term = math.sqrt(h) / math.gamma(1.5)
        acc = term
        for j in range(2, (dof + 1) // 2):
            term *= h / (j - 0.5)
            acc += term
        s += math.exp(-h) * acc
    return s


def chi2_drift(train: DataFrame, test: DataFrame, cols: list[str], with_p: bool = True,
               correction: bool = True) -> DataFrame:
    """Chi-square homogeneity test of train vs test counts over the categories
    seen in both tables (needs at least two). A 2 x 2 table gets Yates'
    continuity correction, capped at the observed-expected gap."""
    def one(df, tag):
        return df.select(F.lit(tag).alias("t"), *[F.col(c).cast("string") for c in cols]) \
            .unpivot(["t"], list(cols), "feature", "category")
    long = one(train, TRAIN).unionByName(one(test, TEST)).filter(F.col("category").isNotNull())
    cnt = long.groupBy("feature", "category").agg(
        F.count_if(F.col("t") == TRAIN).alias("o1"), F.count_if(F.col("t") == TEST).alias("o2"))
    common = cnt.filter((F.col("o1") > 0) & (F.col("o2") > 0))
    tot = common.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("o1").alias("r1"), F.sum("o2").alias("r2"))
    j = common.join(tot, "feature").filter(F.col("k") > 1)
    n = F.col("r1") + F.col("r2")
    col_tot = F.col("o1") + F.col("o2")

    def cell(o, r):
        e = F.col(r) * col_tot / n
        diff = e - F.col(o)
        yates = F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)
        adj = F.col(o) + (F.when(F.col("k") == 2, yates).otherwise(F.lit(0.0)) if correction else F.lit(0.0))
        return (adj - e) * (adj - e) / e

    out = (j.groupBy("feature").agg(F.first("k").alias("n_common"),
                                    F.sum(cell("o1", "r1") + cell("o2", "r2")).alias("chi2"))
           .withColumn("dof", (F.col("n_common") - 1).cast("bigint")))
    if not with_p:
        return out

    return (out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof")))
            .withColumn("is_stable", F.col("p_value") > C.CHI2_STABLE_P))


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (oracle comparison precision)."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])
