"""Profiling, integrity and leakage checks over a labelled table.

Each function is one (or a few) aggregations over the whole table; verdicts are
column predicates over the statistic rows, never driver loops over data.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_ROLES, Roles
from ..functions.exprs import clean_num, nan_to_null, parse_seq, parse_seq_or_zero, safe_corr
from . import ranks


# ---------------------------------------------------------------- label mix
def class_mix(train: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Count and share per observed label; the share's denominator counts every
    row (NULL labels included); imbalance = max count / min count."""
    y = roles.label
    tot = train.agg(F.count(F.lit(1)).alias("total"))
    cnt = train.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("cnt"))
    ext = cnt.agg(F.max("cnt").alias("mx"), F.min("cnt").alias("mn"))
    return (cnt.crossJoin(tot).crossJoin(ext)
            .select(F.col(y).alias("label"), "cnt", (F.col("cnt") / F.col("total")).alias("share"),
                    F.when(F.col("mn") > 0, F.col("mx") / F.col("mn")).otherwise(F.lit(0.0))
                    .alias("imbalance_ratio"), "total"))


# ---------------------------------------------------------------- sequence
def seq_profile(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES,
                pct: float = C.SEQ_CUTOFF_PCT) -> DataFrame:
    """Sequence range of both tables (keys that do not parse are skipped), the
    cut-off int(p85 of train seq) and the share of train rows after it."""
    s1 = train.select(parse_seq(roles.key).alias("seq")).filter(F.col("seq").isNotNull())
    s2 = test.select(parse_seq(roles.key).alias("seq")).filter(F.col("seq").isNotNull())
    q = ranks.exact_quantiles(s1.withColumn("g", F.lit(1)), ["g"], "seq", [pct]) \
        .select(F.floor("q").cast("bigint").alias("cutoff"))
    a = s1.agg(F.min("seq").alias("train_min"), F.max("seq").alias("train_max"),
               F.count(F.lit(1)).alias("n_train"))
    b = s2.agg(F.min("seq").alias("test_min"), F.max("seq").alias("test_max"))
    after = s1.crossJoin(F.broadcast(q)).agg(
        F.count_if(F.col("seq") > F.col("cutoff")).alias("n_after"))
    return (a.crossJoin(b).crossJoin(q).crossJoin(after)
            .select("train_min", "train_max", "test_min", "test_max", "cutoff",
                    (F.col("n_after") / F.col("n_train")).alias("share_after_cutoff")))


def seq_cutoff(train: DataFrame, roles: Roles = DEFAULT_ROLES, pct: float = C.SEQ_CUTOFF_PCT) -> int | None:
    s1 = train.select(parse_seq(roles.key).alias("seq")).filter(F.col("seq").isNotNull())
    r = ranks.exact_quantiles(s1.withColumn("g", F.lit(1)), ["g"], "seq", [pct]).first()
    return None if r is None else int(math.floor(r["q"]))


def time_filter(train: DataFrame, cutoff: int | None, roles: Roles = DEFAULT_ROLES,
                max_removal: float = C.FILTER_MAX_REMOVAL, fallback_pct: float = C.FILTER_FALLBACK_PCT,
                min_kept: int = C.FILTER_MIN_KEPT) -> DataFrame:
    """Keep rows whose sequence (unparseable -> 0) is <= cutoff; if that removes
    more than 6 % keep <= p95 instead; if at most 9 500 rows remain keep all.
    Two small aggregates decide the threshold; the result is a plain filter."""
    if cutoff is None:
        return train
    s = parse_seq_or_zero(roles.key)
    st = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(s <= F.lit(int(cutoff))).alias("k")).first()
    n, kept = int(st["n"]), int(st["k"] or 0)
    thr = float(cutoff)
    if n and 1 - kept / n > max_removal:
        q = ranks.exact_quantiles(train.select(s.alias("seq"), F.lit(1).alias("g")), ["g"], "seq",
                                  [fallback_pct]).first()
        thr = float(q["q"])
        kept = train.filter(s <= F.lit(thr)).count()
    return train.filter(s <= F.lit(thr)) if kept > min_kept else train


# ---------------------------------------------------------------- class statistics
def class_stats(train: DataFrame, col: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Mean, sample std and count of ``col`` per class (NULL values dropped)."""
    y = roles.label
    x = nan_to_null(col)
    return (train.filter(F.col(y).isin(*C.CLASSES) & x.isNotNull())
            .groupBy(F.col(y).alias("label"))
            .agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                 F.count(F.lit(1)).alias("n")))


def label_corr(train: DataFrame, cols: list[str], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Pearson correlation of each column with the label, pairwise complete,
    all columns in one aggregation."""
    y = F.col(roles.label).cast("double")
    row = train.agg(*[safe_corr(nan_to_null(c), y).alias(c) for c in cols])
    return row.unpivot([], list(cols), "feature", "corr") \
        .select("feature", nan_to_null("corr").alias("corr"))


def _betai(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betai(b, a, 1 - x)
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = (m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -((a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = tiny if abs(d) < tiny else d
        d = 1.0 / d
        c = 1.0 + num / c
        c = tiny if abs(c) < tiny else c
        cd = c * d
        f *= cd
        if abs(1.0 - cd) < 1e-15:
            break
    return front * (f - 1.0) / a


def f_pvalue(f: float | None, d1: int, d2: int) -> float | None:
    """Upper tail of the F distribution; closed form for d1 = 2."""
    if f is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return None
    if f <= 0:
        return 1.0
    if d1 == 2:
        return (d2 / (d2 + 2.0 * f)) ** (d2 / 2.0)
    return _betai(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def anova(train: DataFrame, col: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """One-way ANOVA of ``col`` across classes: F, degrees of freedom and p.
    One pass of count / mean / population variance per class."""
    x = nan_to_null(col)
    y = roles.label
    per = (train.filter(F.col(y).isin(*C.CLASSES) & x.isNotNull())
           .groupBy(F.col(y).alias("label"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")))
    g = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all"),
                (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    j = per.crossJoin(g)
    agg = j.groupBy("k", "n_all").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    d1 = F.col("k") - 1
    d2 = F.col("n_all") - F.col("k")
    fstat = F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2)
    out = agg.select(F.lit(col).alias("feature"), fstat.alias("f_stat"),
                     d1.cast("bigint").alias("df_between"), d2.cast("bigint").alias("df_within"))
    return out.withColumn("p_value", _fp_udf()("f_stat", "df_between", "df_within"))


def _fp_udf():
    @F.pandas_udf("double")
    def fp(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_pvalue(None if pd.isna(x) else float(x), int(p), int(q))
                          for x, p, q in zip(f, a, b)], dtype="float64")
    return fp


# ---------------------------------------------------------------- mutual information
def mutual_info(train: DataFrame, cols: list[str], roles: Roles = DEFAULT_ROLES,
                bins: int = 10) -> DataFrame:
    """Mutual information (nats) between each feature and the label.

    Features are NULL->0 filled (as observed), cut at their distinct exact
    decile edges (bin = number of edges strictly below the value), and the
    plug-in estimate sum p(b,y) ln(p(b,y) / (p(b) p(y))) is taken over the
    (feature, bin, label) counts: one aggregation for every feature.
    """
    y = roles.label
    long = (train.filter(F.col(y).isNotNull())
            .select(F.col(y).alias("y"), *[clean_num(c).alias(c) for c in cols])
            .unpivot(["y"], list(cols), "feature", "value"))
    probs = [i / bins for i in range(1, bins)]
    q = ranks.exact_quantiles(long, ["feature"], "value", probs)
    edges = q.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))
    # edges: one row per feature with <= bins-1 numbers -> broadcast
    b = F.aggregate("edges", F.lit(0), lambda acc, e: acc + (F.col("value") > e).cast("int"))
    cells = (long.join(F.broadcast(edges), "feature").withColumn("bin", b)
             .groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("nxy")))
    return mi_from_cells(cells)


def mi_from_cells(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("feature").agg(F.sum("nxy").alias("n"))
    nx = cells.groupBy("feature", "bin").agg(F.sum("nxy").alias("nx"))
    ny = cells.groupBy("feature", "y").agg(F.sum("nxy").alias("ny"))
    j = cells.join(n, "feature").join(nx, ["feature", "bin"]).join(ny, ["feature", "y"])
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def label_codes(train: DataFrame, test: DataFrame | None, col: str) -> DataFrame:
    """Category -> code (sorted by code point, NULL as 'Unknown'), fit on the
    given tables; one row per distinct category (small, broadcastable)."""
    from .encode import fit_label_codes
    return fit_label_codes([train] + ([test] if test is not None else []), col)


def importance_baseline(train: DataFrame, roles: Roles = DEFAULT_ROLES, bins: int = 10) -> DataFrame:
    """Mutual information of the numeric columns and the label-encoded
    categoricals, divided by the largest one."""
    from .encode import apply_label_codes
    enc = train
    for c in roles.categorical:
        enc = apply_label_codes(enc, label_codes(train, None, c), c)
    cols = list(roles.numeric) + list(roles.categorical)
    mi = mutual_info(enc, cols, roles, bins)
    mx = mi.agg(F.max("mi").alias("mx"))
    return mi.crossJoin(mx).select(
        "feature", "mi",
        F.when(F.col("mx") > 0, F.col("mi") / F.col("mx")).otherwise(F.col("mi")).alias("importance"))


# ---------------------------------------------------------------- leakage
def leak_verdict(train: DataFrame, col: str | None = None, roles: Roles = DEFAULT_ROLES,
                 bins: int = 10) -> DataFrame:
    """Correlation, mutual information, class separation (max - min class mean),
    ANOVA F / p and the verdict |corr| > .35 or MI > .65 or p < .0005."""
    col = col or roles.suspect
    cs = class_stats(train, col, roles)
    sep = cs.agg(F.when(F.count(F.lit(1)) >= 2, F.max("mean") - F.min("mean")).alias("separation"))
    corr = label_corr(train, [col], roles).select("corr")
    mi = mutual_info(train, [col], roles, bins).select("mi")
    an = anova(train, col, roles).select("f_stat", "p_value")
    j = corr.crossJoin(mi).crossJoin(sep).crossJoin(an)
    leak = ((F.coalesce(F.abs("corr"), F.lit(0.0)) > C.LEAK_ABS_CORR) | (F.col("mi") > C.LEAK_MI)
            | (F.coalesce(F.col("p_value"), F.lit(1.0)) < C.LEAK_P))
    return j.select(F.lit(col).alias("feature"), "corr", "mi", "separation", "f_stat", "p_value",
                    leak.alias("is_leakage"))


def suspect_gate(train: DataFrame, cutoff: int | None, col: str | None = None,
                 roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Safety gate for the suspect column.

    With a cut-off: keep rows whose sequence (unparseable -> 0) is <= cutoff;
    unsafe if fewer than 800 rows, |corr| > .18 or class separation > 4.0.
    Without: unsafe if |corr| > .15 on all rows. An undefined correlation
    (constant column) passes, as observed; ``verdict`` names it.
    """
    col = col or roles.suspect
    y = roles.label
    df = train
    if cutoff is not None:
        df = df.filter(parse_seq_or_zero(roles.key) <= F.lit(int(cutoff)))
    x = nan_to_null(col)
    base = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  safe_corr(x, F.col(y).cast("double")).alias("c0"))
    means = (df.filter(F.col(y).isin(*C.CLASSES) & x.isNotNull()).groupBy(y).agg(F.avg(x).alias("m"))
             .agg(F.when(F.count(F.lit(1)) >= 2, F.max("m") - F.min("m")).alias("separation")))
    j = base.crossJoin(means).withColumn("corr", nan_to_null("c0")).drop("c0")
    if cutoff is not None:
        verdict = (F.when(F.col("n_rows") < C.GATE_MIN_ROWS, F.lit("too_few_rows"))
                   .when(F.abs("corr") > C.GATE_ABS_CORR_WITH_CUTOFF, F.lit("corr"))
                   .when(F.col("separation") > C.GATE_SEPARATION, F.lit("separation"))
                   .when(F.col("corr").isNull(), F.lit("undefined_corr"))
                   .otherwise(F.lit("safe")))
    else:
        verdict = (F.when(F.abs("corr") > C.GATE_ABS_CORR_NO_CUTOFF, F.lit("corr"))
                   .when(F.col("corr").isNull(), F.lit("undefined_corr"))
                   .otherwise(F.lit("safe")))
    return j.select(F.lit(col).alias("feature"), "n_rows", "corr", "separation",
                    verdict.alias("verdict"),
                    verdict.isin("safe", "undefined_corr").alias("is_safe"))


# ---------------------------------------------------------------- correlations / missing
def corr_pairs(train: DataFrame, cols: list[str], threshold: float = C.HIGH_CORR) -> DataFrame:
    """All pairwise correlations (i < j) in one aggregation, flagged |r| > threshold."""
    pairs = list(combinations(cols, 2))
    if not pairs:
        return train.sparkSession.createDataFrame([], "f1 string, f2 string, corr double, is_high boolean")
    row = train.agg(*[safe_corr(nan_to_null(a), nan_to_null(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    st = F.stack(F.lit(len(pairs)), *[x for i, (a, b) in enumerate(pairs)
                                       for x in (F.lit(a), F.lit(b), F.col(f"{i}"))]).alias("f1", "f2", "c")
    return row.select(st).select("f1", "f2", nan_to_null("c").alias("corr")) \
        .withColumn("is_high", F.abs("corr") > threshold)


def missing_profile(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """NULL (or NaN) share per column in each table and their difference; a
    column absent from the test table counts as 0 there. One pass per table."""
    def shares(df):
        present = [c for c in cols if c in df.columns]
        row = df.agg(*[F.avg((F.col(c).isNull() | (F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))).cast("double")).alias(c) for c in present])
        return row.unpivot([], present, "feature", "ratio")
    a = shares(train).withColumnRenamed("ratio", "train_missing")
    b = shares(test).withColumnRenamed("ratio", "test_missing")
    j = a.join(b, "feature", "left").fillna(0.0, ["test_missing"])
    return j.withColumn("missing_difference", F.abs(F.col("train_missing") - F.col("test_missing")))


def co_missing(train: DataFrame, cols: list[str], min_ratio: float = C.CO_MISSING_MIN) -> DataFrame:
    """Share of rows where both columns are missing, for every pair of columns
    whose own missing share exceeds ``min_ratio`` (two passes: shares, pairs)."""
    def miss(c):
        return F.col(c).isNull() | (F.isnan(F.col(c)) if dict(train.dtypes)[c] in ("double", "float") else F.lit(False))
    sh = train.agg(*[F.avg(miss(c).cast("double")).alias(c) for c in cols]).first()
    keep = [c for c in cols if sh[c] is not None and sh[c] > min_ratio]
    pairs = list(combinations(keep, 2))
    if not pairs:
        return train.sparkSession.createDataFrame([], "f1 string, f2 string, both_missing double")
    row = train.agg(*[F.avg((miss(a) & miss(b)).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    st = F.stack(F.lit(len(pairs)), *[x for i, (a, b) in enumerate(pairs)
                                       for x in (F.lit(a), F.lit(b), F.col(f"{i}"))]).alias("f1", "f2", "both_missing")
    return row.select(st)


def missing_route(train: DataFrame, cols: list[str]) -> DataFrame:
    """Imputation route by missing share: > .20 neighbours, .03-.20 iterative
    regression, otherwise median."""
    row = train.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    r = row.unpivot([], list(cols), "feature", "missing")
    return r.withColumn("route", F.when(F.col("missing") > C.ROUTE_HIGH_MISSING, F.lit("knn"))
                        .when(F.col("missing") > C.ROUTE_LOW_MISSING, F.lit("iterative"))
                        .otherwise(F.lit("median")))


# ---------------------------------------------------------------- integrity / quality
def _dup_count(df: DataFrame, key: str):
    return (F.count(F.lit(1)) - F.count_distinct(F.col(key))
            - F.max(F.col(key).isNull().cast("int"))).cast("double")


def integrity(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES,
              numeric: list[str] | None = None) -> DataFrame:
    """Integrity checks as (check, subject, value, passed) rows: duplicate keys
    per table, invalid labels (NULL counts), columns > 40 % missing and
    numeric columns with > 15 % of rows outside [q01, q99]."""
    spark = train.sparkSession
    key, y = roles.key, roles.label
    numeric = list(numeric or roles.stability_numeric)
    cols = [c for c in train.columns if c not in (key, roles.split)]
    d1 = train.agg(_dup_count(train, key).alias("value")).select(
        F.lit("duplicate_ids").alias("check"), F.lit("train").alias("subject"), "value")
    d2 = test.agg(_dup_count(test, key).alias("value")).select(
        F.lit("duplicate_ids").alias("check"), F.lit("test").alias("subject"), "value")
    inv = train.agg(F.count_if(F.col(y).isNull() | ~F.col(y).isin(*C.CLASSES)).cast("double").alias("value")) \
        .select(F.lit("invalid_labels").alias("check"), F.lit(y).alias("subject"), "value")
    miss = missing_profile(train, train, cols).select(
        F.lit("high_missing").alias("check"), F.col("feature").alias("subject"),
        F.col("train_missing").alias("value"))
    long = train.select(*[nan_to_null(c).alias(c) for c in numeric]).unpivot([], numeric, "feature", "value")
    q = ranks.exact_quantiles(long, ["feature"], "value", [C.OUTLIER_LO, C.OUTLIER_HI])
    qb = q.groupBy("feature").agg(F.max(F.when(F.col("pidx") == 0, F.col("q"))).alias("q01"),
                                  F.max(F.when(F.col("pidx") == 1, F.col("q"))).alias("q99"))
    out = (long.join(F.broadcast(qb), "feature", "left")
           .groupBy("feature")
           .agg(F.avg(F.coalesce(((F.col("value") > F.col("q99")) | (F.col("value") < F.col("q01"))),
                                 F.lit(False)).cast("double")).alias("value"))
           .select(F.lit("outliers").alias("check"), F.col("feature").alias("subject"), "value"))
    allc = d1.unionByName(d2).unionByName(inv).unionByName(miss).unionByName(out)
    passed = (F.when(F.col("check") == "high_missing", F.col("value") <= C.HIGH_MISSING)
              .when(F.col("check") == "outliers", F.col("value") <= C.OUTLIER_FLAG)
              .otherwise(F.col("value") == 0))
    return allc.withColumn("passed", passed)


def quality_check(df: DataFrame, tag: str, roles: Roles = DEFAULT_ROLES,
                  numeric: list[str] | None = None) -> DataFrame:
    """Post-processing quality of one table as (split, check, subject, value,
    passed): +-inf count, missing count over numeric columns, invalid labels
    and columns whose sample std exceeds 1000. One aggregation."""
    key, y = roles.key, roles.label
    numeric = numeric or [f.name for f in df.schema.fields
                          if f.dataType.typeName() in ("double", "float", "integer", "long")
                          and f.name not in (key,)]
    feats = [c for c in numeric if c != y]
    exprs = [F.sum(F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1).otherwise(0)).alias(f"inf_{i}")
             for i, c in enumerate(numeric)]
    exprs += [F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")).alias(f"nan_{i}")
              for i, c in enumerate(numeric)]
    exprs += [F.stddev_samp(F.col(c).cast("double")).alias(f"std_{i}") for i, c in enumerate(feats)]
    has_y = y in df.columns
    if has_y:
        exprs.append(F.count_if(F.col(y).isNull() | ~F.col(y).isin(*C.CLASSES)).alias("inv"))
    row = df.agg(*exprs)
    inf_total = sum(F.coalesce(F.col(f"inf_{i}"), F.lit(0)) for i in range(len(numeric)))
    nan_total = sum(F.coalesce(F.col(f"nan_{i}"), F.lit(0)) for i in range(len(numeric)))
    items = [F.struct(F.lit("infinite_values").alias("check"), F.lit("all").alias("subject"),
                      inf_total.cast("double").alias("value")),
             F.struct(F.lit("missing_values").alias("check"), F.lit("all").alias("subject"),
                      nan_total.cast("double").alias("value"))]
    if has_y:
        items.append(F.struct(F.lit("invalid_labels").alias("check"), F.lit(y).alias("subject"),
                              F.col("inv").cast("double").alias("value")))
    items += [F.struct(F.lit("large_scale").alias("check"), F.lit(c).alias("subject"),
                       F.col(f"std_{i}").alias("value")) for i, c in enumerate(feats)]
    out = row.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    passed = (F.when(F.col("check") == "large_scale", F.coalesce(F.col("value") <= C.QUALITY_MAX_STD, F.lit(True)))
              .otherwise(F.col("value") == 0))
    return out.select(F.lit(tag).alias("split"), "check", "subject", "value", passed.alias("passed"))


def contract_check(table: DataFrame, tag: str, required: list[str]) -> DataFrame:
    """The input contract as rows (split, rule, subject, value, passed): each
    required column is there, and the table has rows."""
    have = set(table.columns)
    items = [F.struct(F.lit("column").alias("rule"), F.lit(c).alias("subject"), F.lit(float(c in have)).alias("value"))
             for c in required]
    items.append(F.struct(F.lit("rows").alias("rule"), F.lit("all").alias("subject"), F.col("n").cast("double").alias("value")))
    return (table.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*items)).alias("r"))
            .select(F.lit(tag).alias("split"), "r.rule", "r.subject", "r.value", (F.col("r.value") > 0).alias("passed")))


# ---------------------------------------------------------------- overlap
def id_overlap(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Distinct keys per table and keys present in both (left-semi join of the
    distinct key sets; both sides hash-partitioned on the key)."""
    k = roles.key
    a = train.select(k).filter(F.col(k).isNotNull()).distinct()
    b = test.select(k).filter(F.col(k).isNotNull()).distinct()
    common = a.join(b, k, "left_semi")
    return (a.agg(F.count(F.lit(1)).alias("n_train_ids"))
            .crossJoin(b.agg(F.count(F.lit(1)).alias("n_test_ids")))
            .crossJoin(common.agg(F.count(F.lit(1)).alias("n_common"))))


def time_overlap(train: DataFrame, test: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Share of distinct train keys whose sequence is >= the smallest test
    sequence (issue above 2 %), plus the common-key count."""
    k = roles.key
    a = train.select(k).distinct().select(parse_seq(k).alias("s")).filter(F.col("s").isNotNull())
    b = test.select(k).distinct().select(parse_seq(k).alias("s")).filter(F.col("s").isNotNull())
    tmin = b.agg(F.min("s").alias("test_min"))
    st = (a.crossJoin(F.broadcast(tmin))
          .agg(F.max("s").alias("train_max"), F.first("test_min").alias("test_min"),
               F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") >= F.col("test_min")).alias("n_over")))
    ov = (F.when(F.col("train_max") >= F.col("test_min"), F.col("n_over") / F.col("n"))
          .otherwise(F.lit(0.0)))
    common = id_overlap(train, test, roles).select("n_common")
    return (st.crossJoin(common)
            .select("train_max", "test_min", ov.alias("overlap_ratio"), "n_common",
                    ((F.coalesce(ov, F.lit(0.0)) <= C.TEMPORAL_OVERLAP_FLAG) & (F.col("n_common") == 0))
                    .alias("passed")))


# ---------------------------------------------------------------- weights / centroids
def class_weights(train: DataFrame, profile: str = "train", roles: Roles = DEFAULT_ROLES,
                  classes: tuple = C.CLASSES) -> DataFrame:
    """Balanced weights n / (k n_c) times the profile multipliers; an absent
    class gets 1.0 before the multiplier."""
    y = roles.label
    mult = C.WEIGHT_PROFILES[profile]
    spark = train.sparkSession
    spine = spark.createDataFrame([(int(c), float(m)) for c, m in zip(classes, mult)],
                                  "label int, mult double")
    cnt = train.groupBy(F.col(y).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    tot = train.agg(F.count(F.lit(1)).alias("n"))
    j = spine.join(cnt, "label", "left").fillna(0, ["n_c"]).crossJoin(tot)
    w = F.when(F.col("n_c") > 0, F.col("n") / (F.lit(len(classes)) * F.col("n_c"))).otherwise(F.lit(1.0))
    return j.select(F.lit(profile).alias("profile"), "label", "n_c", (w * F.col("mult")).alias("weight"))


def class_centroids(train: DataFrame, cols: list[str], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Per-class centroids of the cleaned features, pairwise Euclidean distances
    (3 rows self-joined on a < b) and the separation score min / (mean + 1e-8)."""
    y = roles.label
    cent = (train.select(F.least(F.greatest(F.col(y), F.lit(0)), F.lit(2)).alias("label"),
                         *[clean_num(c).alias(c) for c in cols])
            .groupBy("label").agg(*[F.avg(c).alias(c) for c in cols]))
    a, b = cent.alias("a"), cent.alias("b")
    d = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in cols))
    pairs = a.join(b, F.col("a.label") < F.col("b.label")).select(
        F.col("a.label").alias("class_a"), F.col("b.label").alias("class_b"), d.alias("distance"))
    st = pairs.agg(F.min("distance").alias("mn"), F.avg("distance").alias("av"))
    return pairs.crossJoin(st).select(
        "class_a", "class_b", "distance",
        (F.col("mn") / (F.col("av") + F.lit(1e-8))).alias("separation_score"))
