"""Categorical encoders: sorted label codes, out-of-fold smoothed target
encoding and the class-mode fill.

Fitted state is a DataFrame with one row per category (or per category and
fold). It is broadcast only when its size is checked to be small; otherwise
the join is left to a shuffle, where AQE splits skewed (hot) categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_ROLES, Roles
from ..session import reliable_checkpoint
from . import ranks
from .split import strat_folds

def fit_label_codes(dfs: list[DataFrame], col: str, unknown: str = C.UNKNOWN_CATEGORY) -> DataFrame:
    """Category -> 0-based code in code-point order over the union of the given
    tables; NULL is encoded as ``unknown``. Returns (category, code)."""
    cats = reduce(lambda a, b: a.unionByName(b),
                  [d.select(F.coalesce(F.col(col).cast("string"), F.lit(unknown)).alias("category"))
                   for d in dfs]).distinct()
    n = ranks.max_ndv(cats.withColumn("g", F.lit(1)), ["g"], "category")
    if n <= ranks.SMALL_NDV:
        # statistic table (distinct categories, size checked): a plain window is fine
        return cats.select("category", (F.row_number().over(Window.orderBy("category")) - 1)
                           .cast("int").alias("code"))
    return ranks.global_row_number(cats, [F.col("category")], "code") \
        .select("category", (F.col("code") - 1).cast("int").alias("code"))


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str,
                      unknown: str = C.UNKNOWN_CATEGORY, out: str | None = None) -> DataFrame:
    """Replace ``col`` (or add ``out``) with its code; unseen categories get NULL.
    The join has no hint: Spark broadcasts the codes where their size, known at run
    time, is small, and splits a hot category otherwise."""
    out = out or col
    key = F.coalesce(F.col(col).cast("string"), F.lit(unknown))
    j = df.withColumn("_cat", key).join(
        codes.withColumnRenamed("category", "_cat"), "_cat", "left")
    if out == col:
        return j.withColumn(col, F.col("code")).drop("_cat", "code")
    return j.withColumnRenamed("code", out).drop("_cat")


def label_encode(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fit codes on train union test (as observed) and apply to both."""
    for c in cols:
        codes = fit_label_codes([train, test], c)
        train = apply_label_codes(train, codes, c)
        test = apply_label_codes(test, codes, c)
    return train, test


def _alpha(n):
    lo, hi, div = C.TARGET_ENC_ALPHA
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(n / F.lit(div)))).cast("double")


def target_encode(train: DataFrame, test: DataFrame, cols: list[str], roles: Roles = DEFAULT_ROLES,
                  k: int = C.TARGET_ENC_FOLDS, seed: int = C.SEED, folds: DataFrame | None = None,
                  suffix: str = "_target_encoded") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold smoothed target mean.

    Train rows get the encoding fitted on the other k-1 folds; test rows the one
    fitted on all train rows. enc = (sum_y + global * alpha) / (count + alpha),
    alpha = min(25, max(3, n_fit // 150)); NULL or unseen categories get the
    global mean of the fit rows. All folds come from one aggregation per column:
    (category, fold) sums, where out-of-fold = category total - own fold.
    """
    y = roles.label
    key = roles.key
    if folds is None:
        folds = strat_folds(train, k=k, seed=seed, roles=roles)
    # totals, counts of every column and the output read it: joined once
    tf = reliable_checkpoint(train.join(folds.select(key, "fold"), key))
    fold_tot = tf.groupBy("fold").agg(F.count(F.lit(1)).alias("nf"), F.sum(F.col(y).cast("double")).alias("sf"))
    all_tot = tf.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    g = fold_tot.crossJoin(all_tot).select(
        "fold", (F.col("n") - F.col("nf")).alias("n_fit"),
        ((F.col("s") - F.col("sf")) / (F.col("n") - F.col("nf"))).alias("g_fit"))
    out_tr, out_te = tf, test
    for c in cols:
        cf = (tf.filter(F.col(c).isNotNull())
              .groupBy(F.col(c).alias("_c"), "fold")
              .agg(F.count(F.lit(1)).alias("cnt_f"), F.sum(F.col(y).cast("double")).alias("sum_f")))
        ct = cf.groupBy("_c").agg(F.sum("cnt_f").alias("cnt_t"), F.sum("sum_f").alias("sum_t"))
        # one row per (category, fold) of the fit side
        oof = (ct.crossJoin(F.broadcast(g))
               .join(cf, ["_c", "fold"], "left").fillna(0, ["cnt_f"]).fillna(0.0, ["sum_f"])
               .select("_c", "fold", (F.col("cnt_t") - F.col("cnt_f")).alias("cf"),
                       (F.col("sum_t") - F.col("sum_f")).alias("sf"), "g_fit", "n_fit"))
        a = _alpha(F.col("n_fit"))
        oof = oof.select("_c", "fold", F.when(F.col("cf") > 0,
                                              (F.col("sf") + F.col("g_fit") * a) / (F.col("cf") + a))
                         .alias("_enc"))
        out_tr = (out_tr.join(F.broadcast(g.select("fold", "g_fit")), "fold")
                  .join(oof.withColumnRenamed("_c", c), [c, "fold"], "left")
                  .withColumn(c + suffix, F.coalesce(F.col("_enc"), F.col("g_fit")))
                  .drop("_enc", "g_fit"))
        full = all_tot.select("n", (F.col("s") / F.col("n")).alias("g_all"))
        fa = (ct.crossJoin(full)
              .select(F.col("_c").alias(c), "g_all",
                      ((F.col("sum_t") + F.col("g_all") * _alpha(F.col("n"))) /
                       (F.col("cnt_t") + _alpha(F.col("n")))).alias("_enc")))
        out_te = (out_te.crossJoin(F.broadcast(full.select("g_all")))
                  .join(fa.drop("g_all"), c, "left")
                  .withColumn(c + suffix, F.coalesce(F.col("_enc"), F.col("g_all")))
                  .drop("_enc", "g_all"))
    return out_tr.drop("fold"), out_te


def class_mode_fill(train: DataFrame, test: DataFrame, cols: list[str],
                    roles: Roles = DEFAULT_ROLES) -> tuple[DataFrame, DataFrame]:
    """Fill categorical NULLs: train rows with the most frequent value of their
    class (smallest value on ties), falling back to the overall mode; test rows
    with the overall mode ('Unknown' when the column is all NULL).

    Uses the label to fill a feature: offered, not part of the default plan."""
    y = roles.label
    for c in cols:
        per = (train.filter(F.col(c).isNotNull() & F.col(y).isin(*C.CLASSES))
               .groupBy(F.col(y).alias("_y")).agg(F.mode(F.col(c), True).alias("_m")))
        overall = train.agg(F.mode(F.col(c), True).alias("_d")).select(
            F.coalesce(F.col("_d"), F.lit(C.UNKNOWN_CATEGORY)).alias("_d"))
        train = (train.join(F.broadcast(per), F.col(y) == F.col("_y"), "left")
                 .crossJoin(F.broadcast(overall))
                 .withColumn(c, F.coalesce(F.col(c), F.col("_m"), F.col("_d")))
                 .drop("_y", "_m", "_d"))
        test = (test.crossJoin(F.broadcast(overall))
                .withColumn(c, F.coalesce(F.col(c), F.col("_d"))).drop("_d"))
    return train, test
