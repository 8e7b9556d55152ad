"""Edge fixtures and properties (no SQL twin needed)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel import config as C
from kestrel.functions.exprs import clean_num, parse_seq, parse_seq_or_zero
from kestrel.operators import drift, evaluate, features, profile, ranks, scale, score, split
from kestrel.sources import tables


def test_parse_ids(spark):
    ids = ["TRAIN_0012", "X", "A_1.5", "A_ 7 ", "A_+3", "A_1_2", "A_", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [r[0] for r in df.select(parse_seq("id")).collect()]
    assert got == [12, None, None, 7, 3, 1, None, None]
    got0 = [r[0] for r in df.select(parse_seq_or_zero("id")).collect()]
    assert got0 == [12, 0, 0, 7, 3, 1, 0, 0]


def test_clean_dirty(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.5,)], "x double")
    assert [r[0] for r in df.select(clean_num("x")).collect()] == [0.0, 0.0, 0.0, 0.0, 1.5]


def _two_by_two(spark):
    rows = [("train", "a")] * 30 + [("train", "b")] * 10 + [("test", "a")] * 20 + [("test", "b")] * 25
    df = spark.createDataFrame(rows, "split string, cat string")
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def test_chi2_two_by_two(spark):
    tr, te = _two_by_two(spark)
    raw = drift.chi2_drift(tr, te, ["cat"], with_p=False, correction=False).first()
    assert raw["chi2"] == pytest.approx(8.1627, abs=1e-4)
    obs = np.array([[30, 10], [20, 25]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = obs + np.minimum(0.5, np.abs(exp - obs)) * np.sign(exp - obs)
    yates = ((adj - exp) ** 2 / exp).sum()
    r = drift.chi2_drift(tr, te, ["cat"]).first()
    assert r["chi2"] == pytest.approx(yates, rel=1e-12)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(yates / 2)), rel=1e-9)


@pytest.mark.parametrize("x,dof", [(3.841458820694124, 1), (7.814727903251178, 3),
                                   (9.487729036781154, 4), (11.070497693516351, 5)])
def test_chi2_pvalue(x, dof):
    assert drift.chi2_pvalue(x, dof) == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("f,d1,d2", [(4.102821015130399, 2, 10), (3.0983912121407795, 3, 20),
                                     (4.964602743730711, 1, 10)])
def test_f_pvalue(f, d1, d2):
    assert profile.f_pvalue(f, d1, d2) == pytest.approx(0.05, abs=1e-8)


def test_psi_ks_self_zero(spark, sf_small):
    tr, _ = tables.train_test(tables.subs(spark, sf_small))
    p = {r["feature"]: r["psi"] for r in drift.psi(tr, tr, ["age", "tenure"]).collect()}
    k = {r["feature"]: r["ks"] for r in drift.ks(tr, tr, ["age", "tenure"]).collect()}
    assert all(abs(v) < 1e-12 for v in p.values()) and all(v == 0 for v in k.values())


def test_psi_matches_numpy(spark, sf_small):
    tr, te = tables.train_test(tables.subs(spark, sf_small))
    a = np.array([r[0] for r in tr.select("tenure").dropna().collect()])
    b = np.array([r[0] for r in te.select("tenure").dropna().collect()])
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    edges = np.linspace(lo, hi, 11)
    edges[0] -= 1e-6
    edges[-1] += 1e-6
    ha, _ = np.histogram(a, edges)
    hb, _ = np.histogram(b, edges)
    pa, pb = (ha + 1) / (len(a) + 10), (hb + 1) / (len(b) + 10)
    ref = np.sum((pb - pa) * np.log(pb / pa))
    got = drift.psi(tr, te, ["tenure"]).first()["psi"]
    assert got == pytest.approx(ref, rel=1e-12)


def test_global_row_number_and_quantiles(spark):
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame({"v": rng.integers(0, 50, n).astype(float), "k": np.arange(n)})
    df = spark.createDataFrame(pdf)
    rn = ranks.global_row_number(df, [F.col("v").desc(), F.col("k")], n_parts=5).toPandas()
    exp = pdf.sort_values(["v", "k"], ascending=[False, True]).reset_index(drop=True)
    exp["rn"] = np.arange(1, n + 1)
    m = rn.merge(exp[["k", "rn"]], on="k")
    assert (m.rn_x == m.rn_y).all()
    probs = [0.001, 0.25, 0.5, 0.85, 0.999]
    d = ranks._quantiles_distributed(df.withColumn("g", F.lit(1)), ["g"], "v", probs).toPandas().sort_values("pidx")
    assert np.allclose(d.q.to_numpy(), np.quantile(pdf.v, probs))


def test_pct_rank_ties_match_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 7.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, x double").withColumn("g", F.lit(1))
    got = features.pct_rank(df, ["x"], ["g"], value_fn=lambda c: clean_num(c)).orderBy("k").toPandas()
    ref = pd.Series([0.0 if v is None else v for v in vals]).rank(pct=True)
    assert np.allclose(got.x_rank.to_numpy(), ref.to_numpy())


def test_qcut_bins_match_pandas(spark):
    seqs = [1, 1, 1, 1, 2, 3, 3, 9, 10, 10, 10, 11]
    df = spark.createDataFrame([(f"A_{s}",) for s in seqs], "id string")
    got = features.temporal_features(df).orderBy("temporal_id").toPandas()
    ref4 = pd.qcut(seqs, 4, labels=False, duplicates="drop")
    ref10 = pd.qcut(seqs, 10, labels=False, duplicates="drop")
    assert list(got.temporal_quartile) == list(ref4)
    assert list(got.temporal_decile) == list(ref10)


def test_age_edges(spark):
    ages = [17, 18, 25, 26, 35, 50, 65, 100, 101]
    df = spark.createDataFrame([(float(a), 1.0, 1.0, 1.0, 1.0) for a in ages],
                               "age double, tenure double, frequent double, payment_interval double, contract_length double")
    got = features.business_features(df).select("age", "age_group", "age_risk").collect()
    assert [r.age_group for r in got] == [0, 0, 0, 1, 1, 2, 3, 4, 4]
    assert [r.age_risk for r in got] == [1.2, 1.2, 1.2, 1.2, 1.0, 1.0, 1.1, 1.1, 1.1]


def test_constant_column(spark):
    df = spark.createDataFrame([(f"T_{i}", 5.0, i % 3) for i in range(900)], "id string, x double, support_needs int")
    assert profile.label_corr(df, ["x"]).first()["corr"] is None
    g = profile.suspect_gate(df, 10_000, "x").first()
    assert g["verdict"] == "undefined_corr" and g["is_safe"]
    st = features.stat_features(df.withColumnRenamed("x", "age"), ["age"]).select("age_zscore").distinct().collect()
    assert [r[0] for r in st] == [0.0]
    p = scale.fit_robust(df, ["x"])
    assert p["x"] == (5.0, 1.0)


def test_one_class_missing(spark):
    rows = [(0, 0)] * 5 + [(1, 1)] * 3 + [(1, 0)] * 2
    df = spark.createDataFrame(rows, "y int, pred int")
    r = evaluate.report(df, "y", "pred").first()
    assert r["recall_2"] == 0.0 and r["f1_2"] == 0.0
    f1_0 = 2 * 5 / (5 + 7)
    f1_1 = 2 * 3 / (5 + 3)
    assert r["f1_macro"] == pytest.approx((f1_0 + f1_1) / 2)


def test_quota_zero_shortfall_changes_nothing(spark):
    # n = 15, three rows predicted 1: 3 < 15 * .25 = 3.75 but int(3.75) - 3 = 0
    rows = [(f"T_{i:02d}", 0.1, 0.8, 0.1) for i in range(3)] + [(f"T_{i:02d}", 0.8, 0.1, 0.1) for i in range(3, 15)]
    df = spark.createDataFrame(rows, "id string, p0 double, p1 double, p2 double")
    for mode in ("exact", "as_observed"):
        out = score.quota_labels(df, mode=mode).toPandas()
        assert (out.label == 1).sum() == 3


def test_quota_exact_reaches_floors(spark, sf_small):
    p = tables.probs(spark, sf_small).select("id", "p0", "p1", "p2")
    out = score.quota_labels(p, mode="exact").toPandas()
    n = len(out)
    assert (out.label == 1).sum() >= int(n * C.FLOOR_CLASS1)
    assert (out.label == 2).sum() <= int(n * C.CAP_CLASS2) + 1


def test_folds_partition_and_gap_split(spark):
    rows = [(f"TRAIN_{i:05d}", i % 3) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, support_needs int")
    f = split.strat_folds(df, 5).toPandas()
    assert len(f) == 6000 and set(f.fold) == set(range(5)) and f.id.is_unique
    g = split.gap_split(df).toPandas()
    g["seq"] = g.id.str.split("_").str[1].astype(int)
    assert g[g.role == "val"].seq.min() > g[g.role == "gap"].seq.max() > g[g.role == "train"].seq.max()
    assert (g.role == "val").sum() == int(6000 * C.VAL_SIZE)


def test_quantile_transform_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.gamma(2.0, 2.0, 3000), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lm = scale.fit_quantile_transform(df, ["x"])
    refs = np.linspace(0, 1, 500)
    q = np.quantile(x, refs)
    assert np.allclose(lm["x"], q)
    got = np.array([r[0] for r in scale.apply_quantile_transform(df, lm).collect()])
    exp = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    exp[x + 1e-7 > q[-1]] = 1.0
    exp[x - 1e-7 < q[0]] = 0.0
    assert np.allclose(got, np.clip(exp, 0, 1))


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, age double, support_needs int, gender string")
    assert drift.psi(e, e, ["age"]).count() == 0
    assert profile.class_mix(e).count() == 0
    r = evaluate.report(e.withColumn("pred", F.col("support_needs")), "support_needs", "pred").collect()
    assert len(r) == 1 and r[0]["total"] == 0 and r[0]["accuracy"] is None


def test_distributed_quantiles_hot_value_many_probs(spark):
    rng = np.random.default_rng(7)
    n = 6000
    v = np.round(rng.normal(size=n), 3)
    v[: n // 3] = 0.25  # one value holds a third of the rows
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "v": v})
    df = spark.createDataFrame(pdf)
    probs = list(np.linspace(0, 1, 101))
    got = ranks._quantiles_distributed(df, ["g"], "v", probs).toPandas()
    for g in ["a", "b"]:
        ref = np.quantile(pdf[pdf.g == g].v, probs)
        q = got[got.g == g].sort_values("pidx").q.to_numpy()
        assert np.allclose(q, ref)
