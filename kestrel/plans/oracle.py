"""DuckDB SQL twins of the registered queries (tables pre-registered as views).
Every double is rounded to 6 decimals, as on the Spark side."""

from __future__ import annotations

from .. import config as C

SUBS = """subs AS (
  SELECT concat(CASE WHEN o.o_orderkey % 5 = 0 THEN 'TEST_' ELSE 'TRAIN_' END,
                lpad(CAST(o.o_orderkey AS VARCHAR), CAST(greatest(7, length(CAST(o.o_orderkey AS VARCHAR))) AS INTEGER), '0')) AS id,
    CASE WHEN o.o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(CASE WHEN o.o_orderkey % 41 = 3 THEN NULL ELSE 18 + o.o_custkey % 63 END AS DOUBLE) AS age,
    CASE WHEN o.o_orderkey % 29 = 4 THEN NULL WHEN c.c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CAST(CASE WHEN o.o_orderkey % 13 = 2 THEN NULL
              ELSE date_diff('day', CAST(o.o_orderdate AS DATE), DATE '2001-12-31') END AS DOUBLE) AS tenure,
    CAST(coalesce(l.n_lines, 0) AS DOUBLE) AS frequent,
    CAST(CASE WHEN o.o_orderkey % 4 = 1 THEN NULL ELSE 1 + o.o_orderkey % 30 END AS DOUBLE) AS payment_interval,
    c.c_mktsegment AS subscription_type,
    coalesce(l.sum_qty, 0.0) AS contract_length,
    CASE WHEN o.o_orderkey % 37 = 5 THEN NULL ELSE o.o_totalprice / 1000 END AS after_interaction,
    CASE WHEN o.o_totalprice < 230000 THEN 0 WHEN coalesce(l.n_lines, 0) >= 4 THEN 1 ELSE 2 END AS support_needs
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
), train AS (SELECT * FROM subs WHERE split = 'train'), test AS (SELECT * FROM subs WHERE split = 'test')"""

PROBS = """probs AS (
  SELECT concat('TEST_', lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(7, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0')) AS id, o_orderkey AS seq,
    CASE WHEN o_orderkey % 997 = 0 THEN 0.0 ELSE w0 / (w0 + w1 + w2) END AS p0,
    CASE WHEN o_orderkey % 997 = 0 THEN 0.0 ELSE w1 / (w0 + w1 + w2) END AS p1,
    CASE WHEN o_orderkey % 997 = 0 THEN 0.0 ELSE w2 / (w0 + w1 + w2) END AS p2,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y
  FROM (SELECT *, CAST(1 + o_orderkey * 7919 % 101 AS DOUBLE) AS w0,
                  CAST(1 + o_orderkey * 104729 % 67 AS DOUBLE) AS w1,
                  CAST(1 + o_orderkey * 1299709 % 139 AS DOUBLE) AS w2 FROM orders) q
)"""

STAB = list(C.STABILITY_NUMERIC)
NUM = list(C.NUMERIC)
CAT = list(C.CATEGORICAL)
PROFILE_COLS = ["age", "gender", "tenure", "frequent", "payment_interval", "subscription_type",
                "contract_length", "after_interaction", "support_needs"]


def r6(x: str) -> str:
    """Six decimals by the formula of ``exprs.r6``, so that ties go the same way."""
    d = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({d}) < 1e9 THEN floor({d} * 1e6 + 0.5001) / 1e6 ELSE round({d}, 6) END"


def lst(cols) -> str:
    return ", ".join(cols)


def seq_expr(key: str = "id") -> str:
    return f"TRY_CAST(split_part({key}, '_', 2) AS BIGINT)"


def long_both(cols, fill: str = "") -> str:
    """(t, feature, value) of train and test, NULLs dropped."""
    return f"""long AS (
  SELECT split AS t, feature, value FROM (
    UNPIVOT (SELECT split, {lst(cols)} FROM subs) ON {lst(cols)} INTO NAME feature VALUE value))"""


def psi_sql(cols, extra_filter: str = "") -> str:
    bins = "+".join(f"CAST(value >= lo + {i} * ((hi - lo) / 10) AS INTEGER)" for i in range(1, 10))
    return f"""
st AS (SELECT feature, count(*) FILTER (WHERE t = 'train') AS n1, count(*) FILTER (WHERE t = 'test') AS n2,
              min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
b AS (SELECT l.feature, l.t, CASE WHEN hi > lo THEN {bins} ELSE 0 END AS bin FROM long l JOIN st USING (feature)),
h AS (SELECT feature, bin, count(*) FILTER (WHERE t = 'train') AS h1, count(*) FILTER (WHERE t = 'test') AS h2
      FROM b GROUP BY feature, bin),
sp AS (SELECT st.*, r.range AS bin FROM st CROSS JOIN range(10) r),
j AS (SELECT sp.feature, sp.n1, sp.n2, sp.hi > sp.lo AS has_range,
             CAST(coalesce(h.h1, 0) AS DOUBLE) AS h1, CAST(coalesce(h.h2, 0) AS DOUBLE) AS h2
      FROM sp LEFT JOIN h ON sp.feature = h.feature AND sp.bin = h.bin),
psi AS (SELECT feature, CASE WHEN bool_and(has_range) AND max(n1) > 0 THEN
          sum(((h2 + 1) / (n2 + 10) - (h1 + 1) / (n1 + 10)) * ln(((h2 + 1) / (n2 + 10)) / ((h1 + 1) / (n1 + 10))))
          ELSE 0.0 END AS psi FROM j GROUP BY feature)"""


KS_SQL = """
vc AS (SELECT feature, value, count(*) FILTER (WHERE t = 'train') AS c1, count(*) FILTER (WHERE t = 'test') AS c2
       FROM long GROUP BY feature, value),
cum AS (SELECT feature, value, sum(c1) OVER w AS s1, sum(c2) OVER w AS s2 FROM vc
        WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nn AS (SELECT feature, sum(c1) AS n1, sum(c2) AS n2 FROM vc GROUP BY feature),
ks AS (SELECT feature, max(abs(CAST(s1 AS DOUBLE) / n1 - CAST(s2 AS DOUBLE) / n2)) AS ks
       FROM cum JOIN nn USING (feature) WHERE n1 > 0 AND n2 > 0 GROUP BY feature)"""


#: The p-value by the theta-function form; the alternating series above 1.
KS_P_SQL = """SELECT feature, {ks} AS ks, {p} AS p_value FROM (
  SELECT feature, ks, ks * sqrt(CAST(n1 AS DOUBLE) * n2 / (n1 + n2)) AS lam FROM ks JOIN nn USING (feature))"""


def chi2_sf_sql(x: str, dof: str) -> str:
    """The upper tail of the chi-square distribution, as one less the lower incomplete
    gamma function's series of positive terms."""
    h, a = f"(({x}) / 2.0::DOUBLE)", f"(({dof}) / 2.0::DOUBLE)"
    terms = f"list_sum([exp({a} * ln({h}) + i * ln({h}) - {h} - lgamma({a} + i + 1)) FOR i IN range(0, 400)])"
    return f"CASE WHEN {x} <= 0 THEN 1 ELSE greatest(0, 1 - {terms}) END"


def mi_sql(src: str, cols, label: str = "support_needs", name: str = "mi") -> str:
    """Decile-binned mutual information of ``cols`` (NULL -> 0) with the label."""
    sel = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in cols)
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    return f"""
{name}_long AS (SELECT y, feature, value FROM (
    UNPIVOT (SELECT {label} AS y, {sel} FROM {src} WHERE {label} IS NOT NULL) ON {lst(cols)}
    INTO NAME feature VALUE value)),
{name}_edges AS (SELECT feature, list_distinct(quantile_cont(value, [{probs}])) AS edges
                 FROM {name}_long GROUP BY feature),
{name}_cells AS (SELECT l.feature, len(list_filter(e.edges, lambda x: x < l.value)) AS bin, l.y, count(*) AS nxy
                 FROM {name}_long l JOIN {name}_edges e USING (feature) GROUP BY ALL),
{name}_n AS (SELECT feature, sum(nxy) AS n FROM {name}_cells GROUP BY feature),
{name}_nx AS (SELECT feature, bin, sum(nxy) AS nx FROM {name}_cells GROUP BY feature, bin),
{name}_ny AS (SELECT feature, y, sum(nxy) AS ny FROM {name}_cells GROUP BY feature, y),
{name} AS (SELECT c.feature, sum((CAST(c.nxy AS DOUBLE) / n.n) * ln(CAST(c.nxy AS DOUBLE) * n.n / (CAST(x.nx AS DOUBLE) * y.ny))) AS mi
           FROM {name}_cells c JOIN {name}_n n USING (feature) JOIN {name}_nx x USING (feature, bin)
           JOIN {name}_ny y USING (feature, y) GROUP BY c.feature)"""


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def _anova_one(col: str) -> str:
    return f"""SELECT '{col}' AS feature, f_stat, df_between, df_within,
  CASE WHEN df_between = 2 AND f_stat IS NOT NULL THEN
       CASE WHEN f_stat <= 0 THEN 1.0 ELSE power(df_within / (df_within + 2.0 * f_stat), df_within / 2.0) END END AS p_value
FROM (SELECT (ssb / (k - 1)) / nullif(ssw / (nn - k), 0) AS f_stat, CAST(k - 1 AS BIGINT) AS df_between,
             CAST(nn - k AS BIGINT) AS df_within
      FROM (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * v) AS ssw
            FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS gm
                  FROM (SELECT count(*) AS n, avg({col}) AS m, var_pop({col}) AS v FROM train
                        WHERE support_needs IN (0, 1, 2) AND {col} IS NOT NULL GROUP BY support_needs))))"""


def _leak_one(col: str) -> str:
    return f"""SELECT '{col}' AS feature, c.corr, m.mi, s.separation, a.f_stat, a.p_value,
  (coalesce(abs(c.corr), 0) > {C.LEAK_ABS_CORR} OR m.mi > {C.LEAK_MI} OR coalesce(a.p_value, 1) < {C.LEAK_P}) AS is_leakage
FROM (SELECT corr({col}, CAST(support_needs AS DOUBLE)) AS corr FROM train) c,
     (SELECT mi FROM mi_{col}) m,
     (SELECT CASE WHEN count(*) >= 2 THEN max(m) - min(m) END AS separation
      FROM (SELECT avg({col}) AS m FROM train WHERE support_needs IN (0, 1, 2) AND {col} IS NOT NULL
            GROUP BY support_needs)) s,
     ({_anova_one(col)}) a"""


def _gate_one(col: str, with_cut: bool, name: str) -> str:
    src = "train WHERE coalesce(" + seq_expr() + ", 0) <= (SELECT cutoff FROM cut)" if with_cut else "train"
    if with_cut:
        verdict = f"""CASE WHEN n_rows < {C.GATE_MIN_ROWS} THEN 'too_few_rows'
              WHEN abs(corr) > {C.GATE_ABS_CORR_WITH_CUTOFF} THEN 'corr'
              WHEN separation > {C.GATE_SEPARATION} THEN 'separation'
              WHEN corr IS NULL THEN 'undefined_corr' ELSE 'safe' END"""
    else:
        verdict = f"""CASE WHEN abs(corr) > {C.GATE_ABS_CORR_NO_CUTOFF} THEN 'corr'
              WHEN corr IS NULL THEN 'undefined_corr' ELSE 'safe' END"""
    return f"""SELECT '{name}' AS feature, n_rows, corr, separation, {verdict} AS verdict,
  ({verdict}) IN ('safe', 'undefined_corr') AS is_safe
FROM (SELECT (SELECT count(*) FROM {src}) AS n_rows,
             (SELECT corr({col}, CAST(support_needs AS DOUBLE)) FROM {src}) AS corr,
             (SELECT CASE WHEN count(*) >= 2 THEN max(m) - min(m) END FROM
               (SELECT avg({col}) AS m FROM (SELECT * FROM {src}) s0
                WHERE support_needs IN (0, 1, 2) AND {col} IS NOT NULL GROUP BY support_needs)) AS separation)"""


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _miss(c: str) -> str:
    num = c not in ("gender", "subscription_type", "support_needs", "id", "split")
    return f"({c} IS NULL{' OR isnan(' + c + ')' if num else ''})"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["drift_psi"] = f"WITH {SUBS}, {long_both(STAB)}, {psi_sql(STAB)}\nSELECT feature, {r6('psi')} AS psi FROM psi"
    far = "list_sum([CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * lam * lam) FOR k IN range(1, 21)])"
    near = "list_sum([exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / 8 / (lam * lam)) FOR k IN range(1, 21)])"
    ks_p = KS_P_SQL.format(ks=r6("ks"), p=r6(f"CASE WHEN lam <= 0 THEN 1 WHEN lam < 1 THEN 1 - sqrt(2 * pi()) / lam * {near} ELSE {far} END"))
    q["drift_ks"] = f"WITH {SUBS}, {long_both(STAB)}, {KS_SQL}\n{ks_p}"
    q["drift_moments"] = f"""WITH {SUBS}, {long_both(STAB)}
SELECT feature, t AS split, count(value) AS n, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std,
  {r6('quantile_cont(value, 0.5)')} AS median, {r6('quantile_cont(value, 0.25)')} AS q25,
  {r6('quantile_cont(value, 0.75)')} AS q75
FROM long GROUP BY feature, t"""
    q["drift_report"] = f"""WITH {SUBS}, {long_both(STAB)}, {psi_sql(STAB)}, {KS_SQL}
SELECT st.feature, st.n1 AS n_train, st.n2 AS n_test, {r6('ks.ks')} AS ks, {r6('psi.psi')} AS psi,
  (ks.ks < {C.KS_STABLE} AND psi.psi < {C.PSI_STABLE}) AS is_stable
FROM st JOIN ks USING (feature) JOIN psi USING (feature)
WHERE st.n1 > {C.STABILITY_MIN_ROWS} AND st.n2 > {C.STABILITY_MIN_ROWS}"""
    cat_long = f"""cl AS (SELECT split AS t, feature, category FROM (
    UNPIVOT (SELECT split, {lst(CAT)} FROM subs) ON {lst(CAT)} INTO NAME feature VALUE category))"""
    q["drift_chi2"] = f"""WITH {SUBS}, {cat_long},
cnt AS (SELECT feature, category, count(*) FILTER (WHERE t = 'train') AS o1, count(*) FILTER (WHERE t = 'test') AS o2
        FROM cl GROUP BY feature, category),
common AS (SELECT * FROM cnt WHERE o1 > 0 AND o2 > 0),
tot AS (SELECT feature, count(*) AS k, sum(o1) AS r1, sum(o2) AS r2 FROM common GROUP BY feature),
e AS (SELECT c.feature, t.k, c.o1, c.o2, CAST(t.r1 AS DOUBLE) * (c.o1 + c.o2) / (t.r1 + t.r2) AS e1,
             CAST(t.r2 AS DOUBLE) * (c.o1 + c.o2) / (t.r1 + t.r2) AS e2
      FROM common c JOIN tot t USING (feature) WHERE t.k > 1),
a AS (SELECT feature, k, e1, e2,
        o1 + CASE WHEN k = 2 THEN least(0.5, abs(e1 - o1)) * sign(e1 - o1) ELSE 0 END AS a1,
        o2 + CASE WHEN k = 2 THEN least(0.5, abs(e2 - o2)) * sign(e2 - o2) ELSE 0 END AS a2 FROM e)
SELECT feature, n_common, {r6('x')} AS chi2, dof, {r6('p')} AS p_value, p > {C.CHI2_STABLE_P} AS is_stable FROM (
  SELECT *, {chi2_sf_sql('x', 'dof')} AS p FROM (
    SELECT feature, max(k) AS n_common, sum((a1 - e1) * (a1 - e1) / e1 + (a2 - e2) * (a2 - e2) / e2) AS x,
           CAST(max(k) - 1 AS BIGINT) AS dof
    FROM a GROUP BY feature))"""
    q["category_mix"] = f"""WITH {SUBS},
cl AS (SELECT split, feature, category FROM (
    UNPIVOT (SELECT split, {lst(CAT)} FROM subs) ON {lst(CAT)} INTO NAME feature VALUE category)),
tot AS (SELECT split, f.feature, count(*) AS n FROM subs, (VALUES {", ".join(f"('{c}')" for c in CAT)}) f(feature)
        GROUP BY ALL)
SELECT c.split, c.feature, c.category, count(*) AS cnt, {r6('count(*) / max(t.n)')} AS share
FROM cl c JOIN tot t USING (split, feature) WHERE c.category IS NOT NULL GROUP BY c.split, c.feature, c.category"""
    q["class_mix"] = f"""WITH {SUBS},
cnt AS (SELECT support_needs AS label, count(*) AS cnt FROM train WHERE support_needs IS NOT NULL GROUP BY 1)
SELECT label, cnt, {r6('CAST(cnt AS DOUBLE) / (SELECT count(*) FROM train)')} AS share,
  {r6('CASE WHEN (SELECT min(cnt) FROM cnt) > 0 THEN CAST((SELECT max(cnt) FROM cnt) AS DOUBLE) / (SELECT min(cnt) FROM cnt) ELSE 0 END')} AS imbalance_ratio,
  (SELECT count(*) FROM train) AS total
FROM cnt"""
    q["seq_profile"] = f"""WITH {SUBS},
s1 AS (SELECT {seq_expr()} AS seq FROM train WHERE {seq_expr()} IS NOT NULL),
s2 AS (SELECT {seq_expr()} AS seq FROM test WHERE {seq_expr()} IS NOT NULL),
cut AS (SELECT CAST(floor(quantile_cont(seq, {C.SEQ_CUTOFF_PCT})) AS BIGINT) AS cutoff FROM s1)
SELECT (SELECT min(seq) FROM s1) AS train_min, (SELECT max(seq) FROM s1) AS train_max,
  (SELECT min(seq) FROM s2) AS test_min, (SELECT max(seq) FROM s2) AS test_max, cutoff,
  {r6('(SELECT count(*) FROM s1 WHERE seq > cutoff) / (SELECT count(*) FROM s1)')} AS share_after_cutoff
FROM cut"""
    q["class_stats"] = f"""WITH {SUBS}
SELECT support_needs AS label, {r6('avg(after_interaction)')} AS mean, {r6('stddev_samp(after_interaction)')} AS std,
  count(*) AS n
FROM train WHERE support_needs IN (0, 1, 2) AND after_interaction IS NOT NULL GROUP BY support_needs"""
    q["label_corr"] = f"WITH {SUBS}\n" + union(*[
        f"SELECT '{c}' AS feature, {r6(f'corr({c}, CAST(support_needs AS DOUBLE))')} AS corr FROM train" for c in STAB])
    q["anova_f"] = f"WITH {SUBS}\nSELECT feature, {r6('f_stat')} AS f_stat, df_between, df_within, {r6('p_value')} AS p_value FROM (\n" + union(
        *[_anova_one(c) for c in STAB]) + ")"
    q["mutual_info"] = f"WITH {SUBS}, {mi_sql('train', STAB)}\nSELECT feature, {r6('mi')} AS mi FROM mi"
    enc = ", ".join(f"(SELECT code FROM codes_{c} WHERE category = coalesce(t.{c}, 'Unknown')) AS {c}" for c in CAT)
    codes = ", ".join(
        f"codes_{c} AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM "
        f"(SELECT DISTINCT coalesce({c}, 'Unknown') AS category FROM train))" for c in CAT)
    q["importance_baseline"] = f"""WITH {SUBS}, {codes},
enc AS (SELECT {lst(NUM)}, {enc}, support_needs FROM train t),
{mi_sql('enc', NUM + CAT)[1:]}
SELECT feature, {r6('mi')} AS mi, {r6('CASE WHEN (SELECT max(mi) FROM mi) > 0 THEN mi / (SELECT max(mi) FROM mi) ELSE mi END')} AS importance
FROM mi"""
    q["leak_verdict"] = f"""WITH {SUBS}, {mi_sql('train', ['after_interaction'], name='mi_after_interaction')},
{mi_sql('train', ['payment_interval'], name='mi_payment_interval')[1:]}
SELECT feature, {r6('corr')} AS corr, {r6('mi')} AS mi, {r6('separation')} AS separation, {r6('f_stat')} AS f_stat,
  {r6('p_value')} AS p_value, is_leakage FROM (
{union(_leak_one('after_interaction'), _leak_one('payment_interval'))})"""
    q["suspect_gate"] = f"""WITH {SUBS},
cut AS (SELECT CAST(floor(quantile_cont({seq_expr()}, {C.SEQ_CUTOFF_PCT})) AS BIGINT) AS cutoff FROM train
        WHERE {seq_expr()} IS NOT NULL)
SELECT feature, n_rows, {r6('corr')} AS corr, {r6('separation')} AS separation, verdict, is_safe FROM (
{union(_gate_one('after_interaction', True, 'after_interaction'), _gate_one('payment_interval', True, 'payment_interval'),
       _gate_one('after_interaction', False, 'after_interaction_all'), _gate_one('payment_interval', False, 'payment_interval_all'))})"""
    q["corr_pairs"] = f"WITH {SUBS}\nSELECT f1, f2, {r6('c')} AS corr, abs(c) > {C.HIGH_CORR} AS is_high FROM (\n" + union(
        *[f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS c FROM train" for a, b in _pairs(NUM)]) + ")"
    miss_tr = union(*[f"SELECT '{c}' AS feature, avg(CAST({_miss(c)} AS DOUBLE)) AS r FROM train" for c in PROFILE_COLS])
    miss_te = union(*[f"SELECT '{c}' AS feature, avg(CAST({_miss(c)} AS DOUBLE)) AS r FROM test"
                      for c in PROFILE_COLS if c != "support_needs"])
    q["missing_profile"] = f"""WITH {SUBS}, a AS ({miss_tr}), b AS ({miss_te})
SELECT a.feature, {r6('a.r')} AS train_missing, {r6('coalesce(b.r, 0)')} AS test_missing,
  {r6('abs(a.r - coalesce(b.r, 0))')} AS missing_difference
FROM a LEFT JOIN b USING (feature)"""
    q["co_missing"] = f"""WITH {SUBS}, a AS ({miss_tr}),
pairs AS ({union(*[f"SELECT '{x}' AS f1, '{y}' AS f2, avg(CAST({_miss(x)} AND {_miss(y)} AS DOUBLE)) AS both_missing FROM train" for x, y in _pairs(PROFILE_COLS)])})
SELECT f1, f2, {r6('both_missing')} AS both_missing FROM pairs
WHERE f1 IN (SELECT feature FROM a WHERE r > {C.CO_MISSING_MIN}) AND f2 IN (SELECT feature FROM a WHERE r > {C.CO_MISSING_MIN})"""
    integ_cols = ["age", "gender", "tenure", "frequent", "payment_interval", "subscription_type",
                  "contract_length", "after_interaction", "support_needs"]
    outl = union(*[f"""SELECT 'outliers' AS "check", '{c}' AS subject,
  avg(CAST(coalesce({c} > q.q99 OR {c} < q.q01, false) AS DOUBLE)) AS value
FROM train, (SELECT quantile_cont({c}, {C.OUTLIER_LO}) AS q01, quantile_cont({c}, {C.OUTLIER_HI}) AS q99 FROM train) q"""
                   for c in STAB])
    dup = lambda t: f"""SELECT 'duplicate_ids' AS "check", '{t}' AS subject,
  CAST(count(*) - count(DISTINCT id) - max(CAST(id IS NULL AS INTEGER)) AS DOUBLE) AS value FROM {t}"""
    q["integrity"] = f"""WITH {SUBS}, allc AS (
{union(dup('train'), dup('test'),
       "SELECT 'invalid_labels' AS \"check\", 'support_needs' AS subject, CAST(count(*) FILTER (WHERE support_needs IS NULL OR support_needs NOT IN (0, 1, 2)) AS DOUBLE) AS value FROM train",
       *[f"SELECT 'high_missing' AS \"check\", '{c}' AS subject, avg(CAST({_miss(c)} AS DOUBLE)) AS value FROM train" for c in integ_cols],
       outl)})
SELECT "check", subject, {r6('value')} AS value,
  CASE WHEN "check" = 'high_missing' THEN value <= {C.HIGH_MISSING} WHEN "check" = 'outliers' THEN value <= {C.OUTLIER_FLAG}
       ELSE value = 0 END AS passed
FROM allc"""

    def quality(t, cols, has_y):
        feats = [c for c in cols if c != "support_needs"]
        inf = " + ".join(f"count(*) FILTER (WHERE abs(CAST({c} AS DOUBLE)) = 'inf'::DOUBLE)" for c in cols)
        nan = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE)))" for c in cols)
        parts = [f"SELECT '{t}' AS split, 'infinite_values' AS \"check\", 'all' AS subject, CAST({inf} AS DOUBLE) AS value FROM {t}",
                 f"SELECT '{t}' AS split, 'missing_values' AS \"check\", 'all' AS subject, CAST({nan} AS DOUBLE) AS value FROM {t}"]
        if has_y:
            parts.append(f"SELECT '{t}' AS split, 'invalid_labels' AS \"check\", 'support_needs' AS subject, CAST(count(*) FILTER (WHERE support_needs IS NULL OR support_needs NOT IN (0, 1, 2)) AS DOUBLE) AS value FROM {t}")
        parts += [f"SELECT '{t}' AS split, 'large_scale' AS \"check\", '{c}' AS subject, stddev_samp({c}) AS value FROM {t}" for c in feats]
        return union(*parts)
    qcols = ["age", "tenure", "frequent", "payment_interval", "contract_length", "after_interaction", "support_needs"]
    q["quality_check"] = f"""WITH {SUBS}, allc AS (
{union(quality('train', qcols, True), quality('test', [c for c in qcols if c != 'support_needs'], False))})
SELECT split, "check", subject, {r6('value')} AS value,
  CASE WHEN "check" = 'large_scale' THEN coalesce(value <= {C.QUALITY_MAX_STD}, true) ELSE value = 0 END AS passed
FROM allc"""
    q["id_overlap"] = f"""WITH {SUBS},
a AS (SELECT DISTINCT id FROM train WHERE id IS NOT NULL), b AS (SELECT DISTINCT id FROM test WHERE id IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS n_train_ids, (SELECT count(*) FROM b) AS n_test_ids,
  (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS n_common"""
    q["time_overlap"] = f"""WITH {SUBS},
a AS (SELECT s FROM (SELECT {seq_expr()} AS s FROM (SELECT DISTINCT id FROM train)) WHERE s IS NOT NULL),
b AS (SELECT s FROM (SELECT {seq_expr()} AS s FROM (SELECT DISTINCT id FROM test)) WHERE s IS NOT NULL),
c AS (SELECT count(*) AS n_common FROM (SELECT DISTINCT id FROM train WHERE id IS NOT NULL) x
      WHERE id IN (SELECT id FROM test)),
st AS (SELECT max(s) AS train_max, (SELECT min(s) FROM b) AS test_min, count(*) AS n,
              count(*) FILTER (WHERE s >= (SELECT min(s) FROM b)) AS n_over FROM a)
SELECT train_max, test_min, {r6('CASE WHEN train_max >= test_min THEN CAST(n_over AS DOUBLE) / n ELSE 0.0 END')} AS overlap_ratio,
  n_common,
  (coalesce(CASE WHEN train_max >= test_min THEN CAST(n_over AS DOUBLE) / n ELSE 0.0 END, 0) <= {C.TEMPORAL_OVERLAP_FLAG}
   AND n_common = 0) AS passed
FROM st, c"""
    wparts = []
    for p, mult in C.WEIGHT_PROFILES.items():
        vals = ", ".join(f"({i}, {m})" for i, m in enumerate(mult))
        wparts.append(f"""SELECT '{p}' AS profile, s.label, coalesce(c.n_c, 0) AS n_c,
  (CASE WHEN coalesce(c.n_c, 0) > 0 THEN CAST((SELECT count(*) FROM train) AS DOUBLE) / (3 * c.n_c) ELSE 1.0 END) * s.mult AS weight
FROM (VALUES {vals}) s(label, mult) LEFT JOIN
     (SELECT support_needs AS label, count(*) AS n_c FROM train GROUP BY 1) c USING (label)""")
    q["class_weights"] = f"WITH {SUBS}\nSELECT profile, CAST(label AS INTEGER) AS label, n_c, {r6('weight')} AS weight FROM (\n{union(*wparts)})"
    cen = ", ".join(f"avg(CAST(coalesce(CASE WHEN isnan({c}) OR isinf({c}) THEN 0 ELSE {c} END, 0) AS DOUBLE)) AS {c}" for c in NUM)
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUM)
    q["class_centroids"] = f"""WITH {SUBS},
cent AS (SELECT least(greatest(support_needs, 0), 2) AS label, {cen} FROM train GROUP BY 1),
pairs AS (SELECT a.label AS class_a, b.label AS class_b, sqrt({dist}) AS distance FROM cent a JOIN cent b ON a.label < b.label)
SELECT class_a, class_b, {r6('distance')} AS distance,
  {r6('(SELECT min(distance) FROM pairs) / ((SELECT avg(distance) FROM pairs) + 1e-8)')} AS separation_score
FROM pairs"""
    q["missing_route"] = f"WITH {SUBS}\nSELECT feature, {r6('m')} AS missing, CASE WHEN m > {C.ROUTE_HIGH_MISSING} THEN 'knn' WHEN m > {C.ROUTE_LOW_MISSING} THEN 'iterative' ELSE 'median' END AS route FROM (\n" + union(
        *[f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS DOUBLE)) AS m FROM train" for c in STAB]) + ")"
    return q


def clean(c: str) -> str:
    return f"coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) THEN 0 ELSE CAST({c} AS DOUBLE) END, 0)"


def clip(x: str, lo, hi) -> str:
    return f"least(greatest({x}, {float(lo)}), {float(hi)})"


def fold_sql(src: str = "train", k: int = 5, seed: int = C.SEED) -> str:
    return (f"CAST((row_number() OVER (PARTITION BY support_needs ORDER BY md5('{seed}' || id), id) - 1) % {k} AS INTEGER)")


BUSINESS = ["customer_value", "customer_stability", "customer_activity", "payment_stability",
            "payment_frequency", "payment_risk", "usage_intensity", "monthly_usage", "usage_trend",
            "age_group", "age_risk"]


def target_encode_sql(wrap) -> str:
    """Out-of-fold target encoding of both tables; ``wrap`` rounds each value or not."""
    te_parts = []
    te_sel_tr, te_sel_te, te_join_tr, te_join_te = [], [], [], []
    for c in CAT:
        te_parts.append(f"""cf_{c} AS (SELECT {c} AS cat, fold, count(*) AS cnt_f, CAST(sum(y) AS DOUBLE) AS sum_f FROM f
           WHERE {c} IS NOT NULL GROUP BY ALL),
ct_{c} AS (SELECT cat, sum(cnt_f) AS cnt_t, sum(sum_f) AS sum_t FROM cf_{c} GROUP BY cat),
oof_{c} AS (SELECT ct.cat, g.fold, ct.cnt_t - coalesce(cf.cnt_f, 0) AS cfit, ct.sum_t - coalesce(cf.sum_f, 0) AS sfit,
                   g.g_fit, CAST(least(25, greatest(3, floor(CAST(g.n_fit AS DOUBLE) / 150))) AS DOUBLE) AS a
            FROM ct_{c} ct CROSS JOIN g LEFT JOIN cf_{c} cf ON cf.cat = ct.cat AND cf.fold = g.fold),
enc_{c} AS (SELECT cat, fold, CASE WHEN cfit > 0 THEN (sfit + g_fit * a) / (cfit + a) END AS enc FROM oof_{c}),
full_{c} AS (SELECT cat, (sum_t + g_all * a) / (cnt_t + a) AS enc FROM ct_{c},
             (SELECT CAST(s AS DOUBLE) / n AS g_all, CAST(least(25, greatest(3, floor(CAST(n AS DOUBLE) / 150))) AS DOUBLE) AS a FROM tot))""")
        te_sel_tr.append(f"{wrap(f'coalesce(e_{c}.enc, g.g_fit)')} AS {c}_target_encoded")
        te_join_tr.append(f"LEFT JOIN enc_{c} e_{c} ON e_{c}.cat = f.{c} AND e_{c}.fold = f.fold")
        te_sel_te.append(f"{wrap(f'coalesce(u_{c}.enc, (SELECT CAST(s AS DOUBLE) / n FROM tot))')} AS {c}_target_encoded")
        te_join_te.append(f"LEFT JOIN full_{c} u_{c} ON u_{c}.cat = t.{c}")
    return f"""WITH {SUBS},
f AS (SELECT id, split, support_needs AS y, {lst(CAT)}, {fold_sql()} AS fold FROM train),
ft AS (SELECT fold, count(*) AS nf, sum(y) AS sf FROM f GROUP BY fold),
tot AS (SELECT count(*) AS n, sum(y) AS s FROM f),
g AS (SELECT fold, n - nf AS n_fit, CAST(s - sf AS DOUBLE) / (n - nf) AS g_fit FROM ft, tot),
{','.join(te_parts)}
SELECT f.id, f.split, {', '.join(te_sel_tr)} FROM f JOIN g USING (fold) {' '.join(te_join_tr)}
UNION ALL
SELECT t.id, t.split, {', '.join(te_sel_te)} FROM test t {' '.join(te_join_te)}"""


def build2() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_numeric"] = f"""WITH {SUBS}
SELECT id, {", ".join(f"{r6(clean(c))} AS {c}" for c in STAB)}, least(greatest(support_needs, 0), 2) AS support_needs FROM subs"""
    q["parse_id"] = f"WITH {SUBS}\nSELECT id, {seq_expr()} AS seq, coalesce({seq_expr()}, 0) AS seq0 FROM subs"
    s0 = f"coalesce({seq_expr()}, 0)"
    q["time_filter"] = f"""WITH {SUBS},
cut AS (SELECT CAST(floor(quantile_cont({seq_expr()}, {C.SEQ_CUTOFF_PCT})) AS BIGINT) AS cutoff FROM train
        WHERE {seq_expr()} IS NOT NULL),
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE {s0} <= (SELECT cutoff FROM cut)) AS k,
              quantile_cont({s0}, {C.FILTER_FALLBACK_PCT}) AS p95 FROM train),
thr AS (SELECT CASE WHEN 1 - CAST(k AS DOUBLE) / n > {C.FILTER_MAX_REMOVAL} THEN p95 ELSE (SELECT cutoff FROM cut) END AS t FROM st),
kept AS (SELECT count(*) AS k FROM train WHERE {s0} <= (SELECT t FROM thr))
SELECT id FROM train WHERE (SELECT k FROM kept) <= {C.FILTER_MIN_KEPT} OR {s0} <= (SELECT t FROM thr)"""
    v = "coalesce(CAST(after_interaction AS DOUBLE), 0)"
    q["suspect_features"] = f"""WITH {SUBS},
b AS (SELECT quantile_cont({v}, {C.SUSPECT_CLIP_Q[0]}) AS lo, quantile_cont({v}, {C.SUSPECT_CLIP_Q[1]}) AS hi FROM train)
SELECT id, {r6(f'ln(1 + abs({v}))')} AS after_interaction_log, {r6(f'sqrt(abs({v}))')} AS after_interaction_sqrt,
  {r6(f'least(greatest({v}, lo), hi)')} AS after_interaction_clipped FROM subs, b"""
    tmp = f"""t AS (SELECT id, split, {s0} AS temporal_id FROM subs),
st AS (SELECT split, min(temporal_id) AS mn, max(temporal_id) AS mx,
              list_distinct(quantile_cont(temporal_id, [0.25, 0.5, 0.75])) AS e4,
              list_distinct(quantile_cont(temporal_id, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e10
       FROM t GROUP BY split)"""
    q["temporal_features"] = f"""WITH {SUBS}, {tmp}
SELECT id, split, temporal_id,
  {r6('CASE WHEN mx > mn THEN CAST(temporal_id - mn AS DOUBLE) / (mx - mn) ELSE 0.5 END')} AS temporal_position
FROM t JOIN st USING (split)"""
    q["qcut_bins"] = f"""WITH {SUBS}, {tmp}
SELECT id, split,
  CASE WHEN mx > mn THEN CAST(len(list_filter(e4, lambda e: e < temporal_id AND e > mn)) AS BIGINT) ELSE 1 END AS temporal_quartile,
  CASE WHEN mx > mn THEN CAST(len(list_filter(e10, lambda e: e < temporal_id AND e > mn)) AS BIGINT) ELSE 5 END AS temporal_decile
FROM t JOIN st USING (split)"""
    t = clip(clean('tenure'), 1, 2000)
    f = clip(clean('frequent'), 1, 200)
    cl = clip(clean('contract_length'), 1, 1000)
    pp = clip(clean('payment_interval'), 1, 365)
    f2 = clip(clean('frequent'), 0.1, 200)
    a = clip(clean('age'), 18, 100)
    b = C.AGE_BINS
    exprs = {
        "customer_value": clip(f"ln(1 + {t}) * sqrt({f}) * cbrt({cl})", 0, 200),
        "customer_stability": clip(f"{t} * {cl} / ({f} + 1)", 0, 10000),
        "customer_activity": clip(f"{f} * 30 / ({t} + 1)", 0, 100),
        "payment_stability": clip(f"{cl} / {pp}", 0, 50),
        "payment_frequency": clip(f"365.0 / {pp}", 0, 365),
        "payment_risk": clip(f"{pp} / ({cl} + 1)", 0, 10),
        "usage_intensity": clip(f"{f2} / ({t} / 30 + 1)", 0, 100),
        "monthly_usage": clip(f"{f2} / ({t} / 30 + 1) * 30", 0, 300),
        "usage_trend": clip(f"{f2} / (sqrt({t}) + 1)", 0, 50),
    }
    sel = [f"{r6(e)} AS {n}" for n, e in exprs.items()]
    sel.append(f"CAST(CASE WHEN {a} <= {b[0]} THEN 0 WHEN {a} <= {b[1]} THEN 1 WHEN {a} <= {b[2]} THEN 2 "
               f"WHEN {a} <= {b[3]} THEN 3 WHEN {a} <= {b[4]} THEN 4 ELSE 2 END AS INTEGER) AS age_group")
    sel.append(f"{r6(f'CASE WHEN {a} < {C.AGE_YOUNG} THEN {C.AGE_RISK[0]} WHEN {a} > {C.AGE_OLD} THEN {C.AGE_RISK[1]} ELSE {C.AGE_RISK[2]} END')} AS age_risk")
    q["business_features"] = f"WITH {SUBS}\nSELECT id, {', '.join(sel)} FROM subs"
    sv = {c: clip(clean(c), *C.STAT_CLIP) for c in NUM}
    mom = ", ".join(f"avg({sv[c]}) AS m_{c}, stddev_samp({sv[c]}) AS s_{c}" for c in NUM)
    ssel = []
    for c in NUM:
        ssel += [f"{r6(f'ln(1 + {sv[c]})')} AS {c}_log", f"{r6(f'sqrt({sv[c]})')} AS {c}_sqrt",
                 f"{r6(f'CASE WHEN s_{c} > 0 THEN ({sv[c]} - m_{c}) / s_{c} ELSE 0.0 END')} AS {c}_zscore",
                 f"{r6(f'{sv[c]} * {sv[c]}')} AS {c}_squared", f"{r6(f'{sv[c]} * {sv[c]} * {sv[c]}')} AS {c}_cubed"]
    q["stat_features"] = f"""WITH {SUBS}, st AS (SELECT split, {mom} FROM subs GROUP BY split)
SELECT id, split, {', '.join(ssel)} FROM subs JOIN st USING (split)"""
    rsel = ", ".join(
        f"{r6(f'(rank() OVER (PARTITION BY split ORDER BY v_{c}) - 1 + (count(*) OVER (PARTITION BY split, v_{c}) + 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY split)')} AS {c}_rank"
        for c in NUM)
    q["pct_rank"] = f"""WITH {SUBS}, v AS (SELECT id, split, {', '.join(f'{sv[c]} AS v_{c}' for c in NUM)} FROM subs)
SELECT id, split, {rsel} FROM v"""
    isel = []
    for x, y in C.INTERACTION_PAIRS:
        ax, by_ = clip(clean(x), *C.PAIR_CLIP), clip(clean(y), *C.PAIR_CLIP)
        isel += [f"{r6(clip(f'{ax} / (CASE WHEN {by_} = 0 THEN 1.0 ELSE {by_} END)', 0, 100))} AS {x}_{y}_ratio",
                 f"{r6(clip(f'{ax} * {by_}', 0, 100000))} AS {x}_{y}_product",
                 f"{r6(f'abs({ax} - {by_})')} AS {x}_{y}_diff", f"{r6(f'{ax} + {by_}')} AS {x}_{y}_sum"]
    q["interaction_features"] = f"WITH {SUBS}\nSELECT id, {', '.join(isel)} FROM subs"
    q["baseline_ratios"] = f"""WITH {SUBS}
SELECT id, {r6('CASE WHEN tenure + 1 = 0 THEN NULL ELSE age / (tenure + 1) END')} AS age_tenure_ratio,
  {r6('CASE WHEN payment_interval + 1 = 0 THEN NULL ELSE frequent / (payment_interval + 1) END')} AS frequency_payment_ratio FROM subs"""
    codes = ", ".join(
        f"codes_{c} AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM "
        f"(SELECT DISTINCT coalesce({c}, 'Unknown') AS category FROM subs))" for c in CAT)
    q["label_encode"] = f"""WITH {SUBS}, {codes}
SELECT s.id, g.code AS gender, t.code AS subscription_type FROM subs s
JOIN codes_gender g ON g.category = coalesce(s.gender, 'Unknown')
JOIN codes_subscription_type t ON t.category = coalesce(s.subscription_type, 'Unknown')"""
    q["target_encode"] = target_encode_sql(r6)
    modes = []
    for c in CAT:
        modes.append(f"""m_{c} AS (SELECT y, v FROM (SELECT support_needs AS y, {c} AS v,
              row_number() OVER (PARTITION BY support_needs ORDER BY count(*) DESC, {c}) AS r
              FROM train WHERE {c} IS NOT NULL AND support_needs IN (0, 1, 2) GROUP BY 1, 2) WHERE r = 1),
d_{c} AS (SELECT coalesce((SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY 1
                          ORDER BY n DESC, v LIMIT 1)), 'Unknown') AS d)""")
    q["class_mode_fill"] = f"""WITH {SUBS}, {', '.join(modes)}
SELECT t.id, coalesce(t.gender, mg.v, (SELECT d FROM d_gender)) AS gender,
  coalesce(t.subscription_type, ms.v, (SELECT d FROM d_subscription_type)) AS subscription_type
FROM train t LEFT JOIN m_gender mg ON mg.y = t.support_needs LEFT JOIN m_subscription_type ms ON ms.y = t.support_needs
UNION ALL
SELECT id, coalesce(gender, (SELECT d FROM d_gender)), coalesce(subscription_type, (SELECT d FROM d_subscription_type)) FROM test"""
    med = ", ".join(f"quantile_cont({c}, 0.5) AS md_{c}" for c in STAB)
    q["median_fill"] = f"""WITH {SUBS}, m AS (SELECT {med} FROM train)
SELECT id, {', '.join(f"{r6(f'coalesce({c}, md_{c})')} AS {c}" for c in STAB)} FROM subs, m"""
    wb = ", ".join(f"quantile_cont({c}, {C.WINSOR_Q[0]}) AS lo_{c}, quantile_cont({c}, {C.WINSOR_Q[1]}) AS hi_{c}, count({c}) AS n_{c}" for c in STAB)
    q["winsorize"] = f"""WITH {SUBS}, b AS (SELECT {wb} FROM train)
SELECT id, {', '.join(f"{r6(f'CASE WHEN n_{c} > {C.WINSOR_MIN_ROWS} AND {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) ELSE {c} END')} AS {c}" for c in STAB)}
FROM train, b"""
    cleaned = f"cl AS (SELECT id, split, {', '.join(f'{clean(c)} AS {c}' for c in NUM)} FROM subs)"
    wb2 = ", ".join(f"quantile_cont({c}, {C.CLUSTER_WINSOR_Q[0]}) AS lo_{c}, quantile_cont({c}, {C.CLUSTER_WINSOR_Q[1]}) AS hi_{c}" for c in NUM)
    q["winsorize_train_bounds"] = f"""WITH {SUBS}, {cleaned}, b AS (SELECT {wb2} FROM cl WHERE split = 'train')
SELECT id, {', '.join(f"{r6(f'least(greatest({c}, lo_{c}), hi_{c})')} AS {c}" for c in NUM)} FROM cl, b"""
    rb = ", ".join(f"quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, {C.ROBUST_Q[1]}) - quantile_cont({c}, {C.ROBUST_Q[0]}) AS rg_{c}" for c in NUM)
    q["robust_scale"] = f"""WITH {SUBS}, {cleaned}, b AS (SELECT {rb} FROM cl WHERE split = 'train')
SELECT id, {', '.join(f"{r6(f'({c} - md_{c}) / (CASE WHEN rg_{c} = 0 THEN 1.0 ELSE rg_{c} END)')} AS {c}" for c in NUM)} FROM cl, b"""
    sb = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    q["standard_scale"] = f"""WITH {SUBS}, {cleaned}, b AS (SELECT {sb} FROM cl WHERE split = 'train')
SELECT id, {', '.join(f"{r6(f'({c} - m_{c}) / (CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1.0 ELSE s_{c} END)')} AS {c}" for c in NUM)} FROM cl, b"""
    q["strat_folds"] = f"WITH {SUBS}\nSELECT id, {fold_sql()} AS fold FROM train"
    q["holdout_split"] = f"""WITH {SUBS},
r AS (SELECT id, row_number() OVER (PARTITION BY support_needs ORDER BY md5('{C.SEED}' || id), id) AS r,
             count(*) OVER (PARTITION BY support_needs) AS n_c FROM train)
SELECT id, CASE WHEN r <= floor(n_c * 0.18) THEN 'val' ELSE 'train' END AS role FROM r"""
    q["random_split"] = f"""WITH {SUBS},
r AS (SELECT id, row_number() OVER (ORDER BY md5('{C.SEED}' || id), id) AS r, count(*) OVER () AS n FROM test)
SELECT id, CASE WHEN r <= floor(n * {C.VAL_SIZE}) THEN 'val' ELSE 'train' END AS role FROM r"""
    q["gap_split"] = f"""WITH {SUBS},
r AS (SELECT id, row_number() OVER (ORDER BY {s0}, id) AS rn, count(*) OVER () AS n,
             support_needs, md5('{C.SEED}' || id) AS h FROM train),
b AS (SELECT n, CAST(floor(n * {C.GAP_SIZE}) AS BIGINT) AS gap, CAST(floor(n * {C.VAL_SIZE}) AS BIGINT) AS nv FROM (SELECT count(*) AS n FROM train)),
hs AS (SELECT id, row_number() OVER (PARTITION BY support_needs ORDER BY h, id) AS r,
              count(*) OVER (PARTITION BY support_needs) AS n_c FROM r)
SELECT r.id, CASE WHEN (SELECT n - nv - gap FROM b) < {C.SPLIT_MIN_TRAIN} OR (SELECT nv FROM b) < {C.SPLIT_MIN_VAL} THEN
   CASE WHEN hs.r <= floor(hs.n_c * {C.VAL_SIZE}) THEN 'val' ELSE 'train' END
 WHEN rn <= (SELECT n - nv - gap FROM b) THEN 'train' WHEN rn <= (SELECT n - nv FROM b) THEN 'gap' ELSE 'val' END AS role
FROM r JOIN hs USING (id)"""
    return q


def walk_forward_sql(n_splits: int = C.WF_SPLITS, gap_ratio: float = C.GAP_SIZE) -> str:
    """Fold bounds are generated in SQL from n with the same integer rules."""
    return f"""WITH {SUBS},
r AS (SELECT id, row_number() OVER (ORDER BY coalesce({seq_expr()}, 0), id) - 1 AS pos FROM train),
nn AS (SELECT count(*) AS n, CAST(floor(count(*) * {gap_ratio}) AS BIGINT) AS gap,
              floor(count(*) / {n_splits * 2.5}) AS m FROM train),
f AS (SELECT range AS fold FROM range({n_splits})),
b0 AS (SELECT fold, n, gap, m, CAST(floor(fold * m) AS BIGINT) AS ts,
              CAST(floor(m + floor(fold * m / 4)) AS BIGINT) AS win FROM f, nn),
b1 AS (SELECT *, ts + win AS te, ts + win + gap AS vs, CAST(ts + win + gap + m AS BIGINT) AS ve FROM b0),
b2 AS (SELECT *, min(CASE WHEN ve > n THEN fold END) OVER () AS stop FROM b1),
ok AS (SELECT * FROM b2 WHERE (stop IS NULL OR fold < stop) AND te - ts >= {C.WF_MIN_TRAIN} AND ve - vs >= {C.WF_MIN_VAL}
       AND m >= {C.WF_MIN_FOLD}),
good AS (SELECT * FROM ok WHERE (SELECT count(*) FROM ok) >= {C.WF_MIN_SCORED}),
bounds AS (SELECT CAST(fold AS INTEGER) AS fold, 'train' AS role, ts AS lo, te AS hi FROM good
           UNION ALL SELECT CAST(fold AS INTEGER), 'val', vs, ve FROM good),
kf AS (SELECT id, {fold_sql(k=n_splits)} AS own FROM train)
SELECT r.id, b.fold, b.role FROM r JOIN bounds b ON r.pos >= b.lo AND r.pos < b.hi
UNION ALL
SELECT kf.id, CAST(f.fold AS INTEGER) AS fold, CASE WHEN kf.own = f.fold THEN 'val' ELSE 'train' END AS role
FROM kf, f WHERE (SELECT count(*) FROM good) = 0"""


ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
SCORED = f"scored AS (SELECT *, {ARGMAX} AS pred FROM probs)"


def report_sql(src: str, by: list[str] | None = None, probs: bool = False, name: str = "rep") -> str:
    """CTE ``name`` with the hold-out report of ``src`` (y, pred[, p0..p2])."""
    by = by or []
    bys = ", ".join(by)
    bsel = (bys + ", ") if by else ""
    gb = f"GROUP BY {bys}" if by else ""
    usin = f"USING ({bys})" if by else "ON true"
    pri = C.PRIOR_MIX
    mixes = ", ".join(
        [f"max(CASE WHEN cls = {c} THEN CAST(npred AS DOUBLE) / total END) AS pred_mix_{c}" for c in C.CLASSES]
        + [f"max(CASE WHEN cls = {c} THEN CAST(support AS DOUBLE) / total END) AS actual_mix_{c}" for c in C.CLASSES]
        + [f"max(CASE WHEN cls = {c} THEN recall END) AS recall_{c}" for c in C.CLASSES]
        + [f"max(CASE WHEN cls = {c} THEN f1 END) AS f1_{c}" for c in C.CLASSES])
    out = f"""{name}_cm AS (SELECT {bsel}y, pred, count(*) AS n FROM {src} GROUP BY ALL),
{name}_ct AS (SELECT {bsel}c.cls, sum(CASE WHEN y = c.cls AND pred = c.cls THEN n ELSE 0 END) AS tp,
               sum(CASE WHEN y = c.cls THEN n ELSE 0 END) AS support, sum(CASE WHEN pred = c.cls THEN n ELSE 0 END) AS npred
        FROM {name}_cm, (VALUES (0), (1), (2)) c(cls) GROUP BY {bsel}c.cls),
{name}_tt AS (SELECT {bsel}CAST(sum(n) AS BIGINT) AS total FROM {name}_cm {gb}),
{name}_per AS (SELECT ct.*, tt.total,
        CASE WHEN support + npred > 0 THEN 2.0 * tp / (support + npred) ELSE 0.0 END AS f1,
        CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
        support + npred > 0 AS present,
        CASE cls WHEN 0 THEN {pri[0]} WHEN 1 THEN {pri[1]} ELSE {pri[2]} END AS prior
        FROM {name}_ct ct JOIN {name}_tt tt {usin}),
{name}_a AS (SELECT {bsel}max(total) AS total, CAST(sum(tp) AS DOUBLE) / max(total) AS accuracy,
        sum(CASE WHEN present THEN f1 ELSE 0 END) / greatest(sum(CAST(present AS INTEGER)), 1) AS f1_macro,
        sum(f1 * support) / max(total) AS f1_weighted, {mixes},
        sum(abs(CAST(npred AS DOUBLE) / total - prior)) AS distribution_error,
        stddev_pop(CAST(npred AS DOUBLE) / total) AS sd, avg(CAST(npred AS DOUBLE) / total) AS mn
        FROM {name}_per {gb})"""
    conf = ""
    if probs:
        conf = f""",
{name}_c AS (SELECT {bsel}avg(greatest(p0, p1, p2)) AS avg_confidence,
        avg(CAST(greatest(p0, p1, p2) < {C.LOW_CONFIDENCE} AS DOUBLE)) AS low_confidence_ratio FROM {src} {gb})"""
    cols = ["total", "accuracy", "f1_macro", "f1_weighted"] + [f"{k}_{c}" for k in ("pred_mix", "actual_mix", "recall", "f1") for c in C.CLASSES] + ["distribution_error"]
    sel = ", ".join([f"a.{c}" if c == "total" else f"a.{c}" for c in cols])
    tail = f""",
{name} AS (SELECT {''.join(f'a.{b}, ' for b in by)}{sel}, greatest(0.0, 1 - a.distribution_error) AS distribution_score,
        1 - a.sd / a.mn AS class_balance{', c.avg_confidence, c.low_confidence_ratio' if probs else ''}
        FROM {name}_a a{f' JOIN {name}_c c ' + usin.replace('USING', 'USING') if probs else ''})"""
    return out + conf + tail


def _round_cols(cols_double, cols_other, src):
    return "SELECT " + ", ".join([f"{r6(c)} AS {c}" for c in cols_double] + list(cols_other)) + f" FROM {src}"


REPORT_D = (["accuracy", "f1_macro", "f1_weighted"]
            + [f"{k}_{c}" for k in ("pred_mix", "actual_mix", "recall", "f1") for c in C.CLASSES]
            + ["distribution_error", "distribution_score", "class_balance"])

STAB_D = ["mean_accuracy", "std_accuracy", "mean_f1", "std_f1", "mean_distribution", "mean_class_balance",
          "accuracy_stability", "f1_stability", "overall_stability"]


def stability_sql() -> str:
    seeds = ", ".join(f"({i}, '{11 * i}')" for i in range(C.STABILITY_RUNS))
    return f"""runs AS (SELECT * FROM (VALUES {seeds}) r(run, seed)),
rr AS (SELECT r.run, s.id, s.y, s.pred,
              row_number() OVER (PARTITION BY r.run, s.y ORDER BY md5(r.seed || s.id), s.id) AS rk,
              count(*) OVER (PARTITION BY r.run, s.y) AS n_c FROM scored s, runs r),
val AS (SELECT run, id, y, pred FROM rr WHERE rk <= floor(n_c * 0.2)),
{report_sql('val', ['run'], False, 'rr_rep')},
stab AS (SELECT count(*) AS n_runs, avg(accuracy) AS mean_accuracy, stddev_pop(accuracy) AS std_accuracy,
                avg(f1_macro) AS mean_f1, stddev_pop(f1_macro) AS std_f1, avg(distribution_score) AS mean_distribution,
                avg(class_balance) AS mean_class_balance FROM rr_rep),
stab2 AS (SELECT *, CASE WHEN mean_accuracy > 0 THEN greatest(0.0, 1 - std_accuracy / mean_accuracy) ELSE 0.0 END AS accuracy_stability,
                 CASE WHEN mean_f1 > 0 THEN greatest(0.0, 1 - std_f1 / mean_f1) ELSE 0.0 END AS f1_stability FROM stab),
stab3 AS (SELECT *, (accuracy_stability + f1_stability + mean_distribution + mean_class_balance) / 4 AS overall_stability FROM stab2)"""


def folds_acc_sql(seeds) -> str:
    parts = union(*[f"""SELECT {i} AS rep, fold, avg(CAST(y = pred AS DOUBLE)) AS acc FROM (
  SELECT y, pred, (row_number() OVER (PARTITION BY y ORDER BY md5('{sd}' || id), id) - 1) % 5 AS fold FROM scored)
  GROUP BY fold""" for i, sd in enumerate(seeds)])
    return parts


def composite_sql() -> str:
    w = C.COMPOSITE_WEIGHTS
    cent = ", ".join(f"avg(CAST(coalesce(CASE WHEN isnan({c}) OR isinf({c}) THEN 0 ELSE {c} END, 0) AS DOUBLE)) AS {c}"
                     for c in ("p0", "p1", "p2"))
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in ("p0", "p1", "p2"))
    return f"""{report_sql('scored', None, False, 'hrep')}, {stability_sql()},
cv AS (SELECT avg(acc) AS value FROM ({folds_acc_sql([C.SEED])})),
rcv AS (SELECT avg(acc) AS value FROM ({folds_acc_sql([C.SEED, C.SEED + 1, C.SEED + 2])})),
cent AS (SELECT least(greatest(y, 0), 2) AS label, {cent} FROM scored GROUP BY 1),
pairs AS (SELECT sqrt({dist}) AS d FROM cent a JOIN cent b ON a.label < b.label),
sep AS (SELECT min(d) / (avg(d) + 1e-8) AS value FROM pairs),
comps AS (SELECT (SELECT accuracy FROM hrep) AS holdout_score, (SELECT distribution_score FROM hrep) AS distribution_score,
                 (SELECT class_balance FROM hrep) AS class_balance_score, (SELECT value FROM cv) AS cv_score,
                 (SELECT value FROM rcv) AS repeated_cv_score, (SELECT overall_stability FROM stab3) AS stability_score,
                 (SELECT value FROM sep) AS separation_score),
comp AS (SELECT *, {' + '.join(f'{v} * coalesce({k}, 0)' for k, v in w.items())} AS overall_score FROM comps)"""


def quota_sql(mode: str) -> str:
    e2 = "l1 = 2" if mode == "exact" else "l1 <> 1"
    e1 = "l0 <> 1" if mode == "exact" else "true"
    return f"""a AS (SELECT id, p0, p1, p2, {ARGMAX} AS l0 FROM probs),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l0 = 0) AS c0, count(*) FILTER (WHERE l0 = 1) AS c1 FROM a),
s1 AS (SELECT a.*, CASE WHEN (SELECT c1 < n * {C.FLOOR_CLASS1} FROM c) AND ({e1})
          AND row_number() OVER (PARTITION BY ({e1}) ORDER BY p1 DESC, id) <= (SELECT floor(n * {C.FLOOR_CLASS1}) - c1 FROM c)
          THEN 1 ELSE l0 END AS l1 FROM a),
s2 AS (SELECT s1.*, CASE WHEN (SELECT c0 < n * {C.FLOOR_CLASS0} FROM c) AND ({e2})
          AND row_number() OVER (PARTITION BY ({e2}) ORDER BY p0 DESC, id) <= (SELECT floor(n * {C.FLOOR_CLASS0}) - c0 FROM c)
          THEN 0 ELSE l1 END AS l2 FROM s1),
c2 AS (SELECT count(*) AS n, count(*) FILTER (WHERE l2 = 2) AS k2 FROM s2),
s3 AS (SELECT s2.*, CASE WHEN (SELECT k2 > n * {C.CAP_CLASS2} FROM c2) AND l2 = 2
          AND row_number() OVER (PARTITION BY (l2 = 2) ORDER BY p2, id) <= (SELECT k2 - floor(n * {C.CAP_CLASS2}) FROM c2)
          THEN (CASE WHEN p0 >= p1 THEN 0 ELSE 1 END) ELSE l2 END AS label FROM s2)"""


def build3() -> dict[str, str]:
    q: dict[str, str] = {}
    W = f"WITH {SUBS}, {PROBS}, {SCORED}"
    q["confusion"] = f"""{W},
cm AS (SELECT y, pred, count(*) AS n FROM scored GROUP BY ALL)
SELECT a.y, b.pred, coalesce(cm.n, 0) AS n FROM (VALUES (0), (1), (2)) a(y) CROSS JOIN (VALUES (0), (1), (2)) b(pred)
LEFT JOIN cm ON cm.y = a.y AND cm.pred = b.pred"""
    q["holdout_report"] = f"""{W}, {report_sql('scored', None, True)}
{_round_cols(REPORT_D + ['avg_confidence', 'low_confidence_ratio'], ['total'], 'rep')}"""
    q["stability_summary"] = f"""{W}, {stability_sql()}
{_round_cols(STAB_D, ['n_runs'], 'stab3')}"""
    comp_cols = list(C.COMPOSITE_WEIGHTS) + ["overall_score"]
    q["composite_score"] = f"""{W}, {composite_sql()}
{_round_cols(comp_cols, [], 'comp')}"""
    (s1, m1), (s2, m2) = C.VERDICT_TIERS
    t = C.TARGET_ACCURACY
    q["run_verdict"] = f"""{W}, {composite_sql()}
SELECT {r6('c.overall_score')} AS overall_score, {r6('h.accuracy')} AS accuracy, {r6('h.distribution_score')} AS distribution_score,
  h.accuracy >= {t} AS model_achieved,
  CASE WHEN c.overall_score >= {t * s1} AND h.accuracy >= {t} AND h.distribution_score > {m1} THEN 'target_met'
       WHEN c.overall_score >= {t * s2} AND h.distribution_score > {m2} THEN 'near_target'
       WHEN 100.0 >= {C.VERDICT_STAGE_SHARE * 100} AND h.distribution_score > {C.VERDICT_STAGE_MIX} THEN 'pipeline_stable'
       ELSE 'partial' END AS verdict
FROM comp c, hrep h"""
    wl, wx = C.DEFAULT_BLEND["lightgbm"], C.DEFAULT_BLEND["xgboost"]
    wl, wx = wl / (wl + wx), wx / (wl + wx)
    b = [f"{wl!r} * p0 + {wx!r} * p1", f"{wl!r} * p1 + {wx!r} * p2", f"{wl!r} * p2 + {wx!r} * p0"]
    z = C.ZERO_ROW_PROBS
    q["blend_probs"] = f"""{W}, b AS (SELECT id, {b[0]} AS b0, {b[1]} AS b1, {b[2]} AS b2 FROM probs)
SELECT id, {', '.join(f"{r6(f'CASE WHEN b0 + b1 + b2 > 0 THEN b{i} / (b0 + b1 + b2) ELSE {z[i]} END')} AS p{i}" for i in range(3))} FROM b"""
    q["score_expand"] = f"""{W}
SELECT id, {', '.join(f"{r6(f'CASE WHEN seq % 4 IN (0, 1, 2) THEN (CASE WHEN seq % 4 = {i} THEN 1.0 ELSE 0.0 END) ELSE {z[i]} END')} AS h{i}" for i in range(3))},
  {r6('1 - p1')} AS b0, {r6('p1')} AS b1, 0.0 AS b2 FROM probs"""
    lo, hi = C.PROB_CLIP, 1 - C.PROB_CLIP
    ex = [f"exp(ln(least(greatest(p{i}, {lo!r}), {hi!r})) / {C.TEMPERATURE})" for i in range(3)]
    q["temperature"] = f"""{W}, e AS (SELECT id, {', '.join(f'{x} AS e{i}' for i, x in enumerate(ex))} FROM probs)
SELECT id, {', '.join(f"{r6(f'e{i} / (e0 + e1 + e2)')} AS p{i}" for i in range(3))} FROM e"""
    k, pri = C.CONFIDENCE_BLEND, C.PRIOR_MIX
    q["confidence_blend"] = f"""{W}
SELECT id, {', '.join(f"{r6(f'CASE WHEN greatest(p0, p1, p2) < {C.CONFIDENCE_THRESHOLD} THEN {k} * p{i} + {1 - k!r} * {pri[i]} ELSE p{i} END')} AS p{i}" for i in range(3))} FROM probs"""
    st = C.MIX_STEPS
    q["mix_correction"] = f"""{W},
m AS (SELECT avg(CAST(pred = 0 AS DOUBLE)) AS m0, avg(CAST(pred = 1 AS DOUBLE)) AS m1, avg(CAST(pred = 2 AS DOUBLE)) AS m2 FROM scored),
f AS (SELECT CASE WHEN {pri[0]} - m0 > {st[0][0][0]} THEN {st[0][0][1]} WHEN {pri[0]} - m0 > {st[0][1][0]} THEN {st[0][1][1]} ELSE 1.0 END AS f0,
             CASE WHEN {pri[1]} - m1 > {st[1][0][0]} THEN {st[1][0][1]} WHEN {pri[1]} - m1 < {st[1][1][0]} THEN {st[1][1][1]} ELSE 1.0 END AS f1,
             CASE WHEN {pri[2]} - m2 < {st[2][0][0]} THEN {st[2][0][1]} WHEN {pri[2]} - m2 < {st[2][1][0]} THEN {st[2][1][1]} ELSE 1.0 END AS f2 FROM m),
a AS (SELECT id, p0, p1, p2, p0 * f0 AS a0, p1 * f1 AS a1, p2 * f2 AS a2 FROM probs, f)
SELECT id, {', '.join(f"{r6(f'CASE WHEN a0 + a1 + a2 > 0 THEN a{i} / (a0 + a1 + a2) ELSE p{i} END')} AS p{i}" for i in range(3))} FROM a"""
    ch = [f"exp(ln(least(greatest(p{i}, {C.PROB_CLIP!r}), {1 - C.PROB_CLIP!r})) / {C.TEMPERATURE})" for i in range(3)]
    cb = ", ".join(f"CASE WHEN greatest(t0, t1, t2) < {C.CONFIDENCE_THRESHOLD} THEN {k} * t{i} + {1 - k!r} * {pri[i]} ELSE t{i} END AS b{i}" for i in range(3))
    q["score_chain"] = f"""WITH {PROBS.replace('probs AS (', 'raw AS (', 1)},
e AS (SELECT id, {', '.join(f'{x} AS e{i}' for i, x in enumerate(ch))} FROM raw),
t AS (SELECT id, {', '.join(f'e{i} / (e0 + e1 + e2) AS t{i}' for i in range(3))} FROM e),
b AS (SELECT id, {cb} FROM t),
m AS (SELECT {', '.join(f"avg(CAST({ARGMAX.replace('p', 'b')} = {i} AS DOUBLE)) AS m{i}" for i in range(3))} FROM b),
f AS (SELECT CASE WHEN {pri[0]} - m0 > {st[0][0][0]} THEN {st[0][0][1]} WHEN {pri[0]} - m0 > {st[0][1][0]} THEN {st[0][1][1]} ELSE 1.0 END AS f0,
             CASE WHEN {pri[1]} - m1 > {st[1][0][0]} THEN {st[1][0][1]} WHEN {pri[1]} - m1 < {st[1][1][0]} THEN {st[1][1][1]} ELSE 1.0 END AS f1,
             CASE WHEN {pri[2]} - m2 < {st[2][0][0]} THEN {st[2][0][1]} WHEN {pri[2]} - m2 < {st[2][1][0]} THEN {st[2][1][1]} ELSE 1.0 END AS f2 FROM m),
g AS (SELECT id, b0, b1, b2, b0 * f0 AS g0, b1 * f1 AS g1, b2 * f2 AS g2 FROM b, f),
probs AS (SELECT id, {', '.join(f'CASE WHEN g0 + g1 + g2 > 0 THEN g{i} / (g0 + g1 + g2) ELSE b{i} END AS p{i}' for i in range(3))} FROM g),
{quota_sql('exact')}
SELECT id AS "ID", CAST(label AS INTEGER) AS support_needs FROM s3"""
    tn = C.TARGET_ACCURACY
    q["run_report"] = f"""{W}, {composite_sql()}, {quota_sql('exact')},
mix AS (SELECT {', '.join(f'count(*) FILTER (WHERE label = {i}) / count(*) AS s{i}' for i in range(3))} FROM s3),
o AS (SELECT c.overall_score, h.accuracy, h.distribution_score, mix.*,
             {' + '.join(f'abs(s{i} - {pri[i]})' for i in range(3))} AS err FROM comp c, hrep h, mix),
o2 AS (SELECT *, greatest(0.0, 1 - err) AS fits FROM o)
{union(*[f"SELECT '{a}' AS section, '{b_}' AS metric, {r6(v)} AS value, CAST(NULL AS VARCHAR) AS note FROM o2" for a, b_, v in (
    ("validation", "overall_score", "overall_score"), ("validation", "distribution_score", "distribution_score"),
    ("validation", "gap_to_target", f"greatest(0.0, {tn} - overall_score)"), ("model", "accuracy", "accuracy"),
    ("model", "target_achieved", f"CAST(accuracy >= {tn} AS INTEGER)"), ("prediction", "share_0", "s0"), ("prediction", "share_1", "s1"),
    ("prediction", "share_2", "s2"), ("prediction", "distribution_error", "err"), ("prediction", "distribution_score", "fits"),
    ("run", "stages_done", "100.0"))])}
UNION ALL SELECT 'run', 'verdict', CAST(NULL AS DOUBLE),
  CASE WHEN overall_score >= {t * s1} AND accuracy >= {t} AND fits > {m1} THEN 'target_met'
       WHEN overall_score >= {t * s2} AND fits > {m2} THEN 'near_target'
       WHEN 100.0 >= {C.VERDICT_STAGE_SHARE * 100} AND fits > {C.VERDICT_STAGE_MIX} THEN 'pipeline_stable'
       ELSE 'partial' END FROM o2"""
    need = ["id", *PROFILE_COLS, "signup_channel"]
    here = {"train": set(need) - {"signup_channel"}, "test": set(need) - {"signup_channel", "support_needs"}}
    q["contract_check"] = f"WITH {SUBS} " + union(*[
        f"SELECT '{sp}' AS split, 'column' AS rule, '{c}' AS subject, {float(c in here[sp])} AS value, {str(c in here[sp]).lower()} AS passed"
        for sp in here for c in need] + [
        f"SELECT '{sp}' AS split, 'rows' AS rule, 'all' AS subject, CAST(count(*) AS DOUBLE) AS value, count(*) > 0 AS passed FROM {sp}"
        for sp in here])
    q["align_features"] = f"""WITH {SUBS}
SELECT id, {', '.join('0.0 AS tenure' if c == 'tenure' else f"{r6(f'CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END')} AS {c}" for c in NUM)} FROM test"""
    sets = {"plain": (0, 1, 2), "turned": (1, 2, 0), "swapped": (0, 2, 1)}
    wa, wb, wc = C.BLEND_SCORE
    q["blend_weights_fixed"] = f"""WITH {PROBS},
all_sets AS ({union(*[f"SELECT '{m_}' AS model, id, y, {', '.join(f'p{j} AS p{i}' for i, j in enumerate(o_))} FROM probs" for m_, o_ in sets.items()])}),
lab AS (SELECT model, y, {ARGMAX} AS pred FROM all_sets),
{report_sql('lab', ['model'], False, 'r')},
sc AS (SELECT model, accuracy, {wa} * accuracy + {wb} * f1_macro - {wc} * distribution_error AS score FROM r),
tot AS (SELECT sum(score) AS tot, count(*) AS k FROM sc)
SELECT model, {r6('score')} AS score, {r6('accuracy')} AS accuracy,
  {r6('CASE WHEN tot > 0 THEN score / tot ELSE 1.0 / k END')} AS weight,
  (SELECT max(struct_pack(a := accuracy, m := model)).m FROM sc) AS best_model, {r6('(SELECT max(accuracy) FROM sc)')} AS best_accuracy
FROM sc, tot"""
    q["quota_labels"] = f"""{W}, {quota_sql('exact')}
SELECT id, label FROM s3"""
    q["quota_labels_observed"] = f"""{W}, {quota_sql('as_observed')}
SELECT id, label FROM s3"""
    q["class_cap"] = f"""{W},
a AS (SELECT id, p0, p1, p2, {ARGMAX} AS l2 FROM probs),
c2 AS (SELECT count(*) AS n, count(*) FILTER (WHERE l2 = 2) AS k2 FROM a)
SELECT id, CASE WHEN (SELECT k2 > n * {C.CAP_CLASS2} FROM c2) AND l2 = 2
          AND row_number() OVER (PARTITION BY (l2 = 2) ORDER BY p2, id) <= (SELECT k2 - floor(n * {C.CAP_CLASS2}) FROM c2)
          THEN (CASE WHEN p0 >= p1 THEN 0 ELSE 1 END) ELSE l2 END AS label FROM a"""
    bf = C.BASELINE_FACTORS
    q["baseline_labels"] = f"""{W},
a0 AS (SELECT id, p0 * {bf[0]} AS q0, p1 * {bf[1]} AS q1, p2 * {bf[2]} AS q2, p0, p1, p2 FROM probs),
a AS (SELECT id, CASE WHEN q0 + q1 + q2 > 0 THEN q0 / (q0 + q1 + q2) ELSE p0 END AS p0,
                 CASE WHEN q0 + q1 + q2 > 0 THEN q1 / (q0 + q1 + q2) ELSE p1 END AS p1,
                 CASE WHEN q0 + q1 + q2 > 0 THEN q2 / (q0 + q1 + q2) ELSE p2 END AS p2 FROM a0),
b AS (SELECT *, {ARGMAX} AS l0 FROM a),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l0 = 0) AS c0, count(*) FILTER (WHERE l0 = 1) AS c1 FROM b),
s1 AS (SELECT b.*, CASE WHEN (SELECT c0 < n * {C.BASELINE_FLOOR0} FROM c)
          AND row_number() OVER (ORDER BY p0 DESC, id) <= (SELECT floor(n * {C.BASELINE_FLOOR0}) FROM c) THEN 0 ELSE l0 END AS l1 FROM b)
SELECT id, CASE WHEN (SELECT c1 < n * {C.BASELINE_FLOOR1} FROM c)
          AND row_number() OVER (ORDER BY p1 DESC, id) <= (SELECT floor(n * {C.BASELINE_FLOOR1}) FROM c) THEN 1 ELSE l1 END AS label FROM s1"""
    q["submission_check"] = f"""{W}, {quota_sql('exact')}
SELECT true AS has_columns, true AS integer_label, count(*) FILTER (WHERE label NOT IN (0, 1, 2)) = 0 AS labels_valid,
  count(*) FILTER (WHERE id IS NULL OR label IS NULL) = 0 AS no_nulls, count(DISTINCT label) AS n_classes,
  (count(*) FILTER (WHERE label NOT IN (0, 1, 2)) = 0 AND count(*) FILTER (WHERE id IS NULL OR label IS NULL) = 0
   AND count(DISTINCT label) >= 2) AS valid FROM s3"""
    t0, t1 = C.PRIOR_SAMPLING[0], C.PRIOR_SAMPLING[0] + C.PRIOR_SAMPLING[1]
    q["prior_labels"] = f"""{W},
u AS (SELECT id, CAST(('0x' || substr(md5('{C.SEED}' || id), 1, 8)) AS UBIGINT) / 4294967296.0 AS u FROM test)
SELECT id, CASE WHEN u < {t0} THEN 0 WHEN u < {t1!r} THEN 1 ELSE 2 END AS support_needs FROM u"""
    return q


def cell_fill_sql() -> str:
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    return f"""WITH {SUBS},
e AS (SELECT list_distinct(quantile_cont(frequent, [{probs}])) AS ef,
             list_distinct(quantile_cont(contract_length, [{probs}])) AS ec,
             quantile_cont(payment_interval, 0.5) AS md FROM train),
k AS (SELECT s.id, s.split, s.payment_interval, len(list_filter(ef, lambda x: s.frequent > x)) AS bf,
             len(list_filter(ec, lambda x: s.contract_length > x)) AS bc FROM subs s, e),
fine AS (SELECT bf, bc, avg(payment_interval) AS f FROM k WHERE split = 'train' GROUP BY ALL),
coarse AS (SELECT bf, avg(payment_interval) AS c FROM k WHERE split = 'train' GROUP BY bf)
SELECT k.id, {r6('coalesce(k.payment_interval, fine.f, coarse.c, (SELECT md FROM e))')} AS payment_interval
FROM k LEFT JOIN fine ON fine.bf = k.bf AND fine.bc = k.bc LEFT JOIN coarse ON coarse.bf = k.bf"""


def knn_fill_sql() -> str:
    axes = [c for c in NUM if c != "payment_interval"]
    d = [f"(x.{c} - s.{c})" for c in axes]
    n = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in d)
    total = " + ".join(f"coalesce({x} * {x}, 0.0::DOUBLE)" for x in d)
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM m.{c}" for c in axes)
    return f"""WITH {SUBS},
x AS (SELECT DISTINCT {lst(axes)} FROM subs WHERE payment_interval IS NULL),
near AS (
  SELECT {lst(axes)}, min({{'d2': d2, 'id': id, 'v': v}}, 5) AS near FROM (
    SELECT {lst("x." + c for c in axes)}, s.id, s.payment_interval AS v, ({total}) * ({len(NUM)}.0::DOUBLE / nullif({n}, 0)) AS d2
    FROM x, train s WHERE s.payment_interval IS NOT NULL) WHERE d2 IS NOT NULL GROUP BY ALL),
mean AS (
  SELECT {lst(axes)}, CASE WHEN near[1].d2 = 0 THEN list_avg([q.v FOR q IN near IF q.d2 = 0])
    ELSE list_sum([q.v / sqrt(q.d2) FOR q IN near]) / list_sum([1 / sqrt(q.d2) FOR q IN near]) END AS fill FROM near)
SELECT s.id, {r6("coalesce(s.payment_interval, m.fill, (SELECT avg(payment_interval) FROM train))")} AS payment_interval
FROM subs s LEFT JOIN mean m ON s.payment_interval IS NULL AND {same}"""


def routed_fill_sql() -> str:
    """Each route of the fixture has one column at most besides the medians, which so has
    no others to be filled from: neighbours give the mean, the regression the median."""
    stats = ", ".join(f"avg(CAST({c} IS NULL AS INTEGER)) AS s_{c}, avg({c}) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}"
                      for c in NUM)
    fills = ", ".join(f"{r6(f'coalesce({c}, CASE WHEN s_{c} > {C.ROUTE_HIGH_MISSING} THEN a_{c} ELSE m_{c} END)')} AS {c}"
                      for c in NUM)
    return f"WITH {SUBS}, f AS (SELECT {stats} FROM train)\nSELECT id, {fills} FROM subs, f"


def quantile_scale_sql() -> str:
    """For tables of as many train rows as there are landmarks at least."""
    cols = [f"{c}_target_encoded" for c in CAT]
    refs = ", ".join(repr(i / (C.QUANTILE_LANDMARKS - 1)) for i in range(C.QUANTILE_LANDMARKS))
    marks = ", ".join(f"quantile_cont({c}, [{refs}]) AS q_{c}" for c in cols)

    def scaled(c: str) -> str:
        q, a, b = f"q_{c}", f"a_{c}", f"b_{c}"
        between = f"({b} - 1 + ({c} - {q}[{b}]) / ({q}[{b} + 1] - {q}[{b}]))"
        return f"""CASE WHEN {c} - 1e-7::DOUBLE < {q}[1] THEN 0.0 WHEN {c} + 1e-7::DOUBLE > {q}[len({q})] THEN 1.0
          WHEN {b} > {a} THEN 0.5::DOUBLE * ({a} + {b} - 1) / (len({q}) - 1) ELSE {between} / (len({q}) - 1) END"""
    counts = ", ".join(f"len(list_filter(q_{c}, lambda v: v < {c})) AS a_{c}, len(list_filter(q_{c}, lambda v: v <= {c})) AS b_{c}"
                       for c in cols)
    return f"""WITH raw AS ({target_encode_sql(lambda x: x)}),
mark AS (SELECT {marks} FROM raw WHERE split = 'train'),
found AS (SELECT raw.*, mark.*, {counts} FROM raw, mark)
SELECT id, {", ".join(f"{r6(scaled(c))} AS {c}" for c in cols)} FROM found"""


def csv_contract_sql() -> str:
    numbers = [*NUM, C.SUSPECT, "support_needs"]
    rows = []
    for sp in ("train", "test"):
        for c in ("id", *PROFILE_COLS):
            here = not (sp == "test" and c == "support_needs")
            rows.append(f"SELECT '{sp}' AS split, 'column' AS rule, '{c}' AS subject, {float(here)} AS value, {str(here).lower()} AS passed")
            if c in numbers and here:
                rows.append(f"SELECT '{sp}', 'malformed', '{c}', 0.0, true")
        rows.append(f"SELECT '{sp}', 'malformed', 'fields', 0.0, true")
        rows.append(f"SELECT '{sp}', 'rows', 'all', CAST(count(*) AS DOUBLE), count(*) > 0 FROM {sp}")
    return f"WITH {SUBS} " + union(*rows)


ORACLE = {**build(), **build2(), **build3(), "walk_forward_folds": walk_forward_sql(), "cell_fill": cell_fill_sql(),
          "knn_fill": knn_fill_sql(), "routed_fill": routed_fill_sql(),
          "quantile_scale": quantile_scale_sql()}
def select_cascade_sql(twins: dict[str, str]) -> str:
    """The cascade up to the pruning of correlated columns, which brings the fixture's
    candidates below the cap (a table that needs the last stage has no SQL form here)."""
    families = {"t": "temporal_features", "q": "qcut_bins", "b": "business_features", "s": "stat_features",
                "r": "pct_rank", "i": "interaction_features"}
    pairs = [f"{a}_{b}" for a, b in C.INTERACTION_PAIRS]
    cols = [*NUM, "temporal_id", "temporal_position", "temporal_quartile", "temporal_decile", "customer_value",
            "customer_stability", "customer_activity", "payment_stability", "payment_frequency", "payment_risk",
            "usage_intensity", "monthly_usage", "usage_trend", "age_group", "age_risk",
            *[f"{c}_{k}" for c in NUM for k in ("log", "sqrt", "zscore", "squared", "cubed")], *[f"{c}_rank" for c in NUM],
            *[f"{p}_{k}" for p in pairs for k in ("ratio", "product", "diff", "sum")]]
    n = range(len(cols))
    parts = ", ".join(f"{k} AS ({twins[v]})" for k, v in families.items())
    joins = " ".join(f"JOIN {k} ON {k}.id = base.id" for k in families)
    values = ", ".join(f"CAST(coalesce({c if c not in NUM else 'base.' + c}, 0) AS DOUBLE) AS x{j}" for j, c in enumerate(cols))
    kept = ", ".join(f"coalesce(var_pop(x{j}), 0) > {C.VARIANCE_MIN} AS v{j}" for j in n)
    high = ", ".join(f"coalesce(abs(corr(x{i}, x{j})), 0) > {C.PRUNE_ABS_CORR} AS h{i}_{j}" for j in n for i in range(j))
    free = [" OR ".join([f"(v{i} AND h{i}_{j})" for i in range(j)]) or "false" for j in n]
    rows = ", ".join(f"{{'j': {j}, 'feature': '{c}', 'v': v{j}, 'c': v{j} AND NOT ({free[j]})}}" for j, c in enumerate(cols))
    return f"""WITH {SUBS}, {parts},
x AS (SELECT {values} FROM train base {joins}),
m AS (SELECT {kept}, {high} FROM x),
l AS (SELECT unnest([{rows}], recursive := true) FROM m),
k AS (SELECT *, count(*) FILTER (v) OVER () <= {C.MAX_FEATURES} AS early FROM l)
SELECT feature, CAST(row_number() OVER (ORDER BY j) - 1 AS INTEGER) AS position,
       CASE WHEN early THEN 'variance' ELSE 'correlation' END AS stage
FROM k WHERE CASE WHEN early THEN v ELSE c END"""


#: The same rows by way of files.
ORACLE |= {"csv_contract": csv_contract_sql(), "csv_class_stats": ORACLE["class_stats"], "submission_sink": ORACLE["score_chain"]}
ORACLE["select_cascade"] = select_cascade_sql(ORACLE)
