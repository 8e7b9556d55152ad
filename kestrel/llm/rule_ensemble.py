"""Quality classifier: a sparse ensemble of rules.

Small trees are grown on statistics of labelled texts, each on what the trees
before it left unexplained. Every path from a root is a conjunctive rule
(``symbols > 0.02 and words <= 90``). A lasso logistic regression over all rules
drops most of them, and what is left is compiled into one Spark column
expression that scores every document inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .textstats import ratios, with_counts

#: The classifier is fitted on at most so many labelled rows, those with the
#: smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 40, 3, 64, 10, 0.3
#: Lasso penalties tried, from strong to weak; a fifth of the sample picks one.
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)

Rule = tuple[tuple[str, str, float], ...]


@dataclass
class Ensemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            hit = F.lit(True)
            for name, op, at in rule:
                hit = hit & (F.col(name) > at if op == ">" else F.col(name) <= at)
            z = z + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + rule_matrix(self.rules, x, names) @ np.array(self.weights))))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{a} {op} {v:.6g}" for a, op, v in r) for r, w in zip(self.rules, self.weights)]


def rule_matrix(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, op, at in rule:
            c = x[:, names.index(name)]
            out[:, j] *= c > at if op == ">" else c <= at
    return out


def _grow(x, bins, edges, target, hess, rows, depth, path, names, out) -> None:
    """Splits ``rows`` where the target's (second-order) gain is largest; adds the
    paths to both sides to ``out`` and goes on below them. Leaves step ``out.step``."""
    g, h = target[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for f in range(x.shape[1]):
            k = bins[rows, f]
            gs, hs, ns = (np.bincount(k, w, minlength=len(edges[f]) + 1).cumsum()[:-1]
                          for w in (target[rows], hess[rows], None))
            fit = (ns >= LEAST_ROWS) & (len(rows) - ns >= LEAST_ROWS)
            if fit.any():
                gain = np.where(fit, gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g ** 2 / (h + 1), -1)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], f, j)
    if best[1] is None:
        out["step"][rows] = g / (h + 1)
        return
    _, f, j = best
    at = float(edges[f][j])
    left = bins[rows, f] <= j
    for side, op in ((left, "<="), (~left, ">")):
        here = (*path, (names[f], op, at))
        out["rules"].append(here)
        _grow(x, bins, edges, target, hess, rows[side], depth - 1, here, names, out)


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """All paths of ``TREES`` trees grown one upon the other on the logistic loss,
    each on a seeded half of the rows."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mid = (values[1:] + values[:-1]) / 2
        if len(mid) > BINS:
            low = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            mid = np.unique(np.concatenate((low, mid[np.linspace(0, len(mid) - 1, BINS).astype(int)])))
        edges.append(mid)
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z = np.full(len(y), np.log(share / (1 - share)))
    rules, seen = [], set()
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        out = {"rules": [], "step": np.zeros(len(y))}
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        _grow(x, bins, edges, y - p, p * (1 - p), rows, DEPTH, (), names, out)
        grown = out["rules"]
        for r in grown:
            key = tuple(sorted(r))
            if key not in seen:
                seen.add(key)
                rules.append(r)
        # the step for all rows: from each leaf's path
        leaves = [r for r in grown if not any(len(q) > len(r) and q[: len(r)] == r for q in grown)]
        hits = rule_matrix(leaves, x, names)
        for j in range(len(leaves)):
            inside = hits[:, j] > 0
            use = np.zeros(len(y), bool)
            use[rows] = True
            got = inside & use
            if got.any():
                z[inside] += RATE * (y - p)[got].sum() / ((p * (1 - p))[got].sum() + 1)
    return rules


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, start=None, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-penalised logistic regression (accelerated
    proximal gradient); the intercept is free."""
    n, k = m.shape
    a = np.concatenate((m, np.ones((n, 1))), axis=1)
    w = np.zeros(k + 1) if start is None else start.copy()
    rate = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -40, 40)))
        nxt = v - rate * (a.T @ (p - y) / n)
        nxt[:k] = np.sign(nxt[:k]) * np.maximum(np.abs(nxt[:k]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = nxt + (t - 1) / t2 * (nxt - w)
        if np.abs(nxt - w).max() < 1e-6:
            w = nxt
            break
        w, t = nxt, t2
    return w[:k], float(w[k])


def fit_ensemble(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """An ensemble from statistics and labels 0 or 1. Without rows it scores 0.5;
    with one label only it scores that label's smoothed share."""
    if not len(y):
        return Ensemble()
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(intercept=float(np.log(share / (1 - share))))
    rules = tree_rules(x, y, names)
    m = rule_matrix(rules, x, names)
    test = np.arange(len(y)) % 5 == 0
    best, start = (np.inf, PENALTIES[-1]), None
    for penalty in PENALTIES:
        w, b = lasso(m[~test], y[~test], penalty, start)
        start = np.concatenate((w, [b]))
        p = np.clip(1 / (1 + np.exp(-(m[test] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)) if test.any() else 0.0
        best = min(best, (loss, penalty))
    w, b = lasso(m, y, best[1], steps=1500)
    use = np.nonzero(np.abs(w) > 1e-6)[0]
    return Ensemble([rules[j] for j in use], [float(w[j]) for j in use], b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2,
        id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble from labelled rows outside the held-out fold, ``rows`` at most
    (a documented bound; NULL ids and labels are not used)."""
    some = (labels.select(F.col(id_col).alias("lid"), F.col(label).cast("int").alias("y"))
            .where("lid is not null and y is not null").where(fold("lid", folds) != held_out)
            .groupBy("lid").agg(F.max("y").alias("y"))
            .orderBy(F.xxhash64("lid"), "lid").limit(rows))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    both = src.join(F.broadcast(some), F.col("id") == F.col("lid")).select("id", "y", "t")
    stats = ratios()
    got = (with_counts(both, ["id", "y"], "t").orderBy(F.xxhash64("id"), "id", "n_words").limit(rows)
           .select("id", "y", *[c.alias(n) for n, c in stats.items()]).toPandas())
    got = got.sort_values(["id", *stats]).reset_index(drop=True)
    return fit_ensemble(got[list(stats)].to_numpy(float), (got["y"].to_numpy() == 1).astype(float), list(stats))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics, score) for every row; NULL and empty texts have statistics 0
    and are scored like any other."""
    out = with_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), ["id"], "t")
    stats = ratios()
    out = out.select("id", *[c.alias(n) for n, c in stats.items()])
    return out.withColumn("score", model.column()).withColumnRenamed("id", id_col)


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    model = fit(docs, labels, folds=folds, held_out=held_out)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
