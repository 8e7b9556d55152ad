"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector belongs to all filters whose cap holds it, that
is, those with which its scaled inner product reaches the cap's threshold; for a
vector that few caps hold, caps are widened until enough do (its neighbours lie alike,
and widen theirs too). Directions are taken from a structured random product code: the
space is rotated at random and cut into two halves, each half has as many random unit
directions, and every pair of them is a filter. So a vector meets size ** 2 filters
after 2 * size inner products, and list decoding finds all it exceeds by going
through the few codewords of the first half that can still reach the threshold.

Filters are ``FILTERS`` times as many as vectors, and caps so narrow that a filter
holds about one vector at any size: unlike vectors meet equally often however many
there are. Two vectors just at the threshold still share ``SHARED`` filters on average,
which asks for few more filters a vector in a larger table (`plan`).

Neighbouring filters form a group, so a vector travels once for all its filters in one.
Vectors that share a filter are compared exactly, in double precision. A pair
that shares several is counted in the first of them only. Exact copies are one
class, compared once. The share of links found is measured in the tests and given
in the README.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, slices, write_cut
from .graph import components, local_forest

#: Filters for each vector of the table, and codewords of a half at least.
FILTERS, LEAST_CODE = 32, 256
#: Filters that two vectors just at the threshold share on average.
SHARED = 16
#: Vectors of a group that make a block; fuller groups are compared block by block.
BLOCK = 4096
#: Filters of a group at most; a filter holds about one vector.
SPAN = 2048
#: Pairs of a filter up to which they are compared one by one, together with other filters'.
FEW = 1024
SEED = 20_24


class Plan(NamedTuple):
    size: int  # codewords of a half
    cap: float  # threshold in standard deviations of a random direction's product
    least: int  # filters of a vector at least, and on average about

    @property
    def span(self) -> int:
        return min(self.size, SPAN)


def plan(vectors: int, least: float) -> Plan:
    """Code, caps and filters for so many vectors and a cosine of ``least``: of the
    vectors at that cosine to one in a cap the share p lies in it too (a normal
    tail), so SHARED / p filters are needed; the cap is what as many of all reach."""
    size = max(LEAST_CODE, math.ceil(math.sqrt(FILTERS * vectors)))
    normal, k, top = NormalDist(), 1, size * size // 4
    while True:
        cap = normal.inv_cdf(1 - k / size ** 2)
        p = 1 - normal.cdf((cap - least * (cap + 1 / cap)) / math.sqrt(max(1e-12, 1 - least ** 2)))
        need = min(top, math.ceil(SHARED / max(p, SHARED / top)))
        if need <= k:
            return Plan(size, cap, k)
        k = need


@lru_cache(maxsize=8)
def codes(dim: int, size: int = LEAST_CODE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The two halves' codewords in the unrotated space (dim x size each), scaled
    so that a filter's score is the sum of one product from each."""
    rng = np.random.default_rng([seed, dim])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cut_at = (dim + 1) // 2
    out = []
    for part in (turn[:, :cut_at], turn[:, cut_at:]):
        if part.shape[1] == 0:
            out.append(np.zeros((dim, size)))
            continue
        word = rng.standard_normal((part.shape[1], size))
        word /= np.linalg.norm(word, axis=0)
        out.append(part @ word * np.sqrt(part.shape[1]))
    return out[0], out[1]


def list_decode(unit: np.ndarray, how: Plan) -> list[np.ndarray]:
    """For each row (a unit vector) the numbers of all filters that it reaches, rising."""
    a, b = codes(unit.shape[1], how.size)
    u, v = unit @ a, unit @ b
    few = min(how.least, how.size)
    out = []
    for x, y in zip(u, v):
        # the best sums are sums of the best
        top = (np.partition(x, -few)[-few:, None] + np.partition(y, -few)[None, -few:]).ravel()
        need = min(how.cap, np.partition(top, -how.least)[-how.least])
        first = np.nonzero(x + y.max() >= need)[0]
        i, j = np.nonzero(x[first, None] + y[None, :] >= need)
        out.append(first[i] * how.size + j)
    return out


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _incidence(own: list[np.ndarray], below: int, cols: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(own), max(1, len(cols))), np.float32)
    for r, f in enumerate(own):
        for k in f[f < below].tolist():
            out[r, cols[k]] = 1
    return out


def compare(filt: int, x: np.ndarray, y: np.ndarray, fx: list, fy: list, least: float, same: bool, chunk: int = 512):
    """(row of x, row of y) of the pairs with cosine ``least`` or more whose first
    common filter is ``filt``; with ``same``, x is y and each pair is given once."""
    cols = ay = None
    for i in range(0, len(x), chunk):
        hit = x[i:i + chunk] @ y.T >= least
        if same:
            hit &= np.arange(i, i + hit.shape[0])[:, None] < np.arange(len(y))[None, :]
        if hit.any():
            if cols is None:
                cols = {}
                for f in (*fx, *([] if same else fy)):
                    for k in f[f < filt].tolist():
                        cols.setdefault(k, len(cols))
            if cols:
                if ay is None:
                    ay = _incidence(fy, filt, cols)
                hit &= _incidence(fx[i:i + chunk], filt, cols) @ ay.T == 0
            r, c = np.nonzero(hit)
            yield r + i, c


def _in_group(fs: list[np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(filter, row) of the filters from ``low`` to below ``high``, rising."""
    flat = np.concatenate(fs)
    row = np.repeat(np.arange(len(fs)), [len(f) for f in fs])
    some = (flat >= low) & (flat < high)
    flat, row = flat[some], row[some]
    order = np.argsort(flat, kind="stable")
    return flat[order], row[order]


def group_links(low: int, high: int, x: np.ndarray, y: np.ndarray, fx: list, fy: list, least: float, same: bool,
                chunk: int = 1 << 16):
    """(rows of x, rows of y) of the pairs with cosine ``least`` or more whose first
    common filter lies from ``low`` to below ``high``, each once over all yields. The pairs of
    filters with few are compared one by one, many filters at a time; fuller filters
    by blocks of a matrix product."""
    gx, rx = _in_group(fx, low, high)
    gy, ry = (gx, rx) if same else _in_group(fy, low, high)
    filt = np.intersect1d(gx, gy)
    sx, ex = np.searchsorted(gx, filt), np.searchsorted(gx, filt, "right")
    sy, ey = (sx, ex) if same else (np.searchsorted(gy, filt), np.searchsorted(gy, filt, "right"))
    size = (ex - sx) * (ey - sy)
    for k in np.nonzero(size > FEW)[0].tolist():
        p, q = rx[sx[k]:ex[k]], ry[sy[k]:ey[k]]
        for r, c in compare(int(filt[k]), x[p], y[q], [fx[i] for i in p], [fy[i] for i in q], least, same):
            yield p[r], q[c]
    few = np.nonzero((size <= FEW) & (size > (1 if same else 0)))[0]
    ends = np.cumsum(size[few])
    begin = 0
    while begin < len(few):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + chunk, "right")))
        now = few[begin:stop]
        n, wide = size[now], (ey - sy)[now]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = rx[np.repeat(sx[now], n) + at // np.repeat(wide, n)]
        q = ry[np.repeat(sy[now], n) + at % np.repeat(wide, n)]
        f = np.repeat(filt[now], n)
        if same:
            p, q, f = (z[p < q] for z in (p, q, f))
        hit = np.nonzero(np.einsum("ij,ij->i", x[p], y[q]) >= least)[0]
        mine = [h for h in hit.tolist() if np.intersect1d(fx[p[h]], fy[q[h]], assume_unique=True)[0] == f[h]]
        if mine:
            yield p[mine], q[mine]
        begin = stop


def classes_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have id, ok and the key (h1, h2) of their class; a class
    is a distinct usable vector with its number of copies and smallest id."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("w"), F.col(vec_col).alias("v"))
    ok = F.col("w").isNotNull() & ~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) \
        & F.exists("w", lambda x: x != 0)
    rows = src.select("id", F.coalesce(ok, F.lit(False)).alias("ok"), F.xxhash64("w").alias("h1"),
                      F.xxhash64(F.lit("second"), "w").alias("h2"), "v")
    classes = (rows.where("ok").groupBy("h1", "h2")
               .agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("v").alias("v"))
               .withColumn("cid", F.monotonically_increasing_id()))
    return rows.select("id", "ok", "h1", "h2"), cut(classes)


def candidates(classes: DataFrame, how: Plan, block: int = BLOCK) -> DataFrame:
    """Classes by groups of ``how.span`` filters: (grp, same, dim, x, y), x and y lists
    of (cid, n, v, filters); for a group of several blocks a row each pair of them."""
    kind = classes.schema["v"].dataType.simpleString()
    number, filters = (pa.int32(), "int") if how.size ** 2 < 2 ** 31 else (pa.int64(), "bigint")
    span = how.span

    def decode(batches):
        for b in slices(batches, 1024):
            vecs = b.column(2)
            dims = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            found = [None] * len(dims)
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                x = np.stack([flat[ends[i] - d:ends[i]] for i in at])
                for i, f in zip(at, list_decode(unit_rows(x, d), how)):
                    found[i] = f
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), vecs, pa.array(found, pa.list_(number))], ["cid", "n", "v", "fs"])

    decoded = classes.select("cid", "n", "v").mapInArrow(decode, f"cid bigint, n bigint, v {kind}, fs array<{filters}>")
    decoded = cut(decoded)
    groups = F.explode(F.array_distinct(F.transform("fs", lambda f: F.floor(f / span)))).alias("grp")
    # a group of one vector is left out; Spark picks the join by the size it meets
    fill = cut(decoded.select(F.size("v").alias("dim"), groups).groupBy("dim", "grp").agg(F.count("*").alias("m"))
               .where("m > 1").select("dim", "grp", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    rows = (decoded.select("cid", "n", "v", "fs", F.size("v").alias("dim"), groups)
            .join(checked_broadcast(fill, fill.count()), ["dim", "grp"])
            .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return rows.select("dim", "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") <= F.col("other")).alias("left"),
                       F.struct("cid", "n", "v", "fs").alias("row")).groupBy("dim", "grp", "i", "j").agg(
        F.collect_list(F.when(F.col("left"), F.col("row"))).alias("x"),
        F.collect_list(F.when(~F.col("left"), F.col("row"))).alias("y")).select(
        "grp", (F.col("i") == F.col("j")).alias("same"), "dim", "x", "y")


def linked(groups: DataFrame, how: Plan, least: float) -> DataFrame:
    """(a, b, links): rows with b are links between classes that keep their
    components; rows without are numbers of vectors linked to class a."""

    def side(values):
        cid, n, v, fs = values.flatten()
        at = fs.offsets.to_numpy()
        flat = fs.values.to_numpy()
        return cid.to_numpy(), n.to_numpy(), v.flatten().to_numpy(zero_copy_only=False), \
            [flat[p:q] for p, q in zip(at[:-1], at[1:])]

    def run(batches):
        for b in slices(batches, 64):
            outs = []
            for grp, same, dim, x, y in zip(*(b.column(i) for i in range(5))):
                low, same, dim = grp.as_py() * how.span, same.as_py(), dim.as_py()
                cx, nx, vx, fx = side(x.values)
                if same:
                    cy, ny, vy, fy = cx, nx, vx, fx
                elif len(x.values) and len(y.values):
                    cy, ny, vy, fy = side(y.values)
                else:
                    continue
                ux = unit_rows(vx, dim)
                uy = ux if same else unit_rows(vy, dim)
                kx, ky = np.zeros(len(cx), np.int64), np.zeros(len(cy), np.int64)
                for r, c in group_links(low, low + how.span, ux, uy, fx, fy, least, same):
                    np.add.at(kx, r, ny[c])
                    np.add.at(ky, c, nx[r])
                    node, root = local_forest(cx[r], cy[c])
                    outs.append((node, root, np.zeros(len(node), np.int64)))
                for ids, k in ((cx, kx), (cy, ky)):
                    some = k > 0
                    outs.append((ids[some], np.full(some.sum(), -1), k[some]))
            if outs:
                a, z, k = (np.concatenate(c) for c in zip(*outs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(z, mask=z < 0), pa.array(k)], ["a", "b", "links"])

    return groups.mapInArrow(run, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
                    block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) for every row.

    Vectors with cosine ``least`` or more that share a filter are linked; n_links
    counts the other rows linked directly, exact copies among them. Vectors that
    are NULL, empty, zero or hold NULL or non-finite components link with nothing;
    vectors of unlike length neither. component_id is the smallest id reachable,
    itself included (NULL ids do not count unless there is no other).
    """
    rows, classes = classes_of(vectors, id_col, vec_col)
    how = plan(classes.count(), least)
    found, _ = write_cut(linked(candidates(classes, how, block), how, least))
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("k"))
    roots = components(found.where("b is not null")).withColumnRenamed("node", "cid")
    both = (classes.select("cid", "h1", "h2", "n", "first").join(counts, "cid", "left").join(roots, "cid", "left")
            .withColumn("root", F.coalesce("root", "cid")))
    both = cut(both)
    best = both.groupBy("root").agg(F.min("first").alias("component"))
    table = cut(both.join(best, "root").select(
        "h1", "h2", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("k"), "component"))
    out = rows.where("ok").join(table, ["h1", "h2"]).select(
        F.col("id").alias(id_col), F.col("k").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not ok").select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone)
