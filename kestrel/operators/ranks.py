"""Table-wide order without a single-partition window.

Several operators need a global order: exact quantiles, average-tie percent
rank, the two-sample KS statistic, the time-ordered split, walk-forward folds
and the label quotas. ``Window.orderBy`` without ``partitionBy`` would plan an
``Exchange SinglePartition`` and pull the whole table through one task, so the
helpers here use the classic three-step scheme instead:

1. ``repartitionByRange`` on the order key (balanced by sampling) and
   ``sortWithinPartitions``; the result is written with a *reliable* checkpoint,
   which fixes partition contents and order for every later job and survives
   executor loss.
2. Per-partition totals (one row per partition and group -> a table whose size
   is bounded by the partition count, so it is safe to broadcast) turned into
   exclusive prefix offsets.
3. A within-partition position (``monotonically_increasing_id`` for row
   numbers, an Arrow-batched running sum for weighted totals) plus the offset.

Hot values never concentrate in one task: weighted operators first collapse
rows to (value, count), so a value holding a third of all rows is one row.

For value-count tables whose distinct-value count is below a checked bound
(``SMALL_NDV``), the per-group buffers of Spark's own ``percentile`` or a
per-group window are bounded by that count, and the cheaper one-pass plan is
used instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_parallelism, reliable_checkpoint

# Largest distinct-value count per group that one task may hold in memory
# (a hash map of value -> count). Above it the distributed path is used.
SMALL_NDV = 1_000_000
_MID_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row index


def _n_parts(df: DataFrame, n: int | None) -> int:
    """Partitions of a sort: the session's shuffle partitions, as of Spark's own sort.
    The optimizer's size of a join is the product of its sides, so it says nothing about
    the rows here, and every partition costs the driver 300 sampled rows, a task result
    and an offset."""
    return n or default_parallelism(df.sparkSession)


def global_row_number(df: DataFrame, order: list, name: str = "rn",
                      n_parts: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` over a total order, computed without a
    single-partition exchange. ``order`` must be a total order (add a unique key
    as the last tie-breaker)."""
    n = _n_parts(df, n_parts)
    rp = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
          .withColumn("_mid", F.monotonically_increasing_id()))
    rp = reliable_checkpoint(rp)
    pid = F.shiftright(F.col("_mid"), _MID_BITS)
    idx = F.col("_mid").bitwiseAND(F.lit((1 << _MID_BITS) - 1))
    counts = rp.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # the offsets table has one row per partition: bounded, safe to broadcast
    offs = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = (rp.withColumn("_pid", pid)
           .join(F.broadcast(offs), "_pid")
           .withColumn(name, F.col("_off") + idx + 1)
           .drop("_pid", "_off", "_mid"))
    return out


def _prefix_batches(group_cols: list[str], weights: list[str]):
    """mapInPandas body: exclusive running sums of ``weights`` within each
    group, carried across the Arrow batches of one (sorted) partition."""
    outs = [f"{w}_before" for w in weights]

    def fn(batches):
        carry: dict = {}
        for pdf in batches:
            if pdf.empty:
                for o in outs:
                    pdf[o] = pd.Series(dtype="int64")
                yield pdf
                continue
            if group_cols:
                g = pdf.groupby(group_cols, sort=False, dropna=False)
                code = g.ngroup().to_numpy()
                # one key per group of the batch, NULL as None
                at = np.unique(code, return_index=True)[1]
                keys = [tuple(None if pd.isna(v) else v for v in r)
                        for r in pdf[group_cols].iloc[at].itertuples(index=False, name=None)]
                for w, o in zip(weights, outs):
                    vals = pdf[w].to_numpy(dtype="int64")
                    base = np.array([carry.get((w, k), 0) for k in keys], dtype="int64")
                    pdf[o] = base[code] + g[w].cumsum().to_numpy(dtype="int64") - vals
                    np.add.at(base, code, vals)
                    carry.update(((w, k), int(v)) for k, v in zip(keys, base))
            else:
                for w, o in zip(weights, outs):
                    vals = pdf[w].to_numpy(dtype="int64")
                    inc = np.cumsum(vals) + carry.get(w, 0)
                    pdf[o] = inc - vals
                    carry[w] = int(inc[-1])
            yield pdf
    return fn


def running_total(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  weights: list[str], n_parts: int | None = None) -> DataFrame:
    """For every row add ``<w>_before``: the sum of bigint weight ``w`` over rows
    strictly before it in ``order_cols`` order, within ``group_cols``.
    (group_cols, order_cols) must be unique per row."""
    n = _n_parts(df, n_parts)
    keys = [*group_cols, *order_cols]
    rp = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
          .withColumn("_pid", F.spark_partition_id()))
    rp = reliable_checkpoint(rp)
    totals = rp.groupBy("_pid", *group_cols).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    wnd = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_cols else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", *group_cols, *[
        F.coalesce(F.sum(f"_t_{w}").over(wnd), F.lit(0)).cast("bigint").alias(f"_o_{w}")
        for w in weights])
    schema = T.StructType(rp.schema.fields + [T.StructField(f"{w}_before", T.LongType())
                                              for w in weights])
    within = rp.mapInPandas(_prefix_batches(group_cols, weights), schema)
    # offsets: one row per (partition, group) -> bounded by partitions x groups
    offs = offs.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group_cols], *[f"_o_{w}" for w in weights])
    same = F.col("_pid") == F.col("_p")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = within.join(F.broadcast(offs), same).drop("_p", *[f"_g_{c}" for c in group_cols])
    for w in weights:
        out = out.withColumn(f"{w}_before", F.col(f"{w}_before") + F.col(f"_o_{w}"))
    return out.drop("_pid", *[f"_o_{w}" for w in weights])


def cumulative_counts(vc: DataFrame, group_cols: list[str], order_col: str,
                      weights: list[str], ndv_small: bool) -> DataFrame:
    """``<w>_before`` over a value-count table. Small tables (distinct values per
    group below SMALL_NDV, checked by the caller) use a per-group window; large
    ones the distributed running total."""
    if ndv_small:
        wnd = Window.partitionBy(*group_cols).orderBy(order_col).rowsBetween(
            Window.unboundedPreceding, -1)
        return vc.select("*", *[F.coalesce(F.sum(w).over(wnd), F.lit(0)).cast("bigint")
                                .alias(f"{w}_before") for w in weights])
    return running_total(vc, group_cols, [order_col], weights)


def max_ndv(df: DataFrame, group_cols: list[str], value_col: str) -> int:
    """Approximate largest distinct-value count over the groups (one small
    aggregate; only used to choose a plan, never for results)."""
    r = (df.groupBy(*group_cols).agg(F.approx_count_distinct(value_col, 0.05).alias("d"))
         .agg(F.max("d")).first()[0])
    return int(r or 0)


def exact_quantiles(long: DataFrame, group_cols: list[str], value_col: str,
                    probs: list[float], ndv: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics
    (position (n-1)p, as numpy / pandas / SQL ``quantile_cont``).

    ``long`` has one value per row (NULLs ignored). Returns
    (group_cols..., pidx, q) with ``pidx`` the index into ``probs``.
    """
    long = long.filter(F.col(value_col).isNotNull())
    if ndv is None:
        ndv = max_ndv(long, group_cols, value_col)
    parr = F.array(*[F.lit(float(p)) for p in probs])
    if ndv <= SMALL_NDV:
        agg = long.groupBy(*group_cols).agg(
            F.percentile(F.col(value_col), parr).alias("_qs"))
        return agg.select(*group_cols, F.posexplode("_qs").alias("pidx", "q"))
    return _quantiles_distributed(long, group_cols, value_col, probs)


def _quantiles_distributed(long: DataFrame, group_cols: list[str], value_col: str,
                           probs: list[float]) -> DataFrame:
    vc = long.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("c"))
    rt = running_total(vc, group_cols, [value_col], ["c"])
    # of the sorted rows that are written down already, so the input is read once
    sizes = rt.groupBy(*group_cols).agg(F.sum("c").alias("_n"))
    spark = long.sparkSession
    pdf = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probs)], "pidx int, p double")
    # targets: one row per (group, prob) -> small, broadcast
    tg = (sizes.crossJoin(F.broadcast(pdf))
          .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
          .withColumn("_lo", F.floor("_h").cast("bigint"))
          .withColumn("_hi", F.ceil("_h").cast("bigint"))
          .withColumn("_frac", F.col("_h") - F.col("_lo")))
    ends = tg.select(*group_cols, "pidx", "_n", F.explode(F.array(
        F.struct(F.lit(0).alias("end"), F.col("_lo").alias("i")),
        F.struct(F.lit(1).alias("end"), F.col("_hi").alias("i")))).alias("e")) \
        .select(*group_cols, "pidx", "_n", "e.end", "e.i")
    # equi-join on index buckets instead of a range scan against every target:
    # bucket width ~ n / (2 * #probs), so a row meets only the targets whose
    # index falls in the buckets its [c_before, c_before + c) range covers
    # (a hot value spans at most ~2 * #probs buckets)
    width = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(2.0 * len(probs)))).cast("bigint")
    ends = ends.withColumn("_bk", (F.col("i") / width).cast("bigint")).drop("_n")
    rtb = (rt.join(F.broadcast(sizes), group_cols)
           .withColumn("_w", width)
           .withColumn("_bk", F.explode(F.sequence(
               (F.col("c_before") / F.col("_w")).cast("bigint"),
               ((F.col("c_before") + F.col("c") - 1) / F.col("_w")).cast("bigint")))))
    hit = (rtb.join(F.broadcast(ends), [*group_cols, "_bk"])
           .filter((F.col("c_before") <= F.col("i")) & (F.col("i") < F.col("c_before") + F.col("c")))
           .groupBy(*group_cols, "pidx")
           .agg(F.max(F.when(F.col("end") == 0, F.col(value_col))).alias("_vlo"),
                F.max(F.when(F.col("end") == 1, F.col(value_col))).alias("_vhi")))
    return (hit.join(tg.select(*group_cols, "pidx", "_frac"), [*group_cols, "pidx"])
            .select(*group_cols, "pidx",
                    (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("q")))


def quantile_map(long: DataFrame, group_cols: list[str], value_col: str,
                 probs: list[float]) -> dict:
    """Collect exact quantiles as fitted state: {group key: [q per prob]}
    (#groups x #probs numbers)."""
    rows = exact_quantiles(long, group_cols, value_col, probs).collect()
    out: dict = {}
    for r in rows:
        k = tuple(r[g] for g in group_cols)
        k = k[0] if len(k) == 1 else k
        out.setdefault(k, [math.nan] * len(probs))[r["pidx"]] = r["q"]
    return out
