"""Scans of the driver tables and the two fixture views every operator is
checked on (``subs``: customer records with a support label; ``probs``: scored
probabilities). Both views are derived from the star tables by joins and
aggregations, so their size grows with the data."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import parse_seq


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting ``columns`` right away lets Catalyst prune the
    read schema to exactly those columns."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def padded(key) -> Column:
    """A number as text of seven digits or more; lpad alone would cut longer ones."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.lit(7), F.length(text)), F.lit("0"))


def subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer records: one row per order, labelled for train rows.

    Plan: lineitem is pre-aggregated per order (partial aggregation before the
    shuffle), then joined to orders on the same key (both sides hash-partitioned
    on o_orderkey, so one shuffle each); customer is joined on c_custkey and left
    to AQE to broadcast when its runtime size allows.
    """
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    li = (table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
         .join(li, o.o_orderkey == li.l_orderkey, "left"))
    k = F.col("o_orderkey")
    is_test = (k % 5) == 0
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0).cast("bigint"))
    days = F.datediff(F.to_date(F.lit("2001-12-31")), F.col("o_orderdate").cast("date"))
    return j.select(
        F.concat(F.when(is_test, F.lit("TEST_")).otherwise(F.lit("TRAIN_")),
                 padded(k)).alias("id"),
        F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.when(k % 41 == 3, F.lit(None)).otherwise(18 + F.col("o_custkey") % 63).cast("double").alias("age"),
        F.when(k % 29 == 4, F.lit(None))
         .when(F.col("c_nationkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.when(k % 13 == 2, F.lit(None)).otherwise(days).cast("double").alias("tenure"),
        n_lines.cast("double").alias("frequent"),
        F.when(k % 4 == 1, F.lit(None)).otherwise(1 + k % 30).cast("double").alias("payment_interval"),
        F.col("c_mktsegment").alias("subscription_type"),
        F.coalesce(F.col("sum_qty"), F.lit(0.0)).alias("contract_length"),
        F.when(k % 37 == 5, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") / 1000).alias("after_interaction"),
        F.when(F.col("o_totalprice") < 230000, F.lit(0))
         .when(n_lines >= 4, F.lit(1)).otherwise(F.lit(2)).alias("support_needs"),
    )


def with_seq(df: DataFrame, key: str = "id", name: str = "seq") -> DataFrame:
    return df.withColumn(name, parse_seq(key))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored probabilities (p0, p1, p2) with a true label y, one row per order.
    Every 997th row is all zero to exercise the normalisation default."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    k = F.col("o_orderkey")
    w0 = (1 + k * 7919 % 101).cast("double")
    w1 = (1 + k * 104729 % 67).cast("double")
    w2 = (1 + k * 1299709 % 139).cast("double")
    zero = (k % 997) == 0
    tot = w0 + w1 + w2

    def p(w):
        return F.when(zero, F.lit(0.0)).otherwise(w / tot)

    return o.select(
        F.concat(F.lit("TEST_"), padded(k)).alias("id"),
        k.alias("seq"),
        p(w0).alias("p0"), p(w1).alias("p1"), p(w2).alias("p2"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0))
         .when(F.col("o_orderstatus") == "O", F.lit(1)).otherwise(F.lit(2)).alias("y"),
    )


def train_test(df: DataFrame, split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    return (df.filter(F.col(split_col) == "train"),
            df.filter(F.col(split_col) == "test"))
