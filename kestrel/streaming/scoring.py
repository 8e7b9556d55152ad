"""Structured Streaming scorer.

The original pipeline is batch only. What carries over to a stream is the
row-local part of scoring: the business and interaction feature families,
the fitted affine scalers (literals), any fitted MLlib model (models
transform streaming DataFrames directly), temperature, the confidence blend
and fixed mix factors fitted on a batch. Table-level corrections (the label
floors and cap) need the whole scored table and stay in the batch plan.

The sink is a file sink whose checkpoint lives under the session's
``spark.checkpoint.dir`` (never a machine-local folder on a cluster), so a
restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import argmax3
from ..operators import features, scale, score
from ..session import ensure_checkpoint_dir


def transform_stream(df: DataFrame, scaling: dict | None = None, factors=None, model=None,
                     features_col: str = "features", key: str = "id") -> DataFrame:
    """Row-local scoring of a (streaming or batch) DataFrame. ``model`` is a
    callable DataFrame -> DataFrame with p0, p1, p2 (e.g. a fitted MLlib model
    wrapped by ``learn.predict``); without one, existing p0..p2 are used."""
    out = df
    if {"tenure", "frequent", "contract_length", "payment_interval", "age"} <= set(df.columns):
        out = features.interaction_features(features.business_features(out))
    if scaling:
        out = scale.apply_affine(out, {**scaling.get("robust", {}), **scaling.get("standard", {})})
    if model is not None:
        out = model(out)
    if {"p0", "p1", "p2"} <= set(out.columns):
        out = score.confidence_blend(score.temperature(out))
        if factors is not None:
            ps = ("p0", "p1", "p2")
            adj = {p: F.col(p) * F.lit(float(f)) for p, f in zip(ps, factors)}
            tot = adj["p0"] + adj["p1"] + adj["p2"]
            out = out.select(*[F.when(tot > 0, adj[c] / tot).otherwise(F.col(c)).alias(c) if c in ps
                               else F.col(c) for c in out.columns])
        out = out.withColumn("label", argmax3("p0", "p1", "p2"))
    return out


def start_scoring(spark: SparkSession, source_dir: str, schema, sink_dir: str, name: str = "kestrel_scoring",
                  **kw):
    """readStream (parquet files arriving in ``source_dir``) -> transform_stream
    -> parquet files in ``sink_dir``; checkpoint under spark.checkpoint.dir."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source_dir)
    return (transform_stream(src, **kw).writeStream.format("parquet")
            .option("checkpointLocation", ckpt).option("path", sink_dir)
            .outputMode("append").queryName(name).start())
