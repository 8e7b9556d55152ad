"""Fitted state on disk: tables, MLlib models and plain values of a run, written
with Spark's writers to one folder and read back, or fitted anew where the folder
holds none."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ..operators.learn import Fitted


def _folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Write ``state``: DataFrames as parquet, ``Fitted`` learners by MLlib's
    writers, everything else as JSON. The index is written last, so a folder with
    an index is whole."""
    index = {}
    for name, value in state.items():
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(_folder(path, name))
            index[name] = {"kind": "table"}
        elif isinstance(value, Fitted):
            for i, m in enumerate(value.models):
                m.write().overwrite().save(_folder(path, f"{name}-{i}"))
            index[name] = {"kind": "fitted", "models": len(value.models), "name": value.name, "how": value.kind,
                           "features": value.features, "rounds": value.rounds}
        else:
            index[name] = {"kind": "value", "value": value}
    spark.createDataFrame([(json.dumps(index),)], "value string").coalesce(1).write.mode("overwrite").text(_folder(path, "index"))


def load_state(spark: SparkSession, path: str) -> dict:
    """What ``save_state`` wrote; raises where there is no whole state."""
    index = json.loads(spark.read.text(_folder(path, "index")).first()[0])
    out = {}
    for name, entry in index.items():
        if entry["kind"] == "table":
            out[name] = spark.read.parquet(_folder(path, name))
        elif entry["kind"] == "fitted":
            models = [DefaultParamsReader.loadParamsInstance(_folder(path, f"{name}-{i}"), spark)
                      for i in range(entry["models"])]
            out[name] = Fitted(entry["name"], models, entry["how"], entry["features"], [tuple(r) for r in entry["rounds"]])
        else:
            out[name] = entry["value"]
    return out


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], dict]) -> tuple[dict, bool]:
    """(state, loaded): the saved state, or what ``fit`` gives, saved for the next
    time, where none can be read."""
    from pyspark.errors import AnalysisException
    try:
        return load_state(spark, path), True
    except AnalysisException:
        state = fit()
        save_state(spark, path, state)
        return load_state(spark, path), False
