"""CSV tables under a contract, and a checked CSV or parquet sink.

A table is read by its header's names with declared types. Text that stands for a
missing value is NULL; a row with other text where a number is declared, or with
more or fewer fields than the header, is malformed: it keeps its place with a reason
and is counted by ``csv_contract``, so that no broken row is lost or taken for a missing
value unseen.

The sink writes beside its target, reads that back, checks it and only then puts it in
the target's place, so a run that is killed or fails leaves the earlier result whole.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, score

#: The customer records' columns and types.
RECORD_TYPES = {
    "id": "string", "age": "double", "gender": "string", "tenure": "double", "frequent": "double",
    "payment_interval": "double", "subscription_type": "string", "contract_length": "double",
    "after_interaction": "double", "support_needs": "int",
}
#: Text that stands for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null")
REASON = "malformed"


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of the first file; [] for a table without lines."""
    first = spark.read.text(path).first()
    return next(csv.reader([first[0].removeprefix("\ufeff")])) if first else []


def _typed(name: str, kind: str) -> tuple[Column, Column]:
    """(value, whether its text is no such value)."""
    text = F.col(f"`{name}`")
    here = text.isNotNull() & ~F.trim(text).isin(*MISSING)
    if kind == "string":
        return F.when(here, text), F.lit(False)
    value = F.when(here, F.trim(text).try_cast("double"))
    bad = here & value.isNull()
    if kind in ("int", "bigint"):
        whole = value.try_cast("bigint").try_cast(kind)  # 2.0 is whole, 2.5 isn't
        return F.when(value == whole, whole), here & ~F.coalesce(value == whole, F.lit(False))
    return value.cast(kind), bad


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, whole: bool = False) -> DataFrame:
    """The declared columns that the header has, in the header's order and typed, and
    ``malformed``: NULL, or the row's first fault (``fields`` or the column's name).

    A declared column that the header lacks is left out, which ``csv_contract`` reports;
    others are not read. Files are read in parallel and only the columns that a query
    uses are parsed; the number of fields is seen with ``whole`` only, which parses all."""
    types = RECORD_TYPES if types is None else types
    names = header(spark, path)
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns that occur twice in the header of {path}: {', '.join(twice)}")
    if not names:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in {**types, REASON: "string"}.items()))
    schema = ", ".join(f"`{n}` string" for n in names) + ", _line string"
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("multiLine", False)
           .option("columnNameOfCorruptRecord", "_line").option("escape", '"').option("columnPruning", not whole)
           .option("nullValue", "").csv(path))
    kept = [n for n in names if n in types]
    parts = {n: _typed(n, types[n]) for n in kept}
    faults = [F.when(F.col("_line").isNotNull(), F.lit("fields"))] if whole else []
    faults += [F.when(bad, F.lit(n)) for n, (_, bad) in parts.items()]
    return raw.select(*[v.alias(n) for n, (v, _) in parts.items()],
                      F.coalesce(*faults, F.lit(None).cast("string")).alias(REASON))


def csv_contract(spark: SparkSession, path: str, tag: str, types: dict[str, str] | None = None) -> DataFrame:
    """``profile.contract_check`` of a CSV table and a row more for each kind of fault: rule
    ``malformed``, the fault, its number of rows, passed where there are none."""
    types = RECORD_TYPES if types is None else types
    df = read_csv(spark, path, types, whole=True)
    base = profile.contract_check(df, tag, list(types))
    kinds = ["fields", *[c for c in types if c in df.columns and types[c] != "string"]]
    found = df.groupBy(F.col(REASON).alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    spine = spark.range(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("subject"))
    rows = spine.join(found, "subject", "left").select(
        F.lit(tag).alias("split"), F.lit(REASON).alias("rule"), "subject", F.coalesce("n", F.lit(0.0)).alias("value"),
        F.col("n").isNull().alias("passed"))
    return base.unionByName(rows)


def read_records(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """The typed rows of a CSV table that meets its contract; raises with what fails."""
    failed = csv_contract(spark, path, "table", types).where("not passed").collect()
    if failed:
        raise ValueError(f"{path}: " + "; ".join(f"{r['rule']} {r['subject']}: {r['value']:g}" for r in failed))
    return read_csv(spark, path, types).drop(REASON)


# ---------------------------------------------------------------- sink
def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _save(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def read_result(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def restore(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was cut off: an earlier result that was moved aside
    comes back where no new one took its place, else it goes."""
    fs, target = _files(spark, path)
    _, aside = _files(spark, path + ".before")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)


def write_submission(sub: DataFrame, path: str, fmt: str = "csv") -> int:
    """Write (key, label) rows as ``path`` and return their number.

    The rows go to ``path.staging``, are read back from there and must be as many as were
    made, without a repeated key, and pass ``submission_check``; only then they take
    the place of an earlier result. A failed check raises and leaves that as it is. A
    rerun clears what a killed run left."""
    spark = sub.sparkSession
    restore(spark, path)
    staging, before = path + ".staging", path + ".before"
    _save(sub, staging, fmt)
    back = read_result(spark, staging, fmt, sub.schema)
    key, label = sub.columns[:2]
    n, keys = back.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    made = sub.count()
    if n != made or keys != n:
        raise ValueError(f"{staging}: {n} rows and {keys} keys of {made} rows")
    check = score.submission_check(back, key, label).first()
    if not check["valid"]:
        raise ValueError(f"{staging}: {', '.join(k for k, v in check.asDict().items() if v is False)}")
    fs, target = _files(spark, path)
    if fs.exists(target):
        fs.rename(target, _files(spark, before)[1])
    if not fs.rename(_files(spark, staging)[1], target):
        restore(spark, path)
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(_files(spark, before)[1], True)
    return n
