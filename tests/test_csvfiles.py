"""CSV source and checked sink: types, missing and malformed values, what a killed or
failing write leaves."""

import os

import pytest
from pyspark.sql import functions as F

from kestrel.sources import csvfiles as S

TYPES = {"id": "string", "age": "double", "n": "int", "note": "string"}


def put(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_values_missing_values_and_columns_by_name(spark, tmp_path):
    path = put(tmp_path, "n,extra,id,age,note\n1,x,a,2.5,\"one, \"\"two\"\"\"\n2.0,x,b, NA ,nan\n,x,c,-1e3,None\n3,x,d,,\n")
    rows = S.read_csv(spark, path, TYPES).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 2.5, 'one, "two"', None), (2, "b", None, None, None),
                                        (None, "c", -1000.0, None, None), (3, "d", None, None, None)]
    df = S.read_records(spark, path, TYPES)
    assert df.dtypes == [("n", "int"), ("id", "string"), ("age", "double"), ("note", "string")]
    assert "id:string>" in df.select("id")._jdf.queryExecution().toString().replace(" ", "").lower()


def test_malformed_rows_are_counted_and_refused(spark, tmp_path):
    path = put(tmp_path, "id,age,n,note\na,1,1,x\nb,old,1,x\nc,1,2.5,x\nd,1\ne,1,1,x,y\nf,twelve,no,x\n")
    rows = {r["id"]: r["malformed"] for r in S.read_csv(spark, path, TYPES, whole=True).collect()}
    assert rows == {"a": None, "b": "age", "c": "n", "d": "fields", "e": "fields", "f": "age"}
    got = {(r["rule"], r["subject"]): (r["value"], r["passed"]) for r in S.csv_contract(spark, path, "x", TYPES).collect()}
    assert got["malformed", "fields"] == (2.0, False) and got["malformed", "age"] == (2.0, False)
    assert got["malformed", "n"] == (1.0, False) and got["rows", "all"] == (6.0, True) and got["column", "id"] == (1.0, True)
    with pytest.raises(ValueError, match="malformed fields: 2"):
        S.read_records(spark, path, TYPES)


def test_missing_column_empty_table_and_repeated_names(spark, tmp_path):
    path = put(tmp_path, "id,age\na,1\n", "short.csv")
    got = {(r["rule"], r["subject"]): r["passed"] for r in S.csv_contract(spark, path, "x", TYPES).collect()}
    assert got["column", "note"] is False and got["column", "age"] is True and ("malformed", "n") not in got
    with pytest.raises(ValueError, match="column n: 0"):
        S.read_records(spark, path, TYPES)
    only = put(tmp_path, "id,age,n,note\n", "only.csv")
    got = {(r["rule"], r["subject"]): r["passed"] for r in S.csv_contract(spark, only, "x", TYPES).collect()}
    assert got["rows", "all"] is False and got["malformed", "fields"] is True
    assert S.read_csv(spark, put(tmp_path, "", "empty.csv"), TYPES).count() == 0
    with pytest.raises(ValueError, match="twice"):
        S.read_csv(spark, put(tmp_path, "id,id\na,b\n", "twice.csv"), TYPES)


def labels(spark, n, shift=0):
    return spark.range(n).select(F.concat(F.lit("TEST_"), F.col("id")).alias("ID"),
                                 ((F.col("id") + shift) % 3).cast("int").alias("support_needs"))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sink_replaces_whole_results_only(spark, tmp_path, fmt):
    path = str(tmp_path / "out")
    schema = labels(spark, 1).schema

    def held():
        return sorted(map(tuple, S.read_result(spark, path, fmt, schema).collect()))
    one, two = labels(spark, 30), labels(spark, 40, 1)
    assert S.write_submission(one, path, fmt) == 30 and held() == sorted(map(tuple, one.collect()))
    assert S.write_submission(two, path, fmt) == 40 and held() == sorted(map(tuple, two.collect()))
    for bad in (two.withColumn("support_needs", F.lit(7)), two.withColumn("support_needs", F.lit(1)),
                two.unionByName(two.limit(1))):
        with pytest.raises(ValueError):
            S.write_submission(bad, path, fmt)
        assert held() == sorted(map(tuple, two.collect()))
    broken = two.withColumn("support_needs", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):  # killed while writing
        S.write_submission(broken, path, fmt)
    assert held() == sorted(map(tuple, two.collect()))
    os.rename(path, path + ".before")  # killed between the two moves
    S.restore(spark, path)
    assert held() == sorted(map(tuple, two.collect()))
    assert S.write_submission(one, path, fmt) == 30 and held() == sorted(map(tuple, one.collect()))
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["out"]
