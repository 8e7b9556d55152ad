"""Every query with a SQL twin must equal DuckDB on the same tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SQL = E.oracle_sql()
SF = os.environ.get("KESTREL_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(SQL[name]).df()
    ok, msg = compare(sp, dk)
    assert ok, msg


SLOW = {"forest_scores", "boosted_scores", "mlp_scores", "stacked_scores", "cv_scores", "repeated_cv_scores",
        "stability_runs", "blend_weights", "importance_summary", "baseline_forest", "baseline_two_model",
        "feature_pipeline", "end_to_end"}
ROWS_ONLY = sorted(n for n in E.queries() if n not in SQL)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    if name in SLOW and not os.environ.get("KESTREL_SLOW"):
        pytest.skip("learner query (minutes); set KESTREL_SLOW=1")
    pdf = E.queries()[name](spark, SF).toPandas()
    assert len(pdf.columns) > 0 and len(pdf) > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
