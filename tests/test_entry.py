from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent


def same(spark, query, sql: str, tables: list[str]) -> None:
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    expected = db.execute(sql).df()
    got = query(spark, str(DATA)).toPandas()[list(expected.columns)]
    order = list(expected.columns)
    expected, got = (x.sort_values(order).reset_index(drop=True) for x in (expected, got))
    assert expected.equals(got)
    assert dict(expected.dtypes) == dict(got.dtypes)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_page_queries_match_their_sql(spark, name):
    same(spark, plans.queries()[name], plans.oracle_sql()[name], ["pages"])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert "host_links" in said.stdout and "op1" not in said.stdout and "pipeline" not in said.stdout
