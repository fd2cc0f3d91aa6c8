import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from oracle import compare
from tileflow.llm import queries

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_query_runs_over_its_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.count() == n or name == "op1_decontaminate"


def test_entry_without_these_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = """
import __spark_entry__ as e
assert "sssp_k" in e.queries() and "sssp_k" in e.oracle_sql()
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "repo")
