"""The registered queries, the pipeline, and the library without this subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as contract
from parley.llm.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_operator_has_a_query():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_check_sql(spark, tables, name):
    frame = QUERIES[name](spark, tables)
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    cursor = database.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(cursor.fetchall())


def test_stages_keep_columns_of_odd_rows(spark, odd, none, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, none):
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count()


def test_pipeline_of_a_table(spark, tables):
    pieces = corpus_pipeline.run(spark, tables)
    kept = pieces.select("doc_id").distinct().count()
    total = spark.read.parquet(f"{tables}/documents.parquet").count()
    assert 0.4 * total < kept < total


def test_library_without_subpackage(tmp_path):
    copy = str(tmp_path / "repo")
    ignore = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, copy, ignore=ignore)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op1_') for n in e.queries())"
    env = {**os.environ, "PYTHONPATH": copy}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
