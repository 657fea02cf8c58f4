import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from keyweave.plans import api_queries, queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUERIES, ORACLE = queries.QUERIES | api_queries.QUERIES, queries.ORACLE | api_queries.ORACLE


@pytest.fixture(scope="module")
def tables(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", ORACLE)
def test_against_sql(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    want = tables.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)


def test_null_rank_of_wide_users(spark, tmp_path):
    """Users of the same two lowest bytes, in the order of event_id, whatever their higher bytes; null just before 0 and 65536."""
    users = [65536 + 5, 5, 3 * 65536, 0, 2 * 65536 + 5, -65531, (1 << 40) + 261, 65536, 261, 7 * 65536 + 5, -1, 65535]
    made = duckdb.connect()
    rows = ", ".join(f"({i}::BIGINT, {user}::BIGINT)" for i, user in enumerate(users, 1))
    made.execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, user_id)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    made.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in QUERIES["null_rank"](spark, str(tmp_path)).orderBy("event_id").select("event_id", "rank").collect()]
    assert len(got) == len(users) and got == sorted(made.execute(f"SELECT event_id, rank FROM ({ORACLE['null_rank']})").fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_plan(spark, sf_dir):
    plan = QUERIES["inner_join"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, with_pipeline):
    """A checkout without their folders, with or without the pipeline, has all other queries, and its tests can be collected."""
    gone = ["llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])]
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    ask = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    run = lambda *args: subprocess.run([sys.executable, "-B", *args], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ""})
    said = run("-c", ask)
    assert said.stdout.split() == ["True", str(len(QUERIES))], said.stderr
    collected = run("-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout


def test_import_errors_inside_the_operators_are_raised(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    module = tmp_path / "repo" / "keyweave" / "llm" / "queries.py"
    if not module.exists():
        pytest.skip("a checkout without the operators")
    module.write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ""})
    assert said.returncode != 0 and "no_such_module" in said.stderr
