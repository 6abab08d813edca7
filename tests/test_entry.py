"""The driver's entry: what it offers where optional parts are missing, and queries on workers without the package."""

import json
import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def run(code: str) -> str:
    """Output of a fresh interpreter, from another folder and without PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_missing_dependency():
    """Without one dependency of the optional part, the library's queries are all there."""
    for missing in ("ahocorasick", "xxhash", "cloakwork.llm"):
        got = json.loads(run(f"import sys, json; sys.modules[{missing!r}] = None; sys.path.insert(0, {HERE!r}); import __spark_entry__ as e; from cloakwork import queries as q; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql()), sorted(q.QUERIES)]))"))
        assert got[0] == got[2] and set(got[1]) < set(got[0]), missing


def test_workers_without_package():
    """Queries with Python functions find the package on workers that don't have it."""
    out = run(
        f"import sys; sys.path.insert(0, {HERE!r}); import __spark_entry__ as e; sys.path.remove({HERE!r}); from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); q = e.queries(); "
        f"print([n for n in ('chunk_sentence', 'chunk_overlap', 'model_detection', 'best_canonical_match') if q[n](s, {SF!r}).count() > 0])"
    )
    assert "['chunk_sentence', 'chunk_overlap', 'model_detection', 'best_canonical_match']" in out
