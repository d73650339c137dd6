"""The entry module needs neither a session nor Spark's jars to be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import glob, zipfile
from unittest import mock
with mock.patch("glob.glob", return_value=[]), mock.patch("zipfile.ZipFile", side_effect=OSError):
    import __spark_entry__ as e
    jobs, sql = e.queries(), e.oracle_sql()
from pyspark.sql import SparkSession
assert SparkSession.getActiveSession() is None
assert set(sql) <= set(jobs)
print(len(jobs), len(sql))
"""


def test_import_without_session_or_jars(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(tmp_path), "JAVA_HOME": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", PROBE], env=env, capture_output=True, text=True, cwd=tmp_path)
    assert run.returncode == 0, run.stderr
    jobs, sql = map(int, run.stdout.split())
    assert jobs >= 126 and sql >= 104
