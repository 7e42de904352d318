"""The driver's entry points can be imported before there is a session, with the same keys on both sides."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100; from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
