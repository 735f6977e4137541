"""Each query in a session that nothing has prepared, from another folder: Python workers must find the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
def session():
    found = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found
import __spark_entry__ as entry
for name in sys.argv[2:]:
    spark = session()
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
    spark.stop()
"""


def test_queries_in_fresh_sessions(tmp_path):
    names = ["op2_token_counts", "op6_language_id", "op8_lm_scoring", "op9_nearest_neighbours", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", CODE, str(ROOT), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[0] for line in run.stdout.splitlines() if line.split()[0] in names] == names
