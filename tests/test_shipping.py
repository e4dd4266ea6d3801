"""Python workers must not need the package on their path."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.entry(spark).count())
print("rows", entry.queries()["knn_cells"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_runs_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 800" in done.stdout and "rows 400" in done.stdout, done.stderr[-2000:]
