"""Executors need no copy of the package: worker code travels with the task."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from tessera.llm.queries import QUERIES
for name in {names!r}:
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("all ran")
"""
PYTHON_QUERIES = ["op1_suffix_dedup", "op2_decontamination", "op4_quality_classifier", "op6_substring_dedup", "op8_secret_scan", "op9_near_dedup", "op10_license_scan", "op11_phrases", "op12_html_text"]


@pytest.mark.parametrize("names", [PYTHON_QUERIES], ids=["python queries"])
def test_workers_without_the_package(tmp_path, names):
    """The driver alone has the repository on its path, and its workers start in an empty folder."""
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), names=names)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all ran" in run.stdout, run.stderr[-2000:]
