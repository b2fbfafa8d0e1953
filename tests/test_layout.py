"""The library without the training-data operators: their folder gone, or left behind empty."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left", ["nothing", "empty folder", "__pycache__"])
def test_without_training_data_operators(tmp_path, left):
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "lectern" / "llm").mkdir()
    if left == "__pycache__":
        (tmp_path / "lectern" / "llm" / "__pycache__").mkdir()
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-B", "-c", say], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    from lectern.plans import catalogue

    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.SQL)), "False"]


def test_nothing_else_imports_them():
    for path in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lectern.llm" not in path.read_text(encoding="utf-8")


@pytest.mark.parametrize("names", [["review_loop_udf", "debate_udf", "batch_run"]])
def test_workers_find_the_package(tmp_path, names):
    """Where the driver found it through sys.path alone and runs in another folder."""
    say = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
import __spark_entry__
print(*[__spark_entry__.queries()[x](spark, "/root/testdata/sf0.001").count() > 0 for x in {names!r}])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", say], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True"] * len(names)
