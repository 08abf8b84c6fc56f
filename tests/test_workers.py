"""Python kernels in workers that don't have the library on their path, and archives that are broken."""

import os
import subprocess
import sys
import zipfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from talweg.operators import hydro
from talweg.sources import files
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
sys.path.pop(0)
cells = spark.createDataFrame([(r, c, 1.0 * r) for r in range(3) for c in range(3)], "row int, col int, z double")
assert hydro.seeds(cells).count() == 8
assert files.archive_members(spark, sys.argv[2]).count() == 1
"""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.txt", "x")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, ROOT, str(tmp_path / "a.zip")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_broken_archives(spark, tmp_path):
    from talweg.sources import files

    (tmp_path / "b.zip").write_bytes(b"PK no archive")
    assert files.archive_members(spark, str(tmp_path / "b.zip"), skip_broken=True).count() == 0
    with pytest.raises(Exception, match="b.zip"):
        files.archive_members(spark, str(tmp_path / "b.zip")).collect()
