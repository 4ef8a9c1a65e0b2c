"""Executors need no copy of the package: queries run where only the driver can import it."""

import os
import subprocess
import sys
from pathlib import Path

from tests.conftest import DATA

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__
for name, query in sorted(__spark_entry__.queries().items()):
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        print(name, query(spark, sys.argv[3]).count())
"""


def test_every_query_without_the_package_on_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), (tmp_path / "shared").as_uri(), f"{DATA}/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith(("op", "pipeline"))]) == 11
