"""Started in another folder, with no path to the package, workers still find it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1200]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["chunk_pack"](s, "/root/testdata/sf0.001").count())
"""


def test_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]
