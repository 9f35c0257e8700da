"""Workers that cannot import the package: a session that starts in another folder runs every operator that shares a model."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})  # the driver alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["op10_language_cross_parsing", "op12_hard_negatives_slots"], ["op1_toxicity_nnpu", "op6_token_huffman", "pipeline"], ["op11_divergence_transducer", "op13_grouped_prefix_join"]])
def test_workers_need_not_have_the_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(f"{name} " in done.stdout for name in names)
