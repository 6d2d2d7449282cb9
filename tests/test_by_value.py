"""Queries as the driver runs them: the package travels by value to workers that have no copy of it."""

import os
import subprocess
import sys

import pytest

from tests.conftest import ROOT

DATA = "/root/testdata/sf0.001"
RUN = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's path only
from pyspark.sql import SparkSession
import __spark_entry__
conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
print("rows", len(__spark_entry__.queries()[sys.argv[3]](spark, sys.argv[2]).collect()))
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no reference tables")
@pytest.mark.parametrize("name", ["extracted_works", "links_of_pages", "links_scanned", "page_parts", "project_images"])
def test_workers_need_no_package(tmp_path, name):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, DATA, name], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[-1]) > 0
