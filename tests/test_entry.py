"""The entry imports and runs from any folder, with nothing but pyspark's archives on the path."""
import glob
import os
import subprocess
import sys

import pyspark
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
names, oracle = e.queries(), e.oracle_sql()
assert set(oracle) <= set(names)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for q in ("chunk_by_budget", "zero_shot"):
    assert names[q](s, "/root/testdata/sf0.001").count() > 0
print("ran")
"""


def test_entry_from_another_folder(tmp_path):
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    lib = os.path.join(home, "python", "lib")
    if not os.path.isdir(lib):
        pytest.skip("pyspark comes without its archives")
    archives = sorted(glob.glob(os.path.join(lib, "*.zip")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
        "PYTHONPATH": os.pathsep.join(archives), "SPARK_HOME": home}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert "ran" in done.stdout, done.stderr[-3000:]


def test_package_without_the_subpackage(tmp_path):
    """Without its own folders the training-data part is absent and the rest is whole."""
    code = ("import sys; sys.modules['critica.llm'] = None; sys.path.insert(0, %r)\n"
            "import __spark_entry__ as e\nq = e.queries()\n"
            "assert 'pipeline' not in q and 'review_report' in q and not [n for n in q if n.startswith('op')]\nprint('whole')" % REPO)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "whole" in done.stdout, done.stderr[-3000:]


def test_no_local_checkpoint_folder_on_a_cluster(monkeypatch):
    from critica import session

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self):
            return None
        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
