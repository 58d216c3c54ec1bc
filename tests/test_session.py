import os
import subprocess
import sys
from pathlib import Path

import pytest

from marginalia import session

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from marginalia.operators import sessions
log = s.createDataFrame([(1, 5, "a")], "entry_id long, at_ms long, agent_id string")
print("rows", sessions.cut(sessions.gap_tree(log), 10).count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 1" in out.stdout, out.stderr[-1500:]


def test_written_tables(spark):
    df = session.materialize(spark.range(5).toDF("a b"), "t")
    assert df.count() == 5 and df.columns == ["a b"]
    session.discard(spark)
    with pytest.raises(Exception, match="(?i)not exist|no such|FILE_NOT"):
        df.collect()
