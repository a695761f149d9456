import os
import subprocess
import sys

import pytest

from lumisift import session as s


class FakeConf(dict):
    def set(self, key, value):
        self[key] = value


class FakeSession:
    def __init__(self, master, conf):
        self.conf = FakeConf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_shared_folder_is_read_from_the_session():
    cluster = FakeSession("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared/"})
    assert s.shared_dir(cluster) == "hdfs:///shared"
    assert s.fresh_dir(cluster, "x").startswith("hdfs:///shared/lumisift-app-1/x-")
    with pytest.raises(RuntimeError):
        s.shared_dir(FakeSession("yarn", {}))
    local = FakeSession("local[2]", {})
    assert s.shared_dir(local) == s.shared_dir(local) and os.path.isdir(s.shared_dir(local))


def test_a_plain_local_session_needs_no_settings(tmp_path):
    """Without any default settings, written tables and checkpoints go to a temporary folder."""
    code = """
from pyspark.sql import SparkSession
from lumisift import session as s
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert s.cut(spark.range(3)).count() == s.pin(spark.range(3)).count() == 3
assert s.shared_dir(spark) == s.shared_dir(spark)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=os.path.dirname(os.path.dirname(s.__file__)))


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, None, 0.5)], "id int, t array<string>, x double")
    back = s.cut(df)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
