import os

import pytest

from thalweg import session as S


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Stub:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            S.shared_folder(Stub(spark_master=master))
        assert S.shared_folder(Stub(spark_master=master, spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert S.shared_folder(Stub(spark_master="local[4]")).startswith("file://")


def test_tables_go_when_released(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "_TABLES", [])
    monkeypatch.setattr(S, "_KEPT", {})
    monkeypatch.setattr(S, "shared_folder", lambda _: f"file://{tmp_path}")
    df = S.materialise(spark.range(5), "five")
    made = []
    for _ in range(2):
        S.kept(spark, ("k",), lambda: made.append(1) or 7)
    assert df.count() == 5 and len(os.listdir(tmp_path)) == 1 and made == [1]
    assert S.release(spark) == 1 and os.listdir(tmp_path) == [] and S.release(spark) == 0
    S.kept(spark, ("k",), lambda: made.append(1) or 7)
    assert made == [1, 1]  # what read those tables is made again
