import pytest

from regrove import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Context:
    folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, **conf):
        self.conf, self.sparkContext = Conf({k.replace("_", "."): v for k, v in conf.items()}), Context()


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(Session(spark_master=master))
    named = Session(spark_master=master, spark_checkpoint_dir="hdfs:///shared")
    assert session.shared_dir(named) == "hdfs:///shared"
    session.ensure_checkpoint_dir(named)
    assert named.sparkContext.folder == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_master_gets_a_folder(master):
    one = Session(spark_master=master)
    assert session.shared_dir(one) == one.sparkContext.folder == session.shared_dir(one)


def test_scratch_tables_of_a_session_are_removed_on_request(spark, monkeypatch):
    monkeypatch.setattr(session, "_GIVEN", {})
    paths = [session.scratch_path(spark, name) for name in ("one", "two", "never")]
    for path in paths[:2]:
        spark.range(3).write.parquet(path)
    kept = f"{session.shared_dir(spark)}/kept-by-others"
    spark.range(1).write.mode("overwrite").parquet(kept)
    assert session.clean(spark) == 2 and session.clean(spark) == 0
    assert spark.read.parquet(kept).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths[0])
