"""Where shared files go."""

import pytest

from tilewright import session


def pretend(master, conf=None, checkpoints=None):
    """A session of a cluster that isn't there."""
    known = type("Known", (), {"isDefined": lambda self: checkpoints is not None, "get": lambda self: checkpoints})()
    jvm = type("Jvm", (), {"sc": lambda self: type("Sc", (), {"getCheckpointDir": lambda self: known})()})()
    told = []
    context = type("Context", (), {"master": master, "getConf": lambda self: conf or {}, "_jsc": jvm, "setCheckpointDir": lambda self, folder: told.append(folder)})()
    return type("Session", (), {"sparkContext": context, "conf": type("Conf", (), {"get": lambda self, k, d=None: d})()})(), told


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(pretend("spark://host:7077")[0])
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(pretend("local-cluster[2,1,1024]")[0])
    named, told = pretend("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///c"})
    assert session.shared_dir(named) == "hdfs:///c" and told == ["hdfs:///c"]
    set_before, told = pretend("spark://host:7077", None, "hdfs:///d/1")
    assert session.shared_dir(set_before) == "hdfs:///d/1" and told == []
    alone, told = pretend("local[4]")
    assert session.shared_dir(alone) == told[0] and told[0].startswith("file:///")
