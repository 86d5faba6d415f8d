"""The shared folder for intermediate tables."""

from types import SimpleNamespace

import pytest

from ferrybook.llm.common import shared_folder


def session(master, named=None):
    context = SimpleNamespace(master=master, folder=None)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: named or default))


def test_a_cluster_must_name_its_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    for master in ("local", "local[8]", "local[*]"):
        assert "ferrybook-checkpoint" in shared_folder(session(master))
