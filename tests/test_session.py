import os

import pytest

from entitylink import session


def test_scratch_deletes_what_was_made_inside(spark):
    kept = session.materialize(spark.range(3), "kept")
    with session.scratch(spark):
        df = session.materialize(spark.range(5), "gone")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_folder(Cluster, "x")
