from __future__ import annotations

import os

import pytest

from tallybridge.workspace import Workspace, shared_folder


class OffCluster:
    """A session on a cluster that names no checkpoint folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "spark://somewhere"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_an_error():
    space = Workspace(OffCluster())
    space.release()
    with pytest.raises(RuntimeError):
        space.root


def test_the_named_folder_is_used(spark, tmp_path):
    space = Workspace(spark, f"{tmp_path}/")
    stored = space.store(spark.range(4).selectExpr("id", "id % 2 AS part"), "t", "part")
    assert stored.columns == ["id", "part"] and stored.count() == 4
    assert space.root.startswith(f"{tmp_path}/tallybridge-") and os.path.isdir(space.root)
    space.release()
    assert not os.path.exists(space.root)


def test_an_empty_table_keeps_its_schema(spark, tmp_path):
    space = Workspace(spark, str(tmp_path))
    empty = spark.range(4).where("id > 9").selectExpr("id", "'x' AS part")
    assert space.store(empty, "t", "part").columns == ["id", "part"]
    assert shared_folder(spark)
