"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from brindle.llm import workspace


def test_tables_are_written_read_and_released(spark):
    space = workspace.Workspace(spark, "t")
    frame = space.write(spark.range(100).selectExpr("id % 7 k", "id").groupBy("k").count(), "a")
    space.write(frame, "b")
    folder = space.root.removeprefix("file://")
    assert frame.count() == 7 and space.size("a") > 0 and sorted(os.listdir(folder)) == ["a", "b"]
    space.drop("b")
    assert os.listdir(folder) == ["a"]
    assert spark.conf.get(workspace.FREE_SHUFFLES) == "false"  # as before
    workspace.release(spark)
    assert not os.path.exists(folder)


def test_partitions_grow_with_the_table(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert workspace.partitions(spark, 0) == least and workspace.partitions(spark, 1 << 40, 64 << 20) == 1 << 14


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
