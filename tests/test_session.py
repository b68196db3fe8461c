"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from grainmill.session import scratch_dir


def session(master, folder=None, app="a"):
    conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": folder}[key] or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_the_folder_that_the_cluster_names():
    a, b = (scratch_dir(session("spark://x:7077", "hdfs://host/c/"), "rows") for _ in range(2))
    assert a != b and a.startswith("hdfs://host/c/rows-")
    assert scratch_dir(session("local[2]", "/shared"), "rows").startswith("/shared/rows-")


def test_without_one_there_is_none_on_a_cluster():
    with pytest.raises(ValueError):
        scratch_dir(session("spark://x:7077"), "rows")


def test_a_local_session_keeps_its_own():
    first, second = (scratch_dir(session("local[2]"), "rows").rsplit("/", 1)[0] for _ in range(2))
    assert first == second != scratch_dir(session("local[2]", app="b"), "rows").rsplit("/", 1)[0]


def test_in_a_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "rows").startswith(root)
