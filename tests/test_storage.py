"""Tables on the way are deleted, and are never written where executors cannot read them."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from entityframes import storage


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    yield tmp_path
    storage.release(spark)


def tables(folder):
    return sorted(p.name.rsplit("-", 1)[0] for run in Path(folder).iterdir() for p in run.iterdir())


def test_release_leaves_no_folder(spark, sf, folder):
    from __spark_entry__ import queries

    out = queries()["e14_unexpired_stream"](spark, sf)
    assert out.count() > 0
    kept = storage.materialise(spark.range(5), "some")
    assert kept.count() == 5 and "some" in tables(folder)
    storage.release(spark)
    assert not list(Path(folder).iterdir())


def test_scope_keeps_what_is_named(spark, folder):
    outer = storage.materialise(spark.range(2), "outer")
    with storage.scope(spark, keep=("result",)):
        storage.materialise(spark.range(3), "step")
        result = storage.materialise(spark.range(4), "result")
        assert tables(folder) == ["outer", "result", "step"]
    assert tables(folder) == ["outer", "result"] and result.count() == 4 and outer.count() == 2


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    given = SimpleNamespace(isDefined=lambda: True, get=lambda: "hdfs://host/check/")

    def session(checkpoints, master):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: checkpoints)))
        return SimpleNamespace(conf={}, sparkContext=context)

    with pytest.raises(RuntimeError):
        storage.shared_folder(session(none, "spark://host:7077"))
    assert storage.shared_folder(session(given, "spark://host:7077")) == "hdfs://host/check"
    assert storage.shared_folder(session(none, "local[2]")).startswith("file://")
