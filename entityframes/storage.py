"""Tables written on the way: lineage ends at Parquet files in the shared folder.

Every application writes below one run folder of its own. ``scope`` deletes what was written inside it,
``release`` all that the run has written: call it when a result has been read. On a cluster the folder must be
shared by driver and executors, so there a session without a checkpoint folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_runs: dict[str, str] = {}  # run folder of each application
_written: dict[str, list[tuple[str, str]]] = {}  # (name, path) of the tables of each application


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` or of ``setCheckpointDir``; a temporary one only on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = checkpoints.get() if checkpoints.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("no folder is shared with the executors: set spark.checkpoint.dir")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def run_folder(spark: SparkSession) -> str:
    app, shared = spark.sparkContext.applicationId, shared_folder(spark)
    if not _runs.get(app, "").startswith(shared + "/"):
        _runs[app] = f"{shared}/entityframes-{uuid.uuid4().hex}"
    return _runs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((name, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared one and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can write to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def scope(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Delete the tables written inside, at its end, but for those named in ``keep``: no result may depend on the others."""
    tables = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(tables)
    done = False
    try:
        yield
        done = True
    finally:  # a step that fails leaves nothing behind
        inside, tables[before:] = tables[before:], []
        for name, path in inside:
            if done and name in keep:
                tables.append((name, path))
            else:
                delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has written on the way; results that depend on them end."""
    app = spark.sparkContext.applicationId
    _written.pop(app, None)
    if run := _runs.pop(app, None):
        delete(spark, run)
