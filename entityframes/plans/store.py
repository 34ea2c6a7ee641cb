"""Stored tables that procedures change all together or not at all.

Layout below one path: every version of a table is a Parquet folder of its own, ``tables/<name>/g=<generation>``, and a generation
is one small file, ``published/<generation>``, that names the folder of every table. A procedure stages its tables in new
folders and then publishes the generation by one rename, which a file system does at once or not at all. What fails
before that leaves the published tables as they were; what it staged is refused by every reader and removed by ``recover``.
Two writers that began from the same generation cannot both publish: the second rename finds the file there and fails.
On object stores, whose rename is a copy, run one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import EntitySpec, SpecError, conform
from ..storage import delete
from .named import Procedure


class ConflictError(RuntimeError):
    """Another writer has published since the procedure began."""


@dataclass(frozen=True)
class TableStore:
    """The tables of ``specs`` below ``path``."""

    path: str
    specs: tuple[EntitySpec, ...]

    def _fs(self, spark: SparkSession) -> tuple:
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, path = self._fs(spark)
        where = path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def generation(self, spark: SparkSession) -> int:
        """The newest published generation; 0 of a new store."""
        return max((int(n) for n in self._names(spark, "published") if n.isdigit()), default=0)

    def folders(self, spark: SparkSession, generation: int | None = None) -> dict[str, str]:
        """The folder of each table in a generation, below ``tables``."""
        generation = self.generation(spark) if generation is None else generation
        if not generation:
            return {}
        (line,) = spark.read.text(f"{self.path}/published/{generation}").collect()
        return json.loads(line["value"])

    def tables(self, spark: SparkSession, generation: int | None = None) -> dict[str, DataFrame]:
        """Every declared table of a generation; one that it lacks is empty. A plan keeps reading the generation that it began with."""
        found = self.folders(spark, generation)
        return {s.name: spark.read.schema(s.struct()).parquet(f"{self.path}/tables/{found[s.name]}") if s.name in found else spark.createDataFrame([], s.struct()) for s in self.specs}

    def _stage(self, tables: dict[str, DataFrame], generation: int) -> dict[str, str]:
        specs, staged = {s.name: s for s in self.specs}, {}
        for name, df in tables.items():
            staged[name] = f"{name}/g={generation}-{uuid.uuid4().hex[:8]}"
            conform(df, specs[name]).write.parquet(f"{self.path}/tables/{staged[name]}")
        return staged

    def publish(self, spark: SparkSession, tables: dict[str, DataFrame], since: int | None = None) -> int:
        """Write ``tables`` and publish them together as the generation after ``since`` (the newest); the others stay as they are."""
        if unknown := set(tables) - {s.name for s in self.specs}:
            raise SpecError(f"not declared: {sorted(unknown)}")
        since = self.generation(spark) if since is None else since
        folders = self.folders(spark, since) | self._stage(tables, since + 1)
        (fs, path), draft = self._fs(spark), f"{self.path}/drafts/{uuid.uuid4().hex}"
        out = fs.create(path(draft), False)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        fs.mkdirs(path(f"{self.path}/published"))
        place = path(f"{self.path}/published/{since + 1}")
        if fs.exists(place) or not fs.rename(path(draft), place):
            raise ConflictError(f"generation {since + 1} of {self.path} has been published by another writer")
        return since + 1

    def run(self, spark: SparkSession, procedure: Procedure, **inputs: Any) -> DataFrame:
        """Run a procedure over the newest generation and publish what its steps change; the changed rows as (entity, op, n).

        Counts are taken from the plan before the tables are published, so a step that fails publishes nothing.
        """
        since = self.generation(spark)
        before = self.tables(spark, since)
        after, counts = procedure.run(before, {s.name: s for s in self.specs}, **inputs)
        rows = [tuple(r) for r in counts.select("entity", "op", "n").collect()]  # a row for each table and kind of change
        self.publish(spark, {name: df for name, df in after.items() if df is not before[name]}, since)
        return spark.createDataFrame(rows, "entity string, op string, n long").orderBy(F.col("entity"), F.col("op"))

    def recover(self, spark: SparkSession, keep: int = 1) -> list[str]:
        """Remove what no generation of the newest ``keep`` names: torn runs, drafts and tables that have been replaced. Not while a writer is at work."""
        newest = self.generation(spark)
        named = {f for g in range(max(1, newest - keep + 1), newest + 1) for f in self.folders(spark, g).values()}
        gone = [f"tables/{t}/{g}" for t in self._names(spark, "tables") for g in self._names(spark, f"tables/{t}") if f"{t}/{g}" not in named]
        gone += [f"drafts/{d}" for d in self._names(spark, "drafts")] + [f"published/{n}" for n in self._names(spark, "published") if n.isdigit() and int(n) <= newest - keep]
        for name in gone:
            delete(spark, f"{self.path}/{name}")
        return sorted(gone)
