"""An ordered source of change events: a log whose offsets are the numbers of its rows.

``append_log`` writes rows in a given order as ordinary Parquet files below ``<path>/data`` and then publishes them by one
small table below ``<path>/log`` that says which rows each file holds: file by file, row by row, every row of the log has
a number. The order does not lean on names or times of files, so it holds on object stores as well. Rows whose
publication did not finish are never read.

``read_log`` is a stream over it. Its offset is the next number to read, so a query that restarts from its checkpoint goes on at
exactly that row, and a batch that is replayed reads exactly the rows it read before. The reader opens files by pyarrow's
file systems (local, HDFS, S3, GCS, Azure), named by the scheme of the path.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

SPLIT_ROWS, READ_ROWS = 1 << 20, 10_000
FORMAT = "ordered-log"


def append_log(rows: DataFrame, path: str, order: list, parts: int | None = None) -> int:
    """Append ``rows`` behind what the log holds, in the order given (nulls first), and return the length of the log.

    The rows are sorted by ranges, so they are written in parallel. One writer at a time.
    """
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(f"{path}/{name}")
    counted = spark.read.schema(rows.schema).parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    first, entries = _length(_entries(path)), []
    for r in sorted(counted.collect()):  # a row for each file; their names begin with the number of the range
        entries.append((f"{name}/{r['file']}", first, r["n"]))
        first += r["n"]
    published = spark.createDataFrame(entries, "file string, first long, n long").coalesce(1)
    published.write.parquet(f"{path}/log/{first:020d}-{uuid.uuid4().hex}")
    return first


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def _entries(path: str) -> list[tuple[int, int, str]]:
    """(first number, rows, file) of everything published, in order."""
    fs, root = _opened(path)
    listed = fs.get_file_info(pa.fs.FileSelector(f"{root}/log", recursive=True, allow_not_found=True))
    done = {f.path.rpartition("/")[0] for f in listed if f.base_name == "_SUCCESS"}
    found = []
    for file in listed:
        if file.path.rpartition("/")[0] in done and file.base_name.endswith(".parquet"):
            found += [(r["first"], r["n"], r["file"]) for r in pq.read_table(file.path, filesystem=fs).to_pylist()]
    return sorted(found)


def _length(entries: list[tuple[int, int, str]]) -> int:
    return max((first + n for first, n, _ in entries), default=0)


@dataclass
class _Rows(InputPartition):
    """``n`` rows of a file from row ``skip`` on."""

    file: str
    skip: int
    n: int


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, rows_per_batch: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema, self.rows_per_batch, self.at = path, to_arrow_schema(schema), rows_per_batch, 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        end = _length(_entries(self.path))
        return {"next": min(end, self.at + self.rows_per_batch) if self.rows_per_batch else end}

    def partitions(self, start: dict, end: dict) -> list[_Rows]:
        # a query that restarts plans its last batch again first, which says where it is
        self.at = max(self.at, end["next"])
        out = []
        for first, n, file in _entries(self.path):
            lo, hi = max(first, start["next"]), min(first + n, end["next"])
            out += [_Rows(file, at - first, min(SPLIT_ROWS, hi - at)) for at in range(lo, hi, SPLIT_ROWS)]
        return out

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as source:
            file, skip, left, groups = pq.ParquetFile(source), partition.skip, partition.n, []
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                if skip < n or groups:
                    groups.append(g)
                else:
                    skip -= n
            for batch in file.iter_batches(READ_ROWS, row_groups=groups, columns=self.schema.names):
                here = batch.slice(skip, left)
                skip, left = max(0, skip - len(batch)), left - len(here)
                if len(here):
                    yield pa.RecordBatch.from_arrays([here.column(f.name).cast(f.type) for f in self.schema], schema=self.schema)
                if not left:
                    break

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["next"])


class OrderedLog(DataSource):
    """Options: ``path``, and ``rows`` for the rows of a batch (0, the default: all there are)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"), schema, int(self.options.get("rows", "0")))


def read_log(spark: SparkSession, path: str, schema: StructType, rows_per_batch: int = 0) -> DataFrame:
    """The log as a stream in order, ``rows_per_batch`` rows a batch (0: all there are). Use ``drain`` to run it to its end in batches."""
    spark.dataSource.register(OrderedLog)
    return spark.readStream.format(FORMAT).schema(schema).option("rows", rows_per_batch).load(path)


def drain(query: StreamingQuery) -> None:
    """Run a query with a processing-time trigger until it has read all there is and its state has settled, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
