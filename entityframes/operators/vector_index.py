"""A stored approximate index for nearest neighbours by cosine: cells, product quantisation, exact re-ranking.

Layout below one path:

* ``rows/_cell=<n>/``: key, code and vector of every indexed row, partitioned by cell, so that cells that no query probes are
  not read; within a cell the files are sorted by key;
* ``centres`` and ``codebook``: the fitted numbers, a bounded table each;
* ``settings``: one row.

Cells grow with the table: about ``rows_per_cell`` rows each, up to ``most_cells``. They are fitted in two levels, the upper
one and the codebook on the driver from a bounded sample by the hash of the key, the lower one in tasks from a bounded
sample of each upper cell. Every row is in the index. A row's code has one byte for each ``SUB`` numbers of the difference between its unit
vector and its centre: the nearest of 256 fitted parts.

A search probes the cells nearest each query. Rows of a cell and queries that probe it meet in tiles of at most ``TILE_ROWS`` rows and
``TILE_QUERIES`` queries, so no task holds a cell whatever its size; a tile works out all approximate distances from tables of the
query with the codebook, the exact ones of the best ``refine * k`` of each query from the stored vectors, and passes on the best
``k`` of those. So what the codes lose depends on the rows of a tile, not on those of the table. How many cells a query probes is
fitted as well, by some rows and their nearest of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import EntitySpec
from ..storage import delete, materialise
from . import vectors

SUB, CODES = 4, 256
TILE_ROWS, TILE_QUERIES, MOST_LISTED = 8192, 1024, 2000


@dataclass(frozen=True)
class VectorIndex:
    """An index at ``path`` over vectors of ``dim`` numbers: its centres, its codebook, and the cells a query probes unless told otherwise."""

    path: str
    dim: int
    key: tuple[str, ...]
    centres: np.ndarray
    codebook: np.ndarray
    probes: int
    schema: str

    def rows(self, spark: SparkSession) -> DataFrame:
        """key, ``_vector``, ``_code`` and ``_cell`` of every indexed row."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def _units(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(-1, dim)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centres, begun from drawn rows; an empty centre stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds if len(x) > k else 0):
        half = (centres * centres).sum(1) / 2
        of = np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)])
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))[:, None]
        np.add.at(sums, of, x)
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _encoded(units: np.ndarray, cells: np.ndarray, centres: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(rows, parts) codes: for each part of the difference to the centre the nearest entry of its book."""
    rest = units - centres[cells]
    codes = np.empty((len(units), len(codebook)), np.uint8)
    for m, book in enumerate(codebook):
        part = rest[:, m * SUB : (m + 1) * SUB]
        part = np.pad(part, ((0, 0), (0, SUB - part.shape[1])))
        codes[:, m] = (part @ book.T - (book * book).sum(1) / 2).argmax(1)
    return codes


def _tables(rest: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(queries, parts, codes): what each part adds to |rest|^2 - |rest - row's part|^2, for differences of queries to a centre.

    Differences, not products of whole vectors: the error of a code then counts by the distance, not by the length, of a query.
    """
    padded = np.pad(rest, ((0, 0), (0, len(codebook) * SUB - rest.shape[1]))).reshape(len(rest), len(codebook), SUB)
    return 2 * np.einsum("qms,mcs->qmc", padded, codebook) - (codebook * codebook).sum(2)


def _sample(usable: DataFrame, key: tuple[str, ...], n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of ``n`` rows by the hash of the key."""
    share = min(1.0, most / max(1, n))
    return usable.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))


def _fit_centres(usable: DataFrame, key: tuple[str, ...], n: int, cells: int, sample: np.ndarray, per_cell: int, seed: int) -> np.ndarray:
    """About ``cells`` unit centres: up to 256 on the driver, more by fitting children of each of those in tasks."""
    upper = _units(_kmeans(sample, min(cells, 256), seed))
    children = -(-cells // max(1, len(upper)))
    if children <= 1:
        return upper

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = _units(_matrix(batch["_v"], sample.shape[1]))
            yield pd.DataFrame({"upper": (units @ upper.T).argmax(1), "_v": list(units)})

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        found = _kmeans(_matrix(rows["_v"], sample.shape[1]), children, seed)
        return pd.DataFrame({"upper": rows["upper"].iloc[0], "centre": list(_units(found))})

    drawn = _sample(usable, key, n, per_cell * cells, seed + 1).mapInPandas(place, "upper int, _v array<double>")
    # a crowded upper cell sends a bounded number of rows
    ranked = drawn.withColumn("_place", F.row_number().over(Window.partitionBy("upper").orderBy(F.xxhash64("_v"))))
    fitted = ranked.filter(F.col("_place") <= 4 * per_cell * children).drop("_place").groupBy("upper").applyInPandas(split, "upper int, centre array<double>")
    return np.array([r["centre"] for r in fitted.orderBy("upper").collect()], np.float64)  # at most ``cells`` rows


def _fit_probes(usable: DataFrame, spec: EntitySpec, n: int, centres: np.ndarray, recall: float, k: int, seed: int, asking: int = 200) -> int:
    """The least number of cells in which about ``asking`` drawn rows find ``recall`` of their ``k`` nearest others of all rows."""
    key = spec.primary_key
    drawn = materialise(_sample(usable, key, n, asking, seed + 2).select(F.xxhash64(*key).alias("query_id"), "_v").limit(2 * asking), "probing")
    near = vectors.nearest_batch(usable, spec, "_v", drawn, "query_id", vectors.COSINE, k + 1).filter("rank > 1")  # the first is the query itself
    found = near.join(usable, list(key)).select("query_id", "_v").toPandas()  # at most 2 * k rows for each of ``asking``
    queries = {r["query_id"]: np.array(r["_v"]) for r in drawn.collect()}
    if not len(found):
        return len(centres)
    order = {name: np.argsort(np.argsort(-(centres @ q), kind="stable")) for name, q in queries.items()}
    of = (_matrix(found["_v"], centres.shape[1]) @ centres.T).argmax(1)
    needed = [order[name][cell] for name, cell in zip(found["query_id"], of, strict=True)]
    return int(np.quantile(needed, recall, method="higher")) + 1


def _placed(usable: DataFrame, key: tuple[str, ...], dim: int, centres: np.ndarray, codebook: np.ndarray) -> DataFrame:
    """``usable`` (key, _vector) with the code and the cell of every row."""
    fitted = usable.sparkSession.sparkContext.broadcast((centres, codebook))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle, book = fitted.value
        for batch in batches:
            units = _units(_matrix(batch["_vector"], dim))
            cells = (units @ middle.T).argmax(1) if len(units) else np.empty(0, np.int64)
            codes = _encoded(units, cells, middle, book)
            yield batch.assign(_code=[c.tobytes() for c in codes], _cell=cells)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usable.schema)
    return usable.mapInPandas(place, f"{kinds}, _code binary, _cell int")


def _usable(df: DataFrame, key: tuple[str, ...], column: str, dim: int) -> DataFrame:
    """Rows that can be indexed: ``dim`` numbers, none of them null or not finite, not all zero."""
    fine = (F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(column, lambda x: x != 0)
    return df.filter(F.coalesce(fine, F.lit(False))).select(*key, F.col(column).alias("_vector"))


def _write(placed: DataFrame, key: tuple[str, ...], path: str) -> None:
    """Append rows to their cells; a crowded cell is written by as many tasks as its rows need."""
    order = ["_cell", *key]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("_cell").parquet(f"{path}/rows")


def build_index(
    df: DataFrame, spec: EntitySpec, column: str, dim: int, path: str, rows_per_cell: int = 1000, most_cells: int = 65_536,
    most_sample: int = 20_000, recall: float = 0.95, k: int = 20, seed: int = 42,
) -> VectorIndex:
    """Write the index of ``df`` to ``path``, replacing what is there.

    Null and zero vectors, those of another dimension and those with null, infinite or undefined numbers have no cell and are never found.
    The fit uses about ``most_sample`` rows for the upper cells and the codebook, and about 64 rows for each lower cell; the number of
    probes is that in which about 200 rows find ``recall`` of their ``k`` nearest of all rows. Centres and codebook are broadcast: ``most_cells * dim`` numbers at most.
    """
    spark, key = df.sparkSession, tuple(spec.primary_key)
    usable = _usable(df, key, column, dim)
    n = usable.count()
    cells = max(1, min(most_cells, -(-n // rows_per_cell)))
    doubles = usable.select(*key, F.col("_vector").cast("array<double>").alias("_v"))
    sample = _units(_matrix(_sample(doubles, key, n, most_sample, seed).select("_v").limit(2 * most_sample).toPandas()["_v"], dim))
    centres = _fit_centres(doubles, key, n, cells, sample, 64, seed) if len(sample) else np.empty((0, dim))
    parts = -(-dim // SUB)
    rest = sample - centres[(sample @ centres.T).argmax(1)] if len(sample) else sample
    rest = np.pad(rest, ((0, 0), (0, parts * SUB - dim))).reshape(-1, parts, SUB)
    codebook = np.zeros((parts, CODES, SUB))
    for m in range(parts if len(sample) else 0):
        book = _kmeans(rest[:, m], CODES, seed + m)
        codebook[m, : len(book)] = book
    probes = _fit_probes(doubles, spec, n, centres, recall, k, seed) if len(sample) else 0
    delete(spark, path)
    fitted = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(fitted, "cell int, centre array<double>").write.parquet(f"{path}/centres")
    spark.createDataFrame([(m, book.ravel().tolist()) for m, book in enumerate(codebook)], "part int, book array<double>").write.parquet(f"{path}/codebook")
    placed = _placed(usable, key, dim, centres, codebook)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    spark.createDataFrame([(dim, list(key), probes, schema)], "dim int, key array<string>, probes int, schema string").write.parquet(f"{path}/settings")
    _write(placed, key, path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that ``build_index`` wrote to ``path``."""
    settings = spark.read.parquet(f"{path}/settings").first()
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], np.float64).reshape(-1, settings["dim"])
    codebook = np.array([r["book"] for r in spark.read.parquet(f"{path}/codebook").orderBy("part").collect()], np.float64).reshape(-1, CODES, SUB)
    return VectorIndex(path, settings["dim"], tuple(settings["key"]), centres, codebook, settings["probes"], settings["schema"])


def append_index(index: VectorIndex, df: DataFrame, column: str) -> None:
    """Put the rows of ``df`` into the cells they are nearest to; the fit stays. A key that the index has is an error, and nothing is written."""
    spark = df.sparkSession
    placed = materialise(_placed(_usable(df, index.key, column, index.dim), index.key, index.dim, index.centres, index.codebook), "index-rows")
    there = index.rows(spark).select(*index.key)
    known = placed.join(there, list(index.key), "left_semi").select(*index.key).first()
    if known is not None or placed.count() > placed.select(*index.key).distinct().count():
        raise ValueError(f"keys that are in the index or come twice: {known or ''}")
    _write(placed, index.key, index.path)


def probed_rows(index: VectorIndex, spark: SparkSession, cells: list[int]) -> DataFrame:
    """The rows of the given cells; up to ``MOST_LISTED`` cells are named to the scan, which then lists only their folders."""
    rows = index.rows(spark)
    return rows.filter(F.col("_cell").isin(cells)) if len(cells) <= MOST_LISTED else rows


def _asked(index: VectorIndex, queries: DataFrame, query_id: str, column: str, probes: int) -> DataFrame:
    """(query_id, _unit, _cell): the unit vector of every query beside the cells it probes."""
    fitted = queries.sparkSession.sparkContext.broadcast(index.centres)
    q = queries.filter(F.size(column) == index.dim).select(F.col(query_id).alias("query_id"), F.col(column).cast("array<double>").alias("_q"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = _units(_matrix(batch["_q"], index.dim))
            near = units @ fitted.value.T
            cells = np.argsort(-near, axis=1)[:, :probes]
            yield pd.DataFrame({"query_id": batch["query_id"].repeat(cells.shape[1]), "_unit": list(units.repeat(cells.shape[1], axis=0)), "_cell": cells.ravel()})

    return q.mapInPandas(probe, f"query_id {dict(queries.dtypes)[query_id]}, _unit array<double>, _cell int")


def _foremost(near: np.ndarray, most: int) -> np.ndarray:
    """(queries, most) places of the greatest values of each row; the earlier place breaks ties."""
    if near.shape[1] <= most:
        return np.tile(np.arange(near.shape[1]), (len(near), 1))
    best = np.argpartition(-near, most - 1, axis=1)[:, :most]
    least = np.take_along_axis(near, best, 1).min(axis=1, keepdims=True)
    tied = np.flatnonzero((near >= least).sum(axis=1) > most)
    best[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :most]
    return best


def _meet(index: VectorIndex, wanted: tuple[int, int]):
    """For ``wanted`` (k, most): the k nearest rows of one tile for each of its queries, of the best ``most`` by approximate distance of unit vectors."""
    k, most = wanted

    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names, out = list(index.key), []
        if not len(asking) or not len(held):
            return pd.DataFrame({c: [] for c in ("query_id", *names, "distance")})
        held = held.sort_values(names)
        stored = _matrix(held["_vector"], index.dim)
        # of equal vectors only the first k keys can be an answer
        equal = pd.Series([v.tobytes() for v in stored])
        kept = (equal.groupby(equal).cumcount() < k).to_numpy()
        held, units = held[kept], _units(stored[kept])
        codes = np.frombuffer(b"".join(held["_code"]), np.uint8).reshape(len(held), -1)
        for start in range(0, len(asking), 64):
            part = asking.iloc[start : start + 64]
            q = _matrix(part["_unit"], index.dim)
            rest = q - index.centres[held["_cell"].iloc[0]]
            table = _tables(rest, index.codebook)
            near = np.repeat(-(rest * rest).sum(1)[:, None], len(held), axis=1)
            for m in range(codes.shape[1]):
                near += table[:, m, codes[:, m]]
            some = np.sort(_foremost(near, most), axis=1)
            exact = 1 - np.stack([(units[places] * v).sum(1) for places, v in zip(some, q, strict=True)])
            first = _foremost(-exact, k)
            rows = held[names].iloc[np.take_along_axis(some, first, 1).ravel()].reset_index(drop=True)
            rows.insert(0, "query_id", part["query_id"].repeat(first.shape[1]).to_numpy())
            out.append(rows.assign(distance=np.take_along_axis(exact, first, 1).ravel()))
        return pd.concat(out)

    return run


def search_index(index: VectorIndex, queries: DataFrame, query_id: str, column: str, k: int, probes: int | None = None, refine: int = 10) -> DataFrame:
    """(query id, key, distance, rank) of about the k nearest rows by cosine; distances are exact, the key breaks ties.

    Queries of another dimension have no answer. A zero query is at distance 1 from every row it meets.
    """
    spark, probes = queries.sparkSession, min(len(index.centres), index.probes if probes is None else probes)
    kind, kinds = dict(queries.dtypes)[query_id], dict(index.rows(spark).dtypes)
    shape = f"query_id {kind}, " + ", ".join(f"{c} {kinds[c]}" for c in index.key)
    if not len(index.centres):
        return spark.createDataFrame([], f"{shape}, distance double, rank int")
    asked = materialise(_asked(index, queries, query_id, column, probes), "asked-cells")
    cells = asked.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).orderBy("_cell").collect()  # at most one row a cell
    rows = probed_rows(index, spark, [r["_cell"] for r in cells])
    sizes = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("m"))
    deal = spark.createDataFrame([(r["_cell"], -(-r["n"] // TILE_QUERIES)) for r in cells], "_cell int, n_q int").join(F.broadcast(sizes), "_cell")
    deal = F.broadcast(materialise(deal.select("_cell", "n_q", F.ceil(F.col("m") / TILE_ROWS).cast("int").alias("n_r")), "tiles"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    left = asked.join(deal, "_cell").withColumn("_i", mine("n_q", "query_id", "_unit")).withColumn("_j", every("n_r")).drop("n_q", "n_r")
    right = rows.select(*index.key, "_code", "_vector", "_cell").join(deal, "_cell").withColumn("_j", mine("n_r", *index.key)).withColumn("_i", every("n_q")).drop("n_q", "n_r")
    tile = ["_cell", "_i", "_j"]
    right = right.withColumnsRenamed({c: f"_r{c}" for c in tile[1:]}).withColumn("_r_cell", F.col("_cell"))
    met = left.groupBy(*tile).cogroup(right.groupBy("_r_cell", "_r_i", "_r_j")).applyInPandas(_meet(index, (k, refine * k)), f"{shape}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", *index.key)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
