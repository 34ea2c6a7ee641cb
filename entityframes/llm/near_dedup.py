"""Near-duplicate detection by a multi-index Hamming join of MinHash signatures.

Signature. A document's set of word shingles has ``CHUNKS * WIDTH`` MinHash values of b bits each. Two
documents are as far apart as the number of values in which they differ.

Join. The signature is split into ``CHUNKS`` chunks of ``WIDTH`` values. If two signatures differ in at
most r = CHUNKS * (ERRORS + 1) - 1 values, the pigeonhole principle leaves a chunk with at most
``ERRORS`` differences. Each chunk is indexed under every way to leave ``ERRORS`` of its values out, so
such a pair meets in at least one bucket: no pair within distance r is missed. At a similarity of 0.8
and 8 chunks of 4 values with 1 error, a chunk agrees with probability 0.82, so that a pair is
missed with probability 1e-6.

No pair explosion. A bucket of n near copies would give n**2 pairs. Instead:

1. documents with equal sets are one class, represented by the smallest id;
2. every bucket draws a few *leaders* by hash, and every member is compared with the ``TRIES`` leaders it
   meets most often: a linear number of pairs. Verified links give components. Where copies are close to
   one another, that is all: their buckets now hold one component each;
3. members of buckets that still hold several components are indexed once more, by the *prefixes* of their sets:
   with shingles ordered from rare to common, similar sets of n shingles share one of the first
   n - ceil(0.8 * n) + 1. Texts that share boilerplate only do not meet there;
4. what meets across components is gathered into clusters. In a cluster, the members outside its largest component are
   compared with all members, block by block: a task gets two packed blocks of full sets and counts all intersections
   as one matrix product. It returns at most one link for each member and neighbouring component.

So every two bucket mates are either known to be in one component, or have no common prefix shingle and cannot be
similar, or are compared: no link between components is lost. Rows grow with the texts and their shingles. Only
texts that are *not* linked but nearly so (from about 0.67 to 0.8) and meet in great numbers cost more: n of
them in b blocks are packed into b rows each of which is sent to b tasks.

Shingles are 64-bit hashes throughout. Texts with equal sets are recognised by two 64-bit sums and the size of the set.
All links between classes are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scope
from .common import blocks, materialise, mix64, shingles
from .components import connected_components

CHUNKS, WIDTH, ERRORS, VALUE_BITS = 8, 4, 1, 16
LEADERS, TRIES, BLOCK, BLOCK_BYTES, SMALL, COLUMNS = 2, 3, 2048, 8 << 20, 128, 4096
_SEED = 0x2545F4914F6CDD1D


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_SEED))
    return base[:n] | np.uint64(1), base[n:]


def signatures(hashes: np.ndarray, counts: np.ndarray, n_values: int) -> np.ndarray:
    """(documents, n_values) MinHash values cut to VALUE_BITS; every count must be above 0."""
    mult, add = _hash_family(n_values)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = np.empty((len(counts), n_values), np.uint64)
    scratch = np.empty(len(hashes), np.uint64)
    for k in range(n_values):
        np.multiply(hashes, mult[k], out=scratch)
        np.add(scratch, add[k], out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, starts)
    return mix64(out) & np.uint64((1 << VALUE_BITS) - 1)


def bucket_keys(values: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """One key for each chunk and each choice of ``errors`` values of the chunk to leave out."""
    keys = []
    for c in range(chunks):
        for k, kept in enumerate(combinations(range(width), width - errors)):
            key = np.full(len(values), (c << 8) + k + 1, np.uint64)
            for j in kept:
                key = mix64(key ^ (values[:, c * width + j] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
            keys.append(key)
    return np.stack(keys, axis=1)


def _unique_sets(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each text, counts per text, text numbers that have any)."""
    hashes, n = shingles(raws, width)
    owner = np.repeat(np.arange(len(raws)), n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    counts = np.bincount(owner, minlength=len(raws))
    return hashes, counts, np.flatnonzero(counts)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys): set size, 128-bit identity of the set, bucket keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for start, raws in blocks(batch["text"].tolist()):
                hashes, counts, some = _unique_sets(raws, width)
                n = len(raws)
                set_a, set_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                keys: list = [None] * n
                if len(some):
                    at = np.concatenate(([0], np.cumsum(counts[some])))[:-1]
                    set_a[some] = np.add.reduceat(mix64(hashes ^ np.uint64(_SEED)), at).view(np.int64)
                    set_b[some] = np.add.reduceat(mix64(hashes + np.uint64(_SEED)), at).view(np.int64)
                    values = signatures(hashes, counts[some], CHUNKS * WIDTH)
                    for i, row in zip(some, bucket_keys(values, CHUNKS, WIDTH, ERRORS).view(np.int64), strict=True):
                        keys[i] = row
                yield pd.DataFrame({"doc_id": ids[start : start + n], "n_shingles": counts, "set_a": set_a, "set_b": set_b, "keys": keys})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full set of each document as hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for start, raws in blocks(batch["text"].tolist()):
                hashes, counts, _ = _unique_sets(raws, width)
                sets = np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])
                yield pd.DataFrame({"doc_id": ids[start : start + len(raws)], "shingles": sets})

    return docs.mapInPandas(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        .select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    )
    return joined.filter(F.col("both") * 100 >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as a sum of matrix products over columns of shingles."""
    flat = np.concatenate([*left, *right])
    side = np.repeat(np.array([0, 1]), [sum(map(len, left)), sum(map(len, right))])
    values, column = np.unique(flat, return_inverse=True)
    # a shingle counts if both sides have it
    both = (np.bincount(column[side == 0], minlength=len(values)) > 0) & (np.bincount(column[side == 1], minlength=len(values)) > 0)
    place = np.cumsum(both) - 1
    row = np.concatenate([np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)])
    keep = both[column]
    column, row, side = place[column[keep]], row[keep], side[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row, side = column[order], row[order], side[order]
    for start in range(0, int(both.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        c, r, s = column[lo:hi] - start, row[lo:hi], side[lo:hi]
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        a[r[s == 0], c[s == 0]] = 1
        b[r[s == 1], c[s == 1]] = 1
        out += a @ b.T
    return out


_BLOCKS = "grp long, side int, i int, j int, data binary"


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of members as one row: their numbers, components, set sizes and sets."""
    head = rows.iloc[0]
    sets = list(rows["shingles"])
    sizes = np.array([len(x) for x in sets], np.int64)
    data = b"".join(x.astype(np.int64).tobytes() for x in (np.array([len(sets)]), rows["rep"].to_numpy(), rows["component"].to_numpy(), sizes, np.concatenate(sets)))
    block = int(head["block"])
    i, j = (block, -1) if head["side"] else (-1, block)
    return pd.DataFrame({"grp": [head["grp"]], "side": [head["side"]], "i": [i], "j": [j], "data": [data], "others": [head["others"]]})


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    raw = np.frombuffer(data, np.int64)
    n = int(raw[0])
    reps, components, sizes = raw[1 : 1 + n], raw[1 + n : 1 + 2 * n], raw[1 + 2 * n : 1 + 3 * n]
    return reps, components, np.split(raw[1 + 3 * n :], np.cumsum(sizes)[:-1])


def _compare(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the members of an asking (side 1) and another block (side 0), across components."""
        if len(rows) < 2:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        (rep_a, of_a, left), (rep_b, of_b, right) = (_unpacked(rows.loc[rows["side"] == side, "data"].iloc[0]) for side in (1, 0))
        both = _intersections(left, right)
        size_a, size_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        linked = (both * 100 >= percent * (size_a[:, None] + size_b[None, :] - both)) & (of_a[:, None] != of_b[None, :])
        i, j = np.nonzero(linked)
        # members of one component are connected already: one link to each of them is enough
        links = pd.DataFrame({"a": rep_a[i], "b": rep_b[j], "c": of_b[j]})
        return links.drop_duplicates(["a", "c"])[["a", "b"]]

    return run


def prefix_mates(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, component): members of ``mixed`` under the shingles of their prefixes, where several components meet."""
    reps = mixed.select("rep", "component").distinct()
    held = reps.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("often", "key"))
    first = held.join(often, "key").withColumn("place", place)
    prefix = first.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).filter("often > 1")
    prefix = materialise(prefix.select("key", "rep", "component"), "prefixes")
    several = prefix.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return materialise(prefix.join(several, "key", "left_semi"), "prefix-mates")


def block_pairs(mates: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, side, i, j, data): every asking block beside every block of its cluster, each packed into one row."""
    stars = mates.groupBy("key").agg(F.min("rep").alias("a")).join(mates.select("key", F.col("rep").alias("b")), "key").select("a", "b")
    clusters = connected_components(stars).toDF("rep", "cluster")
    members = mates.select("rep", "component").distinct().join(clusters, "rep")
    members = materialise(members.join(sets.withColumnRenamed("doc_id", "rep"), "rep").withColumn("bytes", F.size("shingles").cast("long") * 8), "clusters")
    parts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by(F.struct("component", "n", "bytes"), F.struct("n", "component")).alias("largest"))
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    rest = blocks_of(F.col("n") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes"))
    sizes = sizes.select("cluster", "n", "bytes", F.col("largest.component").alias("largest"), rest.alias("ask_blocks"), blocks_of(F.col("n"), F.col("bytes")).alias("all_blocks"))
    sizes = materialise(sizes, "cluster-sizes")
    # small clusters of few bytes share a group; comparing them with one another does no harm
    little = "n <= {} and ask_blocks <= 1 and all_blocks = 1".format(SMALL)
    held = sizes.filter(little).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    small = max(1, held["n"] // SMALL, held["bytes"] // BLOCK_BYTES)
    group = F.when(F.expr(little), -1 - F.pmod(F.xxhash64("cluster"), F.lit(small))).otherwise(F.col("cluster"))
    whole = members.join(sizes.drop("bytes"), "cluster").withColumn("grp", group)
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int").alias("block")
    shape = ["grp", "rep", "component", "shingles"]
    asking = whole.filter("component <> largest").select(*shape, F.lit(1).alias("side"), mine("ask_blocks"), F.col("all_blocks").alias("others"))
    answering = whole.filter("ask_blocks > 0").select(*shape, F.lit(0).alias("side"), mine("all_blocks"), F.col("ask_blocks").alias("others"))
    packed = asking.unionByName(answering).groupBy("grp", "side", "block").applyInPandas(_packed, _BLOCKS + ", others int")
    every = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return every.select("grp", "side", F.greatest("i", F.when(F.col("i") < 0, F.col("other"))).alias("i"), F.greatest("j", F.when(F.col("j") < 0, F.col("other"))).alias("j"), "data")


def crossing_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members (key, rep, component) of different components that share a bucket."""
    pairs = block_pairs(prefix_mates(mixed, sets, percent), sets)
    return pairs.groupBy("grp", "i", "j").applyInPandas(_compare(percent), "a long, b long")


def _similar_sizes(m: str, n: str, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def _near_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows, the classes of equal sets, and (node, component) of the linked classes."""
    rows = materialise(sketch(docs, width), "sketches")
    same = rows.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = materialise(same, "set-classes")
    # repeated rows of one id have equal keys, so one row per representative is enough
    members = (
        rows.filter("n_shingles > 0").join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("keys").alias("key"))
    )
    mark = lambda k: F.struct(F.xxhash64(F.lit(k), "key", "rep").alias("h"), F.col("rep"), F.col("n_shingles").alias("n"))
    led = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *[F.min(mark(k)).alias(f"l{k}") for k in range(LEADERS)]).filter("size > 1")
    shared = members.join(led, "key").select("key", "rep", "n_shingles", F.array(*[f"l{k}" for k in range(LEADERS)]).alias("leaders"))
    shared = materialise(shared, "buckets")
    met = shared.select("rep", "n_shingles", F.explode(F.array_distinct("leaders")).alias("lead"))
    met = met.filter((F.col("rep") != F.col("lead.rep")) & _similar_sizes("n_shingles", "lead.n", percent))
    met = met.groupBy("rep", F.col("lead.rep").alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    # a document has at most LEADERS leaders in each of its buckets
    often = Window.partitionBy("rep").orderBy(F.desc("n"), F.xxhash64("rep", "lead"), "lead")
    best = met.withColumn("place", F.row_number().over(often)).filter(F.col("place") <= TRIES)
    pairs = materialise(best.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct(), "leader-pairs")
    # texts that share no bucket are not shuffled on
    sets = materialise(full_sets(docs.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), width).groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "shingle-sets")
    links = materialise(verified(pairs, sets, percent), "links")
    found = connected_components(links)

    buckets = shared.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    buckets = materialise(buckets.withColumn("component", F.coalesce("component", "rep")), "bucket-components")
    several = buckets.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    mixed = materialise(buckets.join(several, "key", "left_semi"), "mixed-buckets")
    return rows, same, materialise(connected_components(links.unionByName(crossing_links(mixed, sets, percent))), "components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate components of ``docs``.

    A-Z are lower-cased and words are runs of non-white characters of the whole text. A set holds
    the distinct ``width``-word shingles; a text of fewer words is one shingle, and a null, empty or
    white text has none and is linked with nothing (n_shingles 0, a component of its own). Documents are
    linked with 100 * intersection >= ``percent`` * union; component_id is the smallest id reachable.
    Ids should be unique and not null: rows that repeat an id each get a row, of several texts with one id the one of
    least shingles is compared, and a null id has the component of its text's other ids or null. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scope(docs.sparkSession, keep=("sketches", "set-classes", "components")):
        rows, same, final = _near_components(docs, width, percent)
    labels = same.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("keys").join(labels, ["set_a", "set_b", "n_shingles"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (with doc_id and text) without the documents whose component has a smaller id."""
    dropped = near_groups(docs, width=width, percent=percent).filter("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
