"""Set-similarity self-join of documents on word n-grams, by size-banded tiles with bitmap signatures.

Two sets link when 100 * intersection >= percent * union. Every linked pair of different sets is either known to be in
one component or its overlap is bounded in a tile and, where the bound allows a link, counted exactly.

1. Documents with equal sets are one class, represented by the smallest id.
2. Shingles have one global order: rare ones by hash, then the frequent ones by count. Linked sets share one of the first
   n - ceil(percent * n / 100) + 1 shingles of either (prefix filter), whatever the order is, so the counts behind it
   may be rough: each task names its frequent shingles, and the ``FREQUENT`` most frequent of all go to the end.
3. Every key that several classes have in their prefixes draws one leader by hash; classes are checked with the leaders they
   meet most. Groups of near copies become components with a linear number of pairs.
4. Keys in which several components meet are cut into *tiles*: the sets of one size band (sizes within 1 / percent of each other) as
   own members, those of the next band as visitors. Linked sets are in one band or in neighbouring ones. In a tile the
   members outside its largest component are compared with all others, in blocks of at most ``BLOCK`` on each side.
5. A signature has ``BITS`` bits or more for each shingle (up to ``MOST_BITS``): bit h(s) is the parity of the shingles s that
   fall on it. The bits in which two signatures differ are at most the elements in which the sets differ, so
   (|x| + |y| - differing bits) / 2 bounds the overlap from above. A wide signature is folded to a narrower one by xor.
6. What passes is counted exactly as the intersection of sorted arrays. A tile first hands out the ``few`` best partners of each
   member in each other component, since one link joins two components; where it had to leave some out, the next round
   hands out more for its key, at last all. No pair of components that may be linked stays unchecked.

Shingles are 64-bit hashes; equal sets are recognised by two 64-bit sums and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scope
from .common import blocks, materialise, mix64, shingles
from .components import connected_components
from .near_dedup import _unique_sets, full_sets

FREQUENT, LOCALLY_FREQUENT, HELD = 1 << 17, 8, 1 << 20
BITS, LEAST_BITS, MOST_BITS = 2, 64, 4096
TRIES, BLOCK, PAIRS = 3, 2048, 1 << 17
ROUNDS = (4, 256, None)
_SEED = np.uint64(0x2545F4914F6CDD1D)


def frequent_shingles(docs: DataFrame, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most ``most`` shingles that are frequent in some million of a task's shingles."""

    def often(held: list[np.ndarray]) -> pd.DataFrame:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"shingle": values[n >= LOCALLY_FREQUENT].view(np.int64), "n": n[n >= LOCALLY_FREQUENT]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, raws in blocks(batch["text"].tolist()):
                held.append(shingles(raws, width)[0])
                if sum(map(len, held)) >= HELD:
                    yield often(held)
                    held = []
        if held:
            yield often(held)

    counted = docs.select("text").mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # written first: only the final rows come to the driver, at most ``most``
    top = materialise(counted.orderBy(F.desc("n"), "shingle").limit(most), "frequent").toPandas()
    common, n = top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(common)
    return common[order], n[order]


def parities(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The parity signature of each set of ``counts`` hashes; a power of two of bits."""
    bits = np.maximum(LEAST_BITS, np.minimum(MOST_BITS, 1 << np.ceil(np.log2(np.maximum(1, BITS * counts))).astype(np.int64)))
    begins = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(counts)), counts)
    at = (mix64(hashes + _SEED) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64) + begins[owner]
    packed = np.packbits((np.bincount(at, minlength=int(begins[-1])) & 1).astype(np.uint8))
    return [packed[lo:hi].tobytes() for lo, hi in zip(begins[:-1] >> 3, begins[1:] >> 3, strict=True)]


def folded(signatures: list[bytes], n_bytes: int) -> np.ndarray:
    """(signatures, words) with every signature folded to ``n_bytes``."""
    out = np.empty((len(signatures), n_bytes), np.uint8)
    for k, raw in enumerate(signatures):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, n_bytes), axis=0)
    return out.view(np.uint64)


def overlap_bound(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The most that sets of ``sizes`` elements together can have in common, by row of two equal stacks of signatures."""
    return (sizes - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) >> 1


def sketch(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, prefix, signature) of every row; a document without words has nulls for the last two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, often = frequent.value
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for start, raws in blocks(batch["text"].tolist()):
                hashes, counts, some = _unique_sets(raws, width)
                n = len(raws)
                set_a, set_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                prefix: list = [None] * n
                signature: list = [None] * n
                if len(some):
                    sizes = counts[some]
                    at = np.concatenate(([0], np.cumsum(sizes)))
                    set_a[some] = np.add.reduceat(mix64(hashes ^ _SEED), at[:-1]).view(np.int64)
                    set_b[some] = np.add.reduceat(mix64(hashes + _SEED), at[:-1]).view(np.int64)
                    ordered = hashes.view(np.int64)
                    if len(common):
                        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                        rank = np.where(common[place] == hashes, often[place], 0)
                        # hashes ascend within a text, so a stable sort by (text, rank) is enough
                        ordered = ordered[np.argsort(np.repeat(np.arange(len(some)), sizes) * (int(often.max()) + 1) + rank, kind="stable")]
                    length = sizes - (percent * sizes + 99) // 100 + 1
                    for i, lo, m, bits in zip(some, at[:-1], length, parities(hashes, sizes), strict=True):
                        prefix[i], signature[i] = ordered[lo : lo + m], bits
                yield pd.DataFrame({"doc_id": ids[start : start + n], "n_shingles": counts, "set_a": set_a, "set_b": set_b, "prefix": prefix, "signature": signature})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, set_a long, set_b long, prefix array<long>, signature binary")


def _may_link(most: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * most >= percent * (sizes - most)


def bounded(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave a link open; ``members`` has rep, n and signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            width = np.minimum(batch["sig_a"].map(len), batch["sig_b"].map(len)).to_numpy()
            for n_bytes in np.unique(width):
                part = batch[width == n_bytes]
                sizes = (part["n_a"] + part["n_b"]).to_numpy(np.int64)
                most = overlap_bound(folded(part["sig_a"].tolist(), n_bytes), folded(part["sig_b"].tolist(), n_bytes), sizes)
                yield part.loc[_may_link(most, sizes, percent), ["a", "b"]]

    of = lambda x: members.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)], np.int64)
            sizes = (batch["set_a"].map(len) + batch["set_b"].map(len)).to_numpy(np.int64)
            yield batch.loc[_may_link(both, sizes, percent), ["a", "b"]]

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialise(full_sets(docs.join(ids, "doc_id", "left_semi"), width), "join-sets")
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(run, "a long, b long")


def _chunk_pairs(rows: pd.DataFrame, percent: int, few: int | None) -> Iterator[pd.DataFrame]:
    """Open pairs of whole tiles. Rows of a tile lie together; ``asks`` and ``answers`` tell on which side of its pairs a row stands."""
    tile = np.concatenate(([0], np.cumsum((rows[["key", "band", "i", "j"]].to_numpy()[1:] != rows[["key", "band", "i", "j"]].to_numpy()[:-1]).any(axis=1))))
    rep, component, n = (rows[c].to_numpy(np.int64) for c in ("rep", "component", "n"))
    own, outside = rows["own"].to_numpy(bool), rows["outside"].to_numpy(bool)
    asks, answers = np.flatnonzero(rows["asks"].to_numpy(bool)), np.flatnonzero(rows["answers"].to_numpy(bool))
    n_bytes = np.minimum.reduceat(rows["signature"].map(len).to_numpy(), np.flatnonzero(np.diff(tile, prepend=-1)))[tile]
    begin, end = np.searchsorted(tile[answers], tile[asks]), np.searchsorted(tile[answers], tile[asks], side="right")
    many = end - begin
    for width in np.unique(n_bytes[asks]):
        here = np.flatnonzero((n_bytes[asks] == width) & (many > 0))
        used = np.flatnonzero(n_bytes == width)
        words, at = folded(rows["signature"].iloc[used].tolist(), int(width)), np.empty(len(rows), np.int64)
        at[used] = np.arange(len(used))
        start = 0
        while start < len(here):
            stop = max(start + 1, int(np.searchsorted(np.cumsum(many[here[start:]]), PAIRS, side="right")) + start)
            some = here[start:stop]
            start, counts = stop, many[some]
            x = np.repeat(asks[some], counts)
            y = answers[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[some], counts)]
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            # two members outside the largest component meet once, two visitors in their own tile
            keep = (component[x] != component[y]) & (own[x] | own[y]) & (100 * small >= percent * large) & (~outside[y] | (rep[x] < rep[y]))
            x, y = x[keep], y[keep]
            sizes = n[x] + n[y]
            most = overlap_bound(words[at[x]], words[at[y]], sizes)
            open_ = _may_link(most, sizes, percent)
            out = pd.DataFrame({"a": rep[x][open_], "b": rep[y][open_], "to": component[y][open_], "far": (sizes - 2 * most)[open_], "key": rows["key"].to_numpy(np.int64)[x][open_], "cut": False})
            if few is not None and len(out):
                out = out.sort_values(["key", "a", "to", "far", "b"], ignore_index=True)
                place = out.groupby(["key", "a", "to"]).cumcount()
                out = out.assign(cut=place == few)[place <= few]
            yield out[["a", "b", "key", "cut"]]


def open_pairs(tiles: DataFrame, percent: int, few: int | None) -> DataFrame:
    """(a, b, key, cut): pairs of different components that may link, at most ``few`` (and one more, marked) of a member with a component of a tile."""
    names = ["key", "band", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held[names] == held[names].iloc[-1]).all(axis=1).to_numpy()
            whole, held = held[~last], held[last]
            if len(whole):
                yield from _chunk_pairs(whole.reset_index(drop=True), percent, few)
        if held is not None and len(held):
            yield from _chunk_pairs(held.reset_index(drop=True), percent, few)

    return tiles.repartition(*names).sortWithinPartitions(*names).mapInPandas(run, "a long, b long, key long, cut boolean")


def tiles_of(shared: DataFrame, members: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """The tiles in which several components meet, of ``shared`` (key, rep) and ``members`` (rep, n, signature)."""
    known = members.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = shared.select("key", "rep").join(known.select("rep", "component", "n"), "rep")
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    size_band = F.floor(F.log("n") / np.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    held = held.join(mixed, "key", "left_semi").withColumn("size_band", size_band)
    places = F.array(F.struct(F.col("size_band").alias("band"), F.lit(True).alias("own")), F.struct((F.col("size_band") - 1).alias("band"), F.lit(False).alias("own")))
    placed = materialise(held.withColumn("place", F.explode(places)).select("key", "place.band", "place.own", "rep", "component", "n"), "places")
    parts = placed.groupBy("key", "band", "component").agg(F.count(F.lit(1)).alias("m"), F.count_if("own").alias("m_own"))
    largest = parts.groupBy("key", "band").agg(F.sum("m").alias("m"), F.sum("m_own").alias("m_own"), F.max(F.struct("m", "component")).alias("largest"))
    largest = largest.filter((F.col("m_own") > 0) & (F.col("m") > F.col("largest.m")))
    cut = lambda m: F.ceil(m / BLOCK).cast("int")
    sizes = largest.select("key", "band", F.col("largest.component").alias("largest"), cut(F.col("m") - F.col("largest.m")).alias("n_i"), cut(F.col("m")).alias("n_j"))
    rows = placed.join(sizes, ["key", "band"]).withColumn("outside", F.col("component") != F.col("largest"))
    row_of = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    asking = F.when(F.col("outside"), F.transform(F.sequence(zero, F.col("n_j") - 1), lambda j: row_of(mine("n_i"), j, yes, no))).otherwise(F.expr("array()"))
    answering = F.transform(F.sequence(zero, F.col("n_i") - 1), lambda i: row_of(i, mine("n_j"), no, yes))
    alone = F.array(row_of(zero, zero, F.col("outside"), yes))
    seats = F.when((F.col("n_i") == 1) & (F.col("n_j") == 1), alone).when(F.col("outside"), F.concat(asking, answering)).otherwise(answering)
    seated = rows.withColumn("seat", F.explode(seats)).select("key", "band", "seat.i", "seat.j", "seat.asks", "seat.answers", "own", "outside", "rep", "component", "n")
    return seated.join(members.select("rep", "signature"), "rep")


def _join_components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches without prefixes and signatures, the classes of equal sets, and (node, component) of the linked classes."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))
    rows = materialise(sketch(docs, width, percent, frequent), "join-sketches")
    same = materialise(rows.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "join-classes")
    whole = rows.join(same.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    entries = whole.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").select("key")  # most keys occur once
    met = materialise(entries.join(several, "key", "left_semi"), "join-entries")
    lead = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep"), F.col("n"))).alias("lead"))
    shared = materialise(met.join(lead, "key").distinct(), "join-keys")
    members = whole.withColumnRenamed("doc_id", "rep").join(shared.select("rep").distinct(), "rep", "left_semi")
    members = materialise(members.groupBy("rep").agg(F.min(F.struct(F.col("n_shingles").alias("n"), "signature")).alias("x")).select("rep", "x.n", "x.signature"), "join-members")

    fits = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    met = shared.filter((F.col("rep") != F.col("lead.rep")) & fits).groupBy("rep", F.col("lead.rep").alias("lead")).agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("rep").orderBy(F.desc("times"), F.xxhash64("rep", "lead"), "lead")
    pairs = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= TRIES)
    pairs = pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    tried = materialise(bounded(pairs, members, percent), "leader-pairs")
    links = materialise(confirmed(tried, docs, width, percent), "join-links")
    found = connected_components(links)
    for few in ROUNDS:
        pairs = materialise(open_pairs(tiles_of(shared, members, found, percent), percent, few), "open-pairs")
        fresh = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        fresh = materialise(fresh, "fresh-pairs")
        links = links.unionByName(materialise(confirmed(fresh, docs, width, percent), "join-links"))
        found = connected_components(links)
        tried = tried.unionByName(fresh)
        cut = pairs.filter("cut").select("key").distinct()
        if cut.isEmpty():
            break
        shared = shared.join(cut, "key", "left_semi")  # of the other keys every open pair has been checked
    return rows.drop("prefix", "signature"), same, materialise(found, "join-components")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the components of the exact n-gram Jaccard join of ``docs`` with itself.

    A-Z are lower-cased and words are runs of non-white characters of the whole text. A set holds the distinct
    ``width``-word shingles; a text of fewer words is one shingle, and a null, empty or white text has none and is linked with
    nothing (n_shingles 0, a component of its own). Documents link with 100 * intersection >= ``percent`` * union;
    component_id is the smallest id reachable. Rows that repeat an id get a row each and are one node of the links; a null id
    has the component of its text's other ids, or null. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scope(docs.sparkSession, keep=("join-sketches", "join-classes", "join-components")):
        rows, same, final = _join_components(docs, width, percent)
    labels = same.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(labels, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
