"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

A tree domain > language > source carries an integer weight at every node. The total budget of tokens
is propagated from the root: at each node the children share the budget by weight, and a child never
gets more than the capacity of its subtree (its tokens times ``max_epochs``). What a short child
leaves goes to its siblings by weight. As a node asks for its whole subtree's capacity, a shortage is
made up below the nearest ancestor that can: by sibling leaves first, then by sibling languages, then
by sibling domains. All of this is integer arithmetic.

A leaf with budget b and t tokens is read for b div t whole epochs; the epoch after them is read in
the seeded order of that epoch until b tokens are reached. The prefix is found without sorting a
leaf: documents fall into ``16 ** HEX`` ranges of the order, only their token sums are accumulated, and
only the one range in which the budget ends is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sized

LEVELS = ("domain", "lang", "source")
HEX = 3  # digits of the order that name a range: 16**3 ranges a leaf
WORD = r"[^\x20\x09-\x0D]+"
Weights = dict[tuple[str, ...], int]


def _weight(path: list[str], weights: Weights, default: int) -> Column:
    """The weight that ``weights`` names for this path, else ``default``."""
    mine = {k: v for k, v in weights.items() if len(k) == len(path)}
    arms = [(reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(path, key, strict=True)]), value) for key, value in sorted(mine.items(), key=str)]
    out = F.lit(default)
    for condition, value in arms:
        out = F.when(condition, F.lit(int(value))).otherwise(out)
    return out.cast("long")


def water_fill(nodes: DataFrame, parent: list[str], child: str, budget: str = "budget") -> DataFrame:
    """``nodes`` (parent columns, child, capacity, weight, budget of the parent) with ``share``.

    In ascending order of capacity / weight, a child is filled while its capacity is at most its
    share of what is left; the others share the rest by weight, rounded down. A weight of 0 or less
    gets nothing.

    Children of equal capacity and weight are filled or left open together, so only the distinct pairs of a parent
    are put in order; the level at which its budget ends is joined back to its children. A parent with very many
    children is thus added up before it is shuffled. Products are decimals: tokens times weights pass 64 bits.
    """
    nodes = nodes.withColumn("weight", F.greatest("weight", F.lit(0)))
    by = [*parent, budget]  # children of a parent have its budget
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    kinds = nodes.filter("weight > 0").groupBy(*by, "capacity", "weight").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy((F.col("capacity") / F.col("weight")).asc(), "capacity", "weight")
    used = F.coalesce(F.sum(exact("capacity") * F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum(exact("weight") * F.col("_n")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    kinds = kinds.withColumns({"_left": exact(budget) - used, "_ahead": ahead, "_at": F.row_number().over(w)})
    level = kinds.filter(exact("capacity") * F.col("_ahead") > F.col("_left") * F.col("weight")).groupBy(*[F.col(c).alias(f"_{c}") for c in by])
    level = level.agg(F.min(F.struct("_at", "_left", "_ahead")).alias("_first"))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    found = nodes.join(level, on, "left")
    full = F.col("_first").isNull() | (exact("capacity") * F.col("_first._ahead") <= F.col("_first._left") * F.col("weight"))
    share = F.when(F.col("weight") == 0, F.lit(0)).when(full, F.col("capacity")).otherwise(F.expr("(_first._left * weight) div _first._ahead"))
    return found.withColumn("share", F.greatest(share, F.lit(0)).cast("long")).select(*nodes.columns, "share")


def leaf_budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: Weights, default_weight: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the ``budget`` of each leaf."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * F.lit(max_epochs))
    above: DataFrame | None = None
    for depth, child in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        level = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if above is None:
            level = level.withColumn("budget", F.least(total, F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
        else:
            on = reduce(lambda x, y: x & y, [F.col(f"n.{c}").eqNullSafe(F.col(f"u.{c}")) for c in path[:-1]])
            level = level.alias("n").join(above.alias("u"), on).select("n.*", "u.budget")
        level = level.withColumn("weight", _weight(path, weights, default_weight))
        above = water_fill(level, path[:-1], child).select(*path, F.col("share").alias("budget"))
    on = reduce(lambda x, y: x & y, [F.col(f"n.{c}").eqNullSafe(F.col(f"u.{c}")) for c in LEVELS])
    return leaves.alias("n").join(above.alias("u"), on).select("n.*", "u.budget")


def mix(
    docs: DataFrame, domain: Column, weights: Weights, share_of_tokens: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: str = "mix",
    default_weight: int = 1, id_col: str = "doc_id", text_col: str = "text", most_leaves: int = 50_000,
) -> DataFrame:
    """How often each document is read: (id, domain, lang, source, n_tokens, leaf_budget, copies).

    ``domain`` is a column over ``docs``; ``lang`` and ``source`` are columns of ``docs``. The total is
    ``share_of_tokens`` (numerator, denominator) of all tokens, at most every leaf's capacity; a token
    is a run of non-white characters. ``copies`` counts the epochs that read the document: a document
    is read if fewer than the leaf's budget of tokens come before it, so a leaf passes its budget by
    less than one document.

    Nulls in domain, lang or source are nodes of their own. Null and empty texts, and texts of white
    space, have no tokens and copies 0. Ties of the seeded order are broken by the id; rows that
    repeat an id share a place in the order and are counted in it one after the other. Other columns are not
    carried. An empty table gives an empty result.
    """
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), domain.alias("domain"), "lang", "source", tokens.alias("n_tokens")), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    grand = rows.agg(F.expr(f"(coalesce(sum(n_tokens), 0L) * {int(share_of_tokens[0])}L) div {int(share_of_tokens[1])}L").alias("total")).first()
    total = F.lit(int(grand["total"])).cast("long")
    leaves = materialise(leaves, "mix-leaves")
    budgets = leaf_budgets(leaves, total, max_epochs, weights, default_weight)
    safe = F.greatest(F.col("tokens"), F.lit(1))
    budgets = budgets.withColumn("epochs", F.expr("budget div greatest(tokens, 1L)")).withColumn("rest", F.col("budget") - F.col("epochs") * safe)
    budgets = materialise(budgets, "mix-budgets")

    key = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in LEVELS]
    on = reduce(lambda x, y: x & y, key)

    def with_leaf(found: DataFrame, columns: list[str]) -> DataFrame:
        joined = rows.alias("d").join(sized(found, most_leaves).alias("b"), on)
        order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("b.epochs").cast("string"), F.coalesce(F.col("d.doc_id").cast("string"), F.lit(""))), 256)
        return joined.select("d.*", *[F.col(f"b.{c}").alias(c) for c in columns], order.alias("_order"))

    base = ["budget", "epochs", "rest"]
    ranges = with_leaf(budgets, base).filter("n_tokens > 0 and rest > 0").groupBy(*LEVELS, "rest", F.substring("_order", 1, HEX).alias("_range")).agg(F.sum("n_tokens").alias("_sum"))
    so_far = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)))
    edge = ranges.filter("_before < rest and _before + _sum >= rest").select(*[F.col(c).alias(f"e_{c}") for c in LEVELS], "_range", "_before")
    on_edge = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"e_{c}")) for c in LEVELS])
    budgets = materialise(budgets.alias("b").join(edge, on_edge, "left").select("b.*", "_range", "_before"), "mix-edges")

    placed = with_leaf(budgets, [*base, "_range", "_before"]).withColumn("_mine", F.substring("_order", 1, HEX))
    at_edge = F.col("_mine").eqNullSafe(F.col("_range")) & (F.col("n_tokens") > 0)
    inside = placed.filter(at_edge)
    w = Window.partitionBy(*LEVELS).orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    inside = inside.withColumn("_last", F.when(start < F.col("rest"), 1).otherwise(0))
    outside = placed.filter(~at_edge).withColumn("_last", F.when((F.col("rest") > 0) & F.col("_range").isNotNull() & (F.col("_mine") < F.col("_range")), 1).otherwise(0))
    both = inside.unionByName(outside)
    copies = F.when(F.col("n_tokens") > 0, F.col("epochs") + F.col("_last")).otherwise(0).cast("long")
    return both.select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), copies.alias("copies"))
