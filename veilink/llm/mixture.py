"""Mixing sources to target weights.

Budgets are set on the tree *source -> language* (any path of columns works). The total is split by weight at every
node. A leaf can give at most ``max_repeats`` times its own tokens; what it can't give goes to its siblings first, and
only what the whole family can't give goes up, to the siblings of its parent. The tree has one leaf for each
distinct path, so it is small and is worked out on the driver.

A leaf's records are ordered by a seeded hash, anew in each epoch. Whole epochs are taken as often as the budget holds
them, then a prefix of the next one. The prefix is found from token sums of hash bins, so only the one bin in
which the budget ends is ever ordered, however many rows a leaf holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .tokens import count_tokens

BINS = 4096


@dataclass
class Node:
    """A node of the weight tree; ``capacity`` of an inner node is the sum of its children's."""

    path: tuple
    weight: float
    capacity: float = 0.0
    by_path: dict[tuple, "Node"] = field(default_factory=dict)
    budget: float = 0.0

    @property
    def children(self) -> list["Node"]:
        return list(self.by_path.values())


def pour(node: Node, amount: float) -> None:
    """Give ``amount`` to a node: by weight to its children, a child's shortage to its siblings by weight."""
    node.budget = min(amount, node.capacity)
    left, open_ = node.budget, [c for c in node.children if c.capacity > 0]
    given = {id(c): 0.0 for c in node.children}
    while open_ and left > 1e-9:
        total = sum(c.weight for c in open_)
        parts = [(c, left * (c.weight / total if total > 0 else 1 / len(open_))) for c in open_]
        full = {id(c): c for c, part in parts if given[id(c)] + part >= c.capacity - 1e-9}
        if not full:
            for c, part in parts:
                given[id(c)] += part
            left = 0.0
        for c in full.values():
            left -= c.capacity - given[id(c)]
            given[id(c)] = c.capacity
        open_ = [c for c in open_ if id(c) not in full]
    for c in node.children:
        pour(c, given[id(c)])


def budgets(leaves: list[tuple[tuple, int]], targets: dict, repeats: dict, total: int | None) -> dict[tuple, float]:
    """Token budget of each leaf. ``leaves``: (path, tokens); ``targets`` and ``repeats`` by the path's first part.

    Paths without a target get nothing. Below the first level the weight is the leaf's own number of tokens. ``total``
    defaults to the most tokens, up to those of all targeted leaves, at which no source that has records falls short.
    """
    root = Node((), 1.0)
    for path, tokens in sorted(leaves, key=lambda x: tuple((v is None, str(v)) for v in x[0])):
        if not targets.get(path[0]):
            continue
        node = root
        for depth in range(1, len(path) + 1):
            child = node.by_path.get(path[:depth])
            if child is None:
                child = node.by_path[path[:depth]] = Node(path[:depth], float(targets[path[0]]) if depth == 1 else 0.0)
            if depth > 1:
                child.weight += tokens
            node = child
        node.capacity = float(tokens * repeats.get(path[0], 1))

    def add_up(n: Node) -> float:
        n.capacity = sum(map(add_up, n.children)) if n.children else n.capacity
        return n.capacity

    add_up(root)
    if total is None:
        some = [c for c in root.children if c.capacity > 0]
        natural, weights = sum(t for p, t in leaves if targets.get(p[0])), sum(c.weight for c in some)
        total = min([natural, *(c.capacity * weights / c.weight for c in some)])
    pour(root, float(total))
    found: dict[tuple, float] = {}

    def collect(n: Node) -> None:
        if n.children:
            for c in n.children:
                collect(c)
        else:
            found[n.path] = n.budget

    for c in root.children:
        collect(c)
    return found


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", levels: tuple[str, ...] = ("source", "lang"),
    total_tokens: int | str | None = None, seed: int = 17, tokenizer: str | None = None,
) -> DataFrame:
    """One row for each record used: its key, ``levels``, ``n_tokens``, ``copies`` (times used, never over the cap), and of its
    source ``target_share`` and ``reached_share``.

    ``total_tokens`` defaults to the most at which the targets are met exactly; ``"all"`` stands for the tokens of all targeted records: then sources
    whose cap is too small fall short, and what they can't give goes to siblings first.
    Records of null or empty text have no tokens and are never used; records whose source is null or without a
    target aren't either. A target without records is shared out among the others. A null language is a leaf of its
    own. A repeated row is a record of its own. Ties of the seeded hash are ordered by key. Empty tables
    give no rows. The record in which a budget ends is used whole where more than half of it lies inside.
    """
    spark, first = documents.sparkSession, levels[0]
    # at most one row a source; a source named twice counts with its weights added and its smaller cap
    goal = targets.where(F.col(first).isNotNull()).groupBy(first).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    wanted = {r[0]: (r[1] or 0.0, r[2] or 0) for r in goal.collect()}
    sized = checkpointed(
        # a text that isn't empty has tokens; a filter on their number would count them twice
        count_tokens(documents.where(F.col(first).isNotNull() & (F.length(text) > 0)), text, out="n_tokens", tokenizer=tokenizer)
        .select(key, *levels, F.col("n_tokens").cast("bigint").alias("n_tokens"))
        .join(F.broadcast(goal.select(first)) if len(wanted) < 100_000 else goal.select(first), first, "left_semi")
    )
    leaf = [F.col(c) for c in levels]
    leaves = [(tuple(r[c] for c in levels), r["tokens"]) for r in sized.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).collect()]
    shares = {s: w for s, (w, _) in wanted.items()}
    if total_tokens == "all":
        total_tokens = sum(t for path, t in leaves if shares.get(path[0]))
    budget = budgets(leaves, shares, {s: m for s, (_, m) in wanted.items()}, total_tokens)
    available = dict(leaves)
    plan = [(*path, int(b // available[path]), float(b - available[path] * (b // available[path]))) for path, b in budget.items()]
    kinds = {f.name: f.dataType.simpleString() for f in sized.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in levels) + ", epochs int, rest double"
    planned = spark.createDataFrame(plan, schema)  # one row a leaf

    same_leaf = F.lit(True)
    for c in levels:
        same_leaf = same_leaf & F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}"))
    placed = (
        sized.alias("s").join((F.broadcast(planned) if len(plan) < 100_000 else planned).alias("p"), same_leaf)
        .select(*[F.col(f"s.{c}").alias(c) for c in sized.columns], "epochs", "rest")
        .withColumn("rank", F.xxhash64(F.col(key), F.col("epochs"), F.lit(seed)))  # the order of the unfinished epoch
        .withColumn("bin", F.shiftrightunsigned("rank", 52).cast("int"))
    )
    # at most BINS sums a leaf
    sums = placed.groupBy(*levels, "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("in_bin").over(Window.partitionBy(*levels).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).withColumn(
        "kind", F.when(F.col("before") + F.col("in_bin") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("cut")
    ).select(*levels, "bin", "before", "kind")
    same_bin = F.col("d.bin") == F.col("e.bin")
    for c in levels:
        same_bin = same_bin & F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}"))
    marked = placed.alias("d").join(edges.alias("e"), same_bin).select(*[F.col(f"d.{c}").alias(c) for c in placed.columns], "before", "kind")
    cut = marked.where("kind = 'cut'")
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*levels, "bin").orderBy("rank", key).rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("copies", F.col("epochs") + F.when(upto - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    whole = marked.where("kind <> 'cut'").withColumn("copies", F.col("epochs") + F.when(F.col("kind") == "in", 1).otherwise(0))
    used = checkpointed(whole.unionByName(cut).where("copies > 0").select(key, *levels, "n_tokens", F.col("copies").cast("int").alias("copies")))

    got = used.groupBy(first).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"))
    reached = goal.join(got, first, "left").select(first, "target_share", F.coalesce("got", F.lit(0)).alias("got"))
    all_got = reached.agg(F.sum("got").alias("all_got"))
    report = reached.crossJoin(F.broadcast(all_got)).select(first, "target_share", (F.col("got") / F.greatest("all_got", F.lit(1))).alias("reached_share"))
    return used.join(F.broadcast(report) if len(wanted) < 100_000 else report, first).select(key, *levels, "n_tokens", "copies", "target_share", "reached_share")


def mix_report(used: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """One row for each target: target and reached share, tokens and records used; zeros for a target without records."""
    got = used.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    rows = targets.join(got, source, "left").na.fill(0, ["tokens", "records", "most_copies"])
    total = rows.agg(F.sum("tokens").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(
        source, "target_share", "max_repeats", F.round(F.col("tokens") / F.greatest("total", F.lit(1)), 6).alias("reached_share"), "tokens", "records", "most_copies"
    )
