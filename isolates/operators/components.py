"""Connected components of an undirected edge table: by alternating large-star and small-star rounds, or by contraction.

Stars keep every node in every round. Contraction keeps what is left to be joined only, on numbers instead of names: it is
meant for long chains, which take many rounds of stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolates.session import discard, materialise


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest id in its neighbourhood.

    The minimum per node is a partial aggregate, and the join back to the edges can be split by AQE, so a node
    with very many neighbours does not have to be held by one task.
    """
    lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    met = both.join(lows, "u")
    if larger:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.explode(F.array(*(F.struct(F.col(c).alias("u"), F.col("low").alias("v")) for c in ("v", "u")))).alias("x")).select("x.*")
    return out.filter(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge points from a node that has no other edge to the smallest node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    held = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return held.filter("ups > 1 or (ups = 1 and low = 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node it can reach.

    Nulls and self links add nothing; repeated and reversed edges are fine; an empty table gives an empty table.
    Each round is written to the shared folder, so the plan does not grow and a lost executor costs one round. Edges
    that are stars already take no round.
    """
    current = materialise(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    while not _settled(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True)
        after = materialise(_star(large, larger=False), "edges")
        discard(current) if current.inputFiles() else None
        current = after
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def numbered_nodes(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(name, id): the ends of ``edges``, each with a number of its own, in no order; written once, as the numbers would change if counted again."""
    ends = edges.select(F.col(src).alias("name")).union(edges.select(F.col(dst).alias("name"))).distinct()
    # the hash of a 64-bit number is another one for each: it turns them about and never makes two the same
    return materialise(ends.select("name", F.xxhash64(F.monotonically_increasing_id()).alias("id")), "nodes")


def numbered_ends(edges: DataFrame, nodes: DataFrame, src: str, dst: str) -> DataFrame:
    """``edges`` with the numbers of their ends in ``p`` and ``q``."""
    of = lambda end, number: nodes.select(F.col("name").alias(end), F.col("id").alias(number))
    return edges.join(of(src, "p"), src).join(of(dst, "q"), dst)


def contracted(edges: DataFrame, src: str = "p", dst: str = "q") -> DataFrame:
    """(node, tree) for every node of ``edges``, whose ends are 64-bit numbers; tree is the same number for all nodes of a component and for no others.

    In each round a node goes to the least of itself and its neighbours, nodes that met become one, and the edges that are
    left between them are written. Before the next round all numbers are turned about by a hash that makes no two the
    same, so no order of the nodes is a bad one and the edges dwindle; rounds are put together from the last on.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now, steps = materialise(pairs, "edges"), []
    while not now.isEmpty():
        both = now.union(now.select("v", "u"))
        step = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("tree")), "step")
        steps.append(step)
        of = lambda end: step.select(F.col("node").alias(end), F.xxhash64("tree").alias(f"{end}_tree"))  # noqa: B023, E731
        met = now.join(of("u"), "u").join(of("v"), "v").filter("u_tree <> v_tree")
        after = materialise(met.select(F.greatest("u_tree", "v_tree").alias("u"), F.least("u_tree", "v_tree").alias("v")).distinct(), "edges")
        discard(now) if now.inputFiles() else None
        now = after
    if not steps:
        return now.select(F.col("u").alias("node"), F.col("v").alias("tree"))
    found = steps[-1]
    for turns, step in enumerate(reversed(steps[:-1]), 1):
        last = F.col("tree")
        for _ in range(turns):
            last = F.xxhash64(last)
        later = found.select(F.col("node").alias("next"), F.col("tree").alias("last"))
        found = step.withColumn("next", F.xxhash64("tree")).join(later, "next", "left").select("node", F.coalesce("last", last).alias("tree"))
    return found


def components_of_chains(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """What :func:`connected_components` gives, by contraction."""
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    links = materialise(links, "links")
    nodes = numbered_nodes(links, "u", "v")
    trees = contracted(numbered_ends(links, nodes, "u", "v").select("p", "q"))
    named = materialise(nodes.join(trees, F.col("id") == F.col("node")).select("name", "tree"), "named")
    discard(links) if links.inputFiles() else None
    least = named.groupBy("tree").agg(F.min("name").alias("component"))
    return named.join(least, "tree").select(F.col("name").alias("node"), "component")
