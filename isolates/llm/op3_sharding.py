"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the transfers that move the fewest bytes.

Sizes are summed by block (a hash slice of an old shard), which is all that the driver sees. The flow says how
many bytes each old shard keeps and sends to each other one; laid along the old shard's blocks these amounts
become cuts, and a document goes where the middle of its bytes falls; large documents first, then small ones into the room that is left. Slots come from counts by piece (the part
of a block that goes to one shard), so no task holds a shard. ``rewrite`` writes only the shards that change.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.session import materialise, read_table

#: Bytes that a row costs beside its text.
ROW_BYTES = 8
#: Rows that a block should have, and the bounds of the number of blocks of an old shard.
BLOCK_ROWS = 50_000
MIN_BLOCKS, MAX_BLOCKS = 64, 4096
#: Rows up to this size are placed last, into the room that the others leave.
SMALL_BYTES = 2048


def min_cost_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, left, cost = [], [], []
    for u, v, capacity, price in edges:
        for a, b, room, c in ((u, v, capacity, price), (v, u, 0, -price)):
            graph[a].append(len(to))
            to.append(b)
            left.append(room)
            cost.append(c)
    potential = [0] * nodes
    while True:
        far = [float("inf")] * nodes
        far[source], came, heap = 0, [-1] * nodes, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                if left[e] and (n := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], came[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if came[sink] < 0:
            return [left[2 * i + 1] for i in range(len(edges))]
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = to[came[v] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount


def transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, those that stay included. Every move costs the same, so moved bytes meet in a hub."""
    old, new = len(sizes), len(capacities)
    source, hub, sink = 0, old + new + 1, old + new + 2
    edges = [(source, 1 + i, s, 0) for i, s in enumerate(sizes)]
    edges += [(1 + old + j, sink, c, 0) for j, c in enumerate(capacities)]
    stay = [(1 + i, 1 + old + i, min(sizes[i], capacities[i]), 0) for i in range(min(old, new))]
    sent = [(1 + i, hub, s, 1) for i, s in enumerate(sizes)]
    got = [(hub, 1 + old + j, c, 0) for j, c in enumerate(capacities)]
    flow = min_cost_flow(sink + 1, edges + stay + sent + got, source, sink)[old + new :]
    out = {(i, i): f for i, f in enumerate(flow[: len(stay)]) if f}
    send, take = flow[len(stay) : len(stay) + old], flow[len(stay) + old :]
    j = 0
    for i in range(old):
        while send[i]:
            while not take[j]:
                j += 1
            amount = min(send[i], take[j])
            out[i, j] = out.get((i, j), 0) + amount
            send[i] -= amount
            take[j] -= amount
    return out


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def _along(meta: DataFrame, sums: list[tuple[int, int, int]], capacities: list[int], old_shards: int) -> DataFrame:
    """``meta`` with the shard of each row and its place in its piece: the flow's amounts laid along each old shard's blocks."""
    spark = meta.sparkSession
    sizes, begins = [0] * old_shards, []
    for i, block, n in sums:
        begins.append((i, block, sizes[i]))
        sizes[i] += n
    flow, cuts = transfers(sizes, capacities), []
    for i in range(old_shards):
        at, bounds, goes = 0, [], []
        for j in sorted(range(len(capacities)), key=lambda j: (j != i, j)):
            if amount := flow.get((i, j), 0):
                bounds.append(at)
                goes.append(j)
                at += amount
        cuts.append((i, bounds or [0], goes or [i % len(capacities)]))
    # both small tables are bounded by old_shards * 2 * MAX_BLOCKS rows
    begin = spark.createDataFrame(begins, "old_shard int, block int, begin long")
    cut = spark.createDataFrame(cuts, "old_shard int, bounds array<long>, goes array<int>")
    order = ["doc_id", "size", "text_crc32"]
    before = W.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("begin") + F.col("run") - F.col("size") / 2
    return (
        meta.withColumn("run", F.sum("size").over(before))
        .join(F.broadcast(begin), ["old_shard", "block"])
        .join(F.broadcast(cut), "old_shard")
        .withColumn("shard", F.element_at("goes", F.greatest(F.lit(1), F.size(F.filter("bounds", lambda b: b <= middle)))))
        .withColumn("place", F.row_number().over(W.partitionBy("old_shard", "block", "shard").orderBy(*order)) - 1)
        .select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", "place")
    )


def reshard(docs: DataFrame, old: Column, old_shards: int, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for every row, with shards near equal in bytes.

    ``old``: the shard a row lies in now, 0 to ``old_shards`` - 1 (null: 0). Null texts have size 8 and a null
    checksum. Ties and repeated rows each get a slot of their own; an empty table gives no rows. Other columns are
    ignored. Shard sizes differ by a few
    small documents' bytes, if there are enough small documents.
    """
    meta = docs.select(
        "doc_id", text_size().alias("size"), F.crc32("text").alias("text_crc32"), F.coalesce(old, F.lit(0)).cast("int").alias("old_shard")
    )
    meta = materialise(meta, "sizes")
    blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, -(-meta.count() // (old_shards * BLOCK_ROWS))))
    block = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).cast("int")
    # large documents lie first along each old shard, so that small ones can make up for what they leave uneven
    meta = meta.withColumn("block", F.when(F.col("size") > SMALL_BYTES, block).otherwise(block + blocks))
    sums = [tuple(r) for r in meta.groupBy("old_shard", "block").agg(F.sum("size")).orderBy("old_shard", "block").collect()]
    total = sum(n for _, _, n in sums)
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    first = _along(meta, sums, capacities, old_shards)
    large = materialise(first.filter(F.col("block") < blocks), "placed")
    held = {r["shard"]: r["n"] for r in large.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    room = [max(0, c - held.get(j, 0)) for j, c in enumerate(capacities)]
    small = meta.filter(F.col("block") >= blocks)
    small = materialise(_along(small, [s for s in sums if s[1] >= blocks], room, old_shards), "placed")
    placed = large.union(small)
    pieces = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return placed.join(pieces, ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot")
    )


def rewrite(layout: DataFrame, moved: DataFrame, out: str, max_rows_per_file: int = 200_000) -> list[int]:
    """Write the shards that lose or gain a document under ``out``/shard=N, in slot order; return their numbers.

    ``layout``: the rows now, with their ``shard``; ``moved``: what :func:`reshard` gave for them. A shard that
    keeps exactly its documents is not read or written. A row is found by its shard (null: 0), doc_id, size and
    checksum, nulls included; equal rows are numbered on both sides, so each gets a target of its own.
    """
    changed = moved.filter(F.col("shard") != F.col("old_shard")).select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    numbers = sorted(r["s"] for r in changed.collect())
    if numbers:
        keys = ["__old", "__id", "__size", "__crc", "__i"]
        equal = W.partitionBy(*keys[:4])
        target = moved.filter(F.col("old_shard").isin(numbers)).select(
            F.col("old_shard").alias("__old"), F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "slot"
        )
        target = target.withColumn("__i", F.row_number().over(equal.orderBy("shard", "slot"))).alias("t")
        rows = layout.withColumns(
            {"__old": F.coalesce("shard", F.lit(0)).cast("int"), "__id": F.col("doc_id"), "__size": text_size(), "__crc": F.crc32("text")}
        ).drop("shard")
        rows = rows.filter(F.col("__old").isin(numbers)).withColumn("__i", F.row_number().over(equal.orderBy("__id"))).alias("r")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        (
            rows.join(target, same)
            .select(*[F.col(f"r.{c}") for c in layout.columns if c not in ("shard", "slot")], "t.shard", "t.slot")
            .repartition("shard", F.floor(F.col("slot") / max_rows_per_file))
            .sortWithinPartitions("shard", "slot")
            .write.partitionBy("shard").parquet(out)
        )
    return numbers


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a layout by source, in which one shard holds far more than the rest, to 24 shards of near-equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    moved = reshard(docs, F.pmod(F.crc32("source"), F.lit(24)), 24, 24)
    return moved.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
