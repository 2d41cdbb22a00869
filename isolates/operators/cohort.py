"""Cohort operators: joint variant table, masked pairwise distances with their denominators, clusters, trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALUE
from isolates.operators import checks, report
from isolates.operators import intervals as I
from isolates.operators.components import components_of_chains, contracted, numbered_ends, numbered_nodes
from isolates.session import discard, materialise, ship_package

AMBIGUOUS = "N"
NOT_CALLABLE = "?"
#: Samples and positions of one side of a sweep over callable regions, and segments that are multiplied at once.
SAMPLE_BLOCK, SPAN, STRIP = 256, 1 << 16, 1 << 13


def usable_variants(variants: DataFrame, include_indels: bool = True) -> DataFrame:
    """Variants that enter the joint table: passing, with an alternative, and indels only if wanted."""
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    kept = variants.filter(E.passes(F.col("filters")) & (F.coalesce("alt", F.lit("")) != "") & (F.col("alt") != F.col("ref")))
    kept = kept.withColumn("is_snp", snp)
    return kept if include_indels else kept.filter("is_snp")


def joint_sites(variants: DataFrame) -> DataFrame:
    """(chrom, pos, ref, is_snp, genes): one row for each variable position; one sample's indel makes it no SNP for all."""
    return variants.groupBy("chrom", "pos").agg(
        F.upper(F.min("ref")).alias("ref"), F.bool_and("is_snp").alias("is_snp"), F.sort_array(F.collect_set("gene")).alias("genes")
    )


def joint_alleles(variants: DataFrame) -> DataFrame:
    """(chrom, pos, sample_id, allele): where a sample departs from the reference; N for minority or several alleles."""
    major = F.coalesce("is_major", F.col("allele_fraction") >= VALUE["major_variant_fraction"])
    allele = F.when(major.eqNullSafe(False), AMBIGUOUS).otherwise(F.upper("alt"))
    named = variants.select("chrom", "pos", "sample_id", allele.alias("allele"))
    return named.groupBy("chrom", "pos", "sample_id").agg(F.when(F.count_distinct("allele") > 1, AMBIGUOUS).otherwise(F.min("allele")).alias("allele"))


def joint_table(variants: DataFrame, regions: DataFrame, samples: DataFrame) -> DataFrame:
    """Every variable position of every sample: its allele, else the reference inside its callable regions, else ``?``.

    This is the dense table that the report shows; distances work from the sparse parts.
    """
    sites, alleles = joint_sites(variants), joint_alleles(variants)
    grid = sites.select("chrom", "pos", "ref", "is_snp").join(samples.select("sample_id").distinct(), how="cross")
    callable_ = I.inside(grid.select("sample_id", "chrom", "pos"), regions, ["sample_id", "chrom"], width=I.mean_width(regions)).withColumn("__in", F.lit(True))
    out = grid.join(alleles, ["chrom", "pos", "sample_id"], "left").join(callable_, ["sample_id", "chrom", "pos"], "left")
    shown = F.coalesce("allele", F.when(F.col("__in"), F.col("ref")), F.lit(NOT_CALLABLE))
    return out.select("chrom", "pos", "ref", "is_snp", "sample_id", shown.alias("allele"))


def shared_bases(regions: DataFrame, block: int = SAMPLE_BLOCK, span: int = SPAN) -> DataFrame:
    """(kind, sample_a, sample_b, bases): the positions that both samples of a pair hold, for each kind of ``regions``; pairs with none are left out.

    ``regions``: kind, sample_id, chrom, start_pos, end_pos; merged within a sample. With a boolean column ``fresh`` only pairs
    with a fresh sample are counted. Intervals are not joined to one
    another: a sweep goes over the starts and ends of ``block`` samples against ``block`` others within ``span``
    positions, as products of matrices (samples by segments between two events), a strip of segments at a time. A group
    holds at most twice ``block`` samples within ``span`` positions, whatever the cohort; each interval is copied once for
    each block of samples.
    """
    ship_package(regions.sparkSession)
    regions = regions if "fresh" in regions.columns else regions.withColumn("fresh", F.lit(True))
    samples = regions.select("sample_id").distinct().count()
    blocks = max(1, -(-samples // block))
    cut = I.binned(regions.filter(F.col("start_pos") < F.col("end_pos")), span)
    low, high = F.greatest(F.col("start_pos"), F.col("bin") * span), F.least(F.col("end_pos"), (F.col("bin") + 1) * span)
    mine = F.pmod(F.xxhash64("sample_id"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    cut = cut.select("kind", "sample_id", "fresh", "chrom", "bin", (low - F.col("bin") * span).cast("int").alias("a"), (high - F.col("bin") * span).cast("int").alias("z"), mine.alias("mine"), other)
    cut = cut.withColumns({"one": F.least("mine", "other"), "two": F.greatest("mine", "other")})

    def sweep(group: pa.Table) -> pa.Table:
        name = group.column("sample_id").combine_chunks().dictionary_encode()
        names = np.array(name.dictionary.to_pylist(), object)
        of, a, z = name.indices.to_numpy(), group.column("a").to_numpy(), group.column("z").to_numpy()
        side, fresh = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        side[of] = group.column("mine").to_numpy()
        fresh[of] = group.column("fresh").to_numpy(zero_copy_only=False)
        edges = np.unique(np.concatenate([a, z]))
        width = np.diff(edges).astype(np.float32)
        begin, end = np.searchsorted(edges, a), np.searchsorted(edges, z)
        rows = np.flatnonzero(fresh)
        both, open_ = np.zeros((len(rows), len(names)), np.float64), np.zeros(len(names), np.float32)
        for c in range(0, len(width) if len(rows) else 0, STRIP):
            n = min(STRIP, len(width) - c)
            held = np.zeros((len(names), n), np.float32)
            held[:, 0] = open_
            for at, step in ((begin, 1), (end, -1)):
                on = (at >= c) & (at < c + n)
                np.add.at(held, (of[on], at[on] - c), step)
            np.cumsum(held, axis=1, out=held)
            both += (held[rows] * width[c : c + n]) @ held.T
            open_ = held[:, -1]
        x, y = np.nonzero(both)
        bases, x = both[x, y], rows[x]
        # two fresh samples meet once
        on = (names[x] < names[y]) | (~fresh[y] & (names[x] > names[y]))
        if group.column("one")[0].as_py() != group.column("two")[0].as_py():
            on &= side[x] != side[y]
        x, y, bases = x[on], y[on], bases[on]
        first, second = np.minimum(names[x], names[y]), np.maximum(names[x], names[y])
        kind = pa.array([group.column("kind")[0].as_py()] * len(x), pa.string())
        return pa.table({"kind": kind, "sample_a": pa.array(first, pa.string()), "sample_b": pa.array(second, pa.string()), "bases": pa.array(bases.astype(np.int64))})

    found = cut.drop("other").groupBy("kind", "chrom", "bin", "one", "two").applyInArrow(sweep, "kind string, sample_a string, sample_b string, bases long")
    return found.groupBy("kind", "sample_a", "sample_b").agg(F.sum("bases").alias("bases"))


def pairwise_distances(
    variants: DataFrame, regions: DataFrame, mask: DataFrame, samples: DataFrame, window: int = int(VALUE["snp_proximity"]), fresh: DataFrame | None = None
) -> DataFrame:
    """(sample_a, sample_b, snps, shared_callable_sites, masked_sites, indel_sites, ambiguous_sites) for all pairs.

    ``regions``: sample_id, chrom, start_pos, end_pos, merged; ``mask``: chrom, start_pos, end_pos, merged. A pair of
    which one sample has no regions has NULL distance and denominator. Only positions at which one of the two departs
    from the reference are looked at: ambiguous ones come off the denominator, differences at SNP sites count unless
    another comparable variable position lies within ``window``. The mask is taken from each sample once, so its cost
    does not grow with the pairs. The pairs themselves are the result. ``fresh`` (sample_id): only pairs with one of these,
    for a cohort that grows.
    """
    names = samples.select("sample_id").distinct()
    if fresh is None:
        marked = names.withColumn("fresh", F.lit(True))
    else:
        marked = materialise(names.join(fresh.select("sample_id", F.lit(True).alias("fresh")).distinct(), "sample_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), "names")
    pairs = marked.select(F.col("sample_id").alias("sample_a"), F.col("fresh").alias("fresh_a")).join(marked.select(F.col("sample_id").alias("sample_b"), F.col("fresh").alias("fresh_b")), F.col("sample_a") < F.col("sample_b"))
    pairs = pairs.filter(F.col("fresh_a") | F.col("fresh_b")).select("sample_a", "sample_b")
    keys = ["sample_id", "chrom"]
    # both are read several times, and may be whole pipelines
    regions = materialise(regions.select(*keys, "start_pos", "end_pos"), "regions")
    variants = materialise(variants.select(*keys, "pos", "ref", "alt", "gene", "is_major", "allele_fraction", "is_snp"), "joint")
    # the mask as far as it lies in a sample's regions: no row for each sample and masked interval
    inside = I.overlap_join(regions, mask.select("chrom", "start_pos", "end_pos"), ["chrom"]).select(*keys, "start_pos", "end_pos")
    clean = materialise(I.subtract(regions, inside, keys), "clean")
    sites = joint_sites(variants)
    alleles = joint_alleles(variants).join(sites.select("chrom", "pos", "ref", "is_snp"), ["chrom", "pos"])
    # what each sample has at the variable positions inside its unmasked regions: its allele or the reference
    width = I.mean_width(clean)
    held = I.binned(clean, width).withColumnRenamed("chrom", "__chrom")
    at = F.col("pos") - 1
    same = (F.col("chrom") == F.col("__chrom")) & (F.floor(at / width) == F.col("bin")) & (at >= F.col("start_pos")) & (at < F.col("end_pos"))
    spots = sites.select("chrom", "pos", "ref", "is_snp").join(held, same).select("chrom", "pos", "ref", "is_snp", "sample_id")
    here = spots.join(alleles.select("chrom", "pos", "sample_id", "allele"), ["chrom", "pos", "sample_id"], "left")
    here = materialise(here.select("chrom", "pos", "sample_id", "is_snp", F.coalesce("allele", "ref").alias("allele"), F.col("allele").isNotNull().alias("departs")), "here")
    here = here.withColumn("fresh", F.lit(True)) if fresh is None else here.join(marked, "sample_id")
    # only samples that depart are paired with the others at a site; two that both do meet once
    a = here.filter("departs").select("chrom", "pos", "is_snp", F.col("sample_id").alias("one"), F.col("allele").alias("allele_a"), F.col("fresh").alias("fresh_a"))
    b = here.select("chrom", "pos", F.col("sample_id").alias("other"), F.col("allele").alias("allele_b"), F.col("departs").alias("departs_b"), F.col("fresh").alias("fresh_b"))
    met = a.join(b, ["chrom", "pos"]).filter((F.col("one") != F.col("other")) & (~F.col("departs_b") | (F.col("one") < F.col("other"))) & (F.col("fresh_a") | F.col("fresh_b")))
    met = met.withColumns({"sample_a": F.least("one", "other"), "sample_b": F.greatest("one", "other")})
    unclear = (F.col("allele_a") == AMBIGUOUS) | (F.col("allele_b") == AMBIGUOUS)
    met = met.withColumn("unclear", unclear)
    differs = ~F.col("unclear") & (F.col("allele_a") != F.col("allele_b"))
    # neighbours are comparable variable positions of the pair
    order = W.partitionBy("sample_a", "sample_b", "chrom", "unclear").orderBy("pos")
    near = (F.col("pos") - F.lag("pos").over(order) <= window) | (F.lead("pos").over(order) - F.col("pos") <= window)
    met = met.withColumn("near", F.coalesce(near, F.lit(False)) & (F.lit(window) > 0))
    counted = met.groupBy("sample_a", "sample_b").agg(
        F.count_if("unclear").alias("ambiguous_sites"),
        F.count_if(differs & ~F.col("is_snp")).alias("indel_sites"),
        F.count_if(differs & F.col("is_snp") & ~F.col("near")).alias("snps"),
    )
    with_regions = regions.select("sample_id").distinct()
    known = pairs
    for side in ("sample_a", "sample_b"):
        known = known.join(with_regions.select(F.col("sample_id").alias(side), F.lit(True).alias(f"__{side}")), side, "left")
    both = F.coalesce(F.col("__sample_a") & F.col("__sample_b"), F.lit(False))
    kinds = regions.withColumn("kind", F.lit("all")).unionByName(clean.withColumn("kind", F.lit("clean")))
    shared = shared_bases(kinds if fresh is None else kinds.join(marked, "sample_id")).groupBy("sample_a", "sample_b")
    shared = shared.agg(*[F.sum(F.when(F.col("kind") == k, F.col("bases"))).alias(k) for k in ("clean", "all")])
    out = known.join(shared, ["sample_a", "sample_b"], "left").join(counted, ["sample_a", "sample_b"], "left")
    zero = lambda c: F.when(both, F.coalesce(F.col(c), F.lit(0)))
    return out.select(
        "sample_a",
        "sample_b",
        zero("snps").alias("snps"),
        F.greatest(zero("clean") - zero("ambiguous_sites"), F.lit(0)).alias("shared_callable_sites"),
        (zero("all") - zero("clean")).alias("masked_sites"),
        zero("indel_sites").alias("indel_sites"),
        zero("ambiguous_sites").alias("ambiguous_sites"),
    ).withColumn("shared_callable_sites", F.when(F.col("snps").isNotNull(), F.col("shared_callable_sites")))


def callable_summary(regions: DataFrame) -> DataFrame:
    """(sample_id, bases, share): callable bases of each sample, and as a share of the largest sample's."""
    held = I.lengths(regions, ["sample_id"])
    most = held.agg(F.max("bases").alias("most"))
    return held.join(F.broadcast(most), how="cross").select("sample_id", "bases", E.ratio("bases", "most").alias("share"))


def comparable_pairs(pairs: DataFrame, floor: int = int(VALUE["min_shared_callable"])) -> DataFrame:
    """``pairs`` with ``state``: uncomputed (no distance), thin (denominator under the floor) or comparable."""
    state = F.when(F.col("snps").isNull(), "uncomputed").when(F.coalesce("shared_callable_sites", F.lit(0)) < floor, "thin").otherwise("comparable")
    return pairs.withColumn("state", state).withColumn("snps_per_mb", E.ratio(F.col("snps") * 1e6, F.col("shared_callable_sites")))


def cluster_members(samples: DataFrame, pairs: DataFrame, threshold: int = int(VALUE["cluster_default"]), floor: int = int(VALUE["min_shared_callable"])) -> DataFrame:
    """(sample_id, cluster_id): single-linkage clusters of two or more, C1 the largest; NULL for the others.

    Ties in size go by the first member in natural order. Pairs without a distance or with a thin denominator link nothing.
    """
    links = comparable_pairs(pairs, floor).filter((F.col("state") == "comparable") & (F.col("snps") <= threshold))
    found = components_of_chains(links, "sample_a", "sample_b")
    return samples.select("sample_id").distinct().join(_numbered(found, []).select(F.col("node").alias("sample_id"), "cluster_id"), "sample_id", "left")


def _numbered(found: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` (keys, node, component) with ``cluster_id``, C1 the largest of its ``keys``, ties by the first member in natural order."""
    size = found.groupBy(*keys, "component").agg(F.count("*").alias("size"), F.min(E.natural_key(F.col("node"))).alias("first"))
    # numbered within each size, after all clusters of larger sizes: as many sizes as there are, at most the root of twice the samples
    sizes = size.groupBy(*keys, "size").agg(F.count("*").alias("n"))
    other = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("size").alias("s"), F.col("n").alias("m"))
    above = F.col("s") > F.col("size")
    for k in keys:
        above = above & (F.col(k) == F.col(f"__{k}"))
    larger = sizes.join(other, above, "left").groupBy(*keys, "size").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy(*keys, "size").orderBy("first"))
    ids = size.withColumn("i", place).join(larger, [*keys, "size"]).withColumn("cluster_id", F.concat(F.lit("C"), (F.col("before") + F.col("i")).cast("string")))
    return found.join(ids.select(*keys, "component", "cluster_id"), [*keys, "component"])


def departing_at_changed_sites(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sample_id) of ``before`` that depart at sites which other samples have changed: a site that is no SNP any more, or another reference.

    Distances of their pairs change though neither sample did. ``before``, ``after``: variants of the joint table.
    """
    old, new = joint_sites(before).select("chrom", "pos", "ref", "is_snp"), joint_sites(after).select("chrom", "pos", F.col("ref").alias("ref_now"), F.col("is_snp").alias("is_now"))
    changed = old.join(new, ["chrom", "pos"], "left").filter(~F.col("ref").eqNullSafe(F.col("ref_now")) | ~F.col("is_snp").eqNullSafe(F.col("is_now")))
    return before.join(changed.select("chrom", "pos"), ["chrom", "pos"], "left_semi").select("sample_id").distinct()


def cluster_summary(members: DataFrame, pairs: DataFrame, threshold: int, floor: int = int(VALUE["min_shared_callable"])) -> DataFrame:
    """One row a cluster: size, members, largest distance and least denominator inside, compared pairs, chaining flag."""
    inside = members.filter("cluster_id is not null")
    listed = inside.groupBy("cluster_id").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct(E.natural_key(F.col("sample_id")).alias("k"), "sample_id"))), lambda x: x["sample_id"]).alias("members"))
    a = inside.select(F.col("sample_id").alias("sample_a"), "cluster_id")
    b = inside.select(F.col("sample_id").alias("sample_b"), F.col("cluster_id").alias("other"))
    own = comparable_pairs(pairs, floor).filter("state = 'comparable'").join(a, "sample_a").join(b, "sample_b").filter("cluster_id = other")
    seen = own.groupBy("cluster_id").agg(F.max("snps").alias("max_distance"), F.min("shared_callable_sites").alias("min_shared_callable_sites"), F.count("*").alias("compared"))
    out = listed.join(seen, "cluster_id", "left")
    return out.withColumns({"chained": F.col("max_distance") > threshold, "all_compared": F.coalesce("compared", F.lit(0)) * 2 == F.col("size") * (F.col("size") - 1)})


def minimum_spanning_forest(edges: DataFrame, src: str = "sample_a", dst: str = "sample_b", weight: str = "snps") -> DataFrame:
    """The edges (src, dst, weight) of a minimum spanning forest: ties go to the lower pair of names, so there is only one.

    Rounds of Boruvka: every tree takes its lightest edge to another tree, the trees so joined become one, and of the
    edges between two trees the lightest stays. Trees at least halve in number each round, which is written to the shared
    folder. Self links, nulls and heavier copies of an edge are never taken; an empty table gives none.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    some = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(weight).isNotNull() & (F.col(src) != F.col(dst)))
    some = materialise(some.groupBy(a.alias("a"), b.alias("b")).agg(F.min(weight).alias("w")), "pairs")
    # numbers that go up with weight and names stand for the edges, so rounds compare numbers only
    line = materialise(some.orderBy("w", "a", "b").select("a", "b", "w", F.monotonically_increasing_id().alias("edge")), "line")
    nodes = numbered_nodes(line, "a", "b")
    now, taken = materialise(numbered_ends(line, nodes, "a", "b").select("p", "q", "edge"), "forest"), []
    discard(some) if some.inputFiles() else None
    while not now.isEmpty():
        sides = now.select("p", "edge").union(now.select(F.col("q").alias("p"), "edge"))
        chosen = materialise(sides.groupBy("p").agg(F.min("edge").alias("edge")).select("edge").distinct(), "chosen")
        taken.append(chosen)
        trees = materialise(contracted(now.join(chosen, "edge", "left_semi")), "trees")
        of = lambda side: trees.select(F.col("node").alias(side), F.col("tree").alias(f"{side}_tree"))  # noqa: B023, E731
        left = now.join(of("p"), "p").join(of("q"), "q").filter("p_tree <> q_tree")
        p, q = F.least("p_tree", "q_tree"), F.greatest("p_tree", "q_tree")
        after = materialise(left.groupBy(p.alias("p"), q.alias("q")).agg(F.min("edge").alias("edge")), "forest")
        discard(now)
        discard(trees)
        now = after
    picked = now.select("edge")
    for part in taken:
        picked = picked.union(part)
    return line.join(picked, "edge", "left_semi").select(F.col("a").alias(src), F.col("b").alias(dst), F.col("w").alias(weight))


def clusters_at(samples: DataFrame, pairs: DataFrame, thresholds: list[int], floor: int = int(VALUE["min_shared_callable"])) -> DataFrame:
    """(threshold, sample_id, cluster_id) for any number of thresholds, from one spanning forest and one run of components.

    Single-linkage clusters at a threshold are the trees that are left when the forest's heavier edges are cut, so the
    pairs are read once, and each threshold adds the forest's edges, fewer than there are samples.
    """
    links = comparable_pairs(pairs, floor).filter((F.col("state") == "comparable") & (F.col("snps") <= max(thresholds)))
    forest = minimum_spanning_forest(links)
    at = F.explode(F.filter(F.array(*[F.lit(t) for t in sorted(set(thresholds))]), lambda t: t >= F.col("snps"))).alias("threshold")
    cut = forest.select("sample_a", "sample_b", at)
    node = lambda c: F.struct("threshold", F.col(c).alias("name"))
    found = components_of_chains(cut.select(node("sample_a").alias("src"), node("sample_b").alias("dst")))
    found = found.select("node.threshold", F.col("node.name").alias("node"), F.col("component.name").alias("component"))
    numbered = _numbered(found, ["threshold"]).select("threshold", F.col("node").alias("sample_id"), "cluster_id")
    grid = samples.select("sample_id").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in sorted(set(thresholds))])))
    return grid.join(numbered, ["threshold", "sample_id"], "left").select("threshold", "sample_id", "cluster_id")


def assemble(variants: DataFrame, regions: DataFrame, mask: DataFrame, samples: DataFrame, threshold: int = int(VALUE["cluster_default"]), floor: int = int(VALUE["min_shared_callable"])) -> dict[str, DataFrame]:
    """A whole cohort: its ``table``, ``pairs`` (with their state and whether they share a cluster), ``members``, ``clusters`` and ``checks``.

    Pairs and members are written once in the shared folder, as everything else is read off them.
    """
    names = samples.select("sample_id").distinct()
    pairs = materialise(pairwise_distances(variants, regions, mask, names), "pairs")
    members = materialise(cluster_members(names, pairs, threshold, floor), "members")
    clusters = cluster_summary(members, pairs, threshold, floor)
    return {
        "table": joint_table(variants, regions, names),
        "pairs": report.distance_rows(comparable_pairs(pairs, floor), members, threshold, floor),
        "members": members,
        "clusters": clusters,
        "checks": checks.cohort_checks(names, pairs, clusters, threshold, masked=not mask.isEmpty(), floor=floor),
    }


def pair_of(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """The row of two samples, in either order."""
    return pairs.filter(F.col("sample_a").isin(one, other) & F.col("sample_b").isin(one, other) & (F.col("sample_a") != F.col("sample_b")))


def upgma(pairs: DataFrame) -> DataFrame:
    """(left, right, height, size): average-linkage merges, nodes named by their lowest sample.

    Samples with any missing distance are left out. In each round every pair of clusters that are each other's
    nearest is merged; average linkage is reducible, so this gives the same tree as one merge at a time, up to ties.
    Columns of ``pairs``: sample_a, sample_b, snps.
    """
    both = pairs.select(F.col("sample_a").alias("s"), "snps").union(pairs.select(F.col("sample_b"), "snps"))
    bad = both.filter("snps is null").select("s").distinct()
    kept = pairs.join(bad.withColumnRenamed("s", "sample_a"), "sample_a", "left_anti").join(bad.withColumnRenamed("s", "sample_b"), "sample_b", "left_anti")
    one = F.lit(1).cast("long")
    now = kept.select(F.least("sample_a", "sample_b").alias("a"), F.greatest("sample_a", "sample_b").alias("b"), F.col("snps").cast("double").alias("d"), one.alias("na"), one.alias("nb"))
    now, merges = materialise(now, "upgma"), None
    while not now.isEmpty():
        sides = now.select("a", "b", "d").union(now.select(F.col("b"), F.col("a"), "d"))
        nearest = sides.groupBy("a").agg(F.min_by("b", F.struct("d", F.least("a", "b"), F.greatest("a", "b"))).alias("n"))
        back = nearest.select(F.col("a").alias("n"), F.col("n").alias("back"))
        mutual = nearest.join(back, "n").filter((F.col("back") == F.col("a")) & (F.col("a") < F.col("n"))).select("a", F.col("n").alias("b"))
        joined = now.join(mutual, ["a", "b"]).select(F.col("a").alias("left"), F.col("b").alias("right"), (F.col("d") / 2).alias("height"), (F.col("na") + F.col("nb")).alias("size"))
        joined = materialise(joined, "merges")
        merges = joined if merges is None else merges.union(joined)
        to = joined.select(F.col("right").alias("was"), F.col("left").alias("into")).union(joined.select("left", "left"))
        x = now.join(to.withColumnsRenamed({"was": "a", "into": "ia"}), "a", "left").join(to.withColumnsRenamed({"was": "b", "into": "ib"}), "b", "left")
        x = x.select(F.coalesce("ia", "a").alias("p"), F.coalesce("ib", "b").alias("q"), "d", "na", "nb").filter("p != q")
        flip = F.col("p") > F.col("q")
        pick = lambda c, d: F.when(flip, F.col(d)).otherwise(F.col(c))
        x = x.select(pick("p", "q").alias("a"), pick("q", "p").alias("b"), "d", pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"))
        weight = F.col("na") * F.col("nb")
        sizes = joined.select(F.col("left").alias("c"), "size")
        after = x.groupBy("a", "b").agg((F.sum(F.col("d") * weight) / F.sum(weight)).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        after = after.join(sizes.withColumnsRenamed({"c": "a", "size": "sa"}), "a", "left").join(sizes.withColumnsRenamed({"c": "b", "size": "sb"}), "b", "left")
        after = materialise(after.select("a", "b", "d", F.coalesce("sa", "na").alias("na"), F.coalesce("sb", "nb").alias("nb")), "upgma")
        discard(now)
        now = after
    return merges if merges is not None else now.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), F.col("na").alias("size"))
