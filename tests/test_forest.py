import random

from isolates.operators import cohort


def test_spanning_forest_and_its_cuts(spark):
    """Against Kruskal's algorithm and a run of components for each threshold, with ties, repeats, nulls and lone samples."""
    rng = random.Random(6)
    names = [f"s{i}" for i in range(40)]
    pairs = [(a, b, rng.randrange(6) if rng.random() < 0.9 else None, 10_000_000 if rng.random() < 0.9 else 5) for i, a in enumerate(names[:35]) for b in names[i + 1 : 35] if rng.random() < 0.15]
    pairs += [(b, a, 5, 10_000_000) for a, b, *_ in pairs[:10]] + [("s1", "s1", 0, 10_000_000)]
    frame = spark.createDataFrame(pairs, "sample_a string, sample_b string, snps int, shared_callable_sites long")
    usable = [(w, *sorted((a, b))) for a, b, w, n in pairs if w is not None and n > 5]

    def trees(most):
        root = {n: n for n in names}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        taken = []
        for w, a, b in sorted(usable):
            x, y = find(a), find(b)
            if x != y and w <= most:
                root[max(x, y)] = min(x, y)
                taken.append((a, b, w))
        groups = {}
        for n in names:
            groups.setdefault(find(n), set()).add(n)
        return taken, {frozenset(g) for g in groups.values() if len(g) > 1}

    found = cohort.minimum_spanning_forest(cohort.comparable_pairs(frame).filter("state = 'comparable'"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(trees(9)[0])
    samples = spark.createDataFrame([(n,) for n in names], "sample_id string")
    got = {}
    for r in cohort.clusters_at(samples, frame, [3, 0, 5, 3]).collect():
        got.setdefault(r.threshold, {}).setdefault(r.cluster_id, set()).add(r.sample_id)
    assert set(got) == {0, 3, 5}
    for t, clusters in got.items():
        lone = clusters.pop(None)
        assert {frozenset(c) for c in clusters.values()} == trees(t)[1] and lone == set(names) - set().union(*clusters.values())
        sizes = [len(clusters[f"C{i + 1}"]) for i in range(len(clusters))]
        assert sizes == sorted(sizes, reverse=True)
    assert cohort.minimum_spanning_forest(frame.limit(0)).columns == ["sample_a", "sample_b", "snps"]
