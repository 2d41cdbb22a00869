import random

from isolates.operators import components


def test_components_of_chains_trees_and_stars(spark, monkeypatch):
    """Against a loop over the edges; edges that are stars are written once and take no round."""
    written = []
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or plain(df, name))
    rng = random.Random(4)
    chain = [(i + 1, i) for i in range(20)]
    tree = [(100 + i, 100 + rng.randrange(i)) for i in range(1, 40)]
    ring = [(201, 202), (202, 203), (203, 201), (203, 203), (None, 202), (205, None), (202, 201)]
    star = [(300 + i, 300) for i in range(1, 30)] + [(300, 301), (307, 307)]
    for edges, rounds in ((chain + tree + ring + star, None), (star, 0), ([], 0)):
        low = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
        for _ in low:
            for a, b in edges:
                if a in low and b in low:
                    low[a] = low[b] = min(low[a], low[b])
        written.clear()
        got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
        assert sorted((r.node, r.component) for r in got) == sorted(low.items())
        assert rounds is None or len(written) == rounds + 1


def test_contraction_gives_the_same_components_in_few_rounds(spark, monkeypatch):
    """Names of any kind, numbers in order along a long chain, which is the slowest for rounds of stars."""
    written = []
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or plain(df, name))
    rng = random.Random(5)
    chain = [(f"n{i:05}", f"n{j:05}") for i in range(1500) for j in (i + 1, i + 2, i + 3) if i // 700 == j // 700]
    tree = [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 60)]
    odd = [("x", "x"), (None, "x"), ("y", None), ("z", "y"), ("y", "z"), ("z", "y")]
    frame = spark.createDataFrame(chain + tree + odd, "src string, dst string").coalesce(1)
    want = sorted((r.node, r.component) for r in components.connected_components(frame).collect())
    written.clear()
    got = sorted((r.node, r.component) for r in components.components_of_chains(frame).collect())
    assert got == want and written.count("step") <= 10
    assert components.components_of_chains(frame.limit(0)).collect() == []
