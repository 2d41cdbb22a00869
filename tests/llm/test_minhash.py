import random

import numpy as np
import pyarrow as pa
import pytest

from isolates.llm import op12_minhash as op12
from isolates.llm.near_texts import shingle_sets
from tests.llm.corpus import ODD, SCHEMA, documents
from tests.llm.test_operators import SPACE_WORDS, components, lower


def shingles(text):
    w = SPACE_WORDS.findall(lower(text))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    linked = lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    return sets, components(list(sets), linked)


def edits(rng, n, at):
    """Texts of ``n`` words around one original, each with a run of changed words at one end: similarities near 0.85."""
    original = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = [original]
    for gone in at:
        out.append(original[gone:])
        out.append(original[: n - gone] + [f"x{rng.randrange(10**6)}" for _ in range(gone)])
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("tile", [512, 4])
def test_classes_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op12, "TILE", tile)
    rng = random.Random(5)
    texts = {r[0]: r[1] for r in documents()}
    near = [t for n in (6, 11, 12, 18, 24, 60, 200) for t in edits(rng, n, (1, 2, n // 7, n // 6, n // 5))]
    near += [near[-1].upper(), " " + near[-1], "a b c d e", "a b c d", "A  b c d"]
    texts |= {1000 + i: t for i, t in enumerate(near)}
    sets, want = classes(texts)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op12.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_odd_rows(spark):
    """One id on two texts, repeated rows, null ids, a text above a slice, and clashing names."""
    long = " ".join(f"w{i}" for i in range(800_000))
    rows = [r[:2] for r in ODD] + [(5, "p q r s t u"), (5, "la la la"), (None, "null only once here now"), (8, long), (9, long + " end"), (None, "p q r s t u")]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, bucket int, hash string, component int").repartition(2)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op12.near_duplicates(frame).collect()), key=str)
    six = len(shingles("a b c d e f"))
    want = [(None, 0, None), (1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, six, None)]
    want += [(5, 2, 5), (5, 1, 3), (None, 1, None), (8, 799_996, 8), (9, 799_997, 8), (None, 2, 5)]
    assert got == sorted(want, key=str)
    assert op12.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_densified_bins_agree_as_often_as_sets_are_alike():
    rng = random.Random(2)
    for n in (6, 40, 1000):
        agree = []
        for _ in range(60):
            words = [str(rng.random()) for _ in range(n + 4)]
            cut = max(1, n // 8)
            h, first = shingle_sets(pa.array([" ".join(words), " ".join(words[cut:])]), 5)
            a, b = op12.sketches(h, first)
            agree.append((a == b).mean() - (n - cut) / n)
        assert abs(np.mean(agree)) < 0.03


def test_a_bucket_has_a_star(spark):
    nodes = spark.createDataFrame([(i, [7, 100 + i]) for i in range(50)], "id long, bands array<long>")
    assert op12.star_edges(nodes).count() == 49
