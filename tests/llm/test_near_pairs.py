import random

import numpy as np
import pyarrow as pa

from isolates.llm import near_texts, op10_simhash
from tests.llm.corpus import SCHEMA


def test_short_pairs_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9)]
        rows += [(2 * i, " ".join(words[:8]), "aa", "s", 0), (2 * i + 1, " ".join(words), "aa", "s", 0)]
    got = {r.doc_id: r.kept_id for r in near_texts.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - i % 2 for i in range(800)}



def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 300, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.append(a[: n - n // 3], rng.integers(0, 1 << 63, n // 4).astype(np.uint64))
        maps = near_texts.parity_maps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).cast(pa.large_binary()).to_pylist()
        x, y = (np.frombuffer(m, np.uint64) for m in maps)
        width = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(m.reshape(-1, width), axis=0) for m in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= n // 3 + n // 4


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without bands what is left is op10's step: copies with an edit go, texts with like fingerprints but other sets stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text, often = [word() for _ in range(400)], ["na"] * 900
    texts = [" ".join(text), " ".join([*text[:-1], "end"]), *(" ".join([*often, *(word() for _ in range(30))]) for _ in range(2))]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    linked = {r.doc_id: r.component_id for r in op10_simhash.near_duplicates(docs).collect()}
    assert linked == {0: 0, 1: 0, 2: 2, 3: 2}
    monkeypatch.setattr(near_texts, "band_keys", lambda h, first: pa.array([[]] * (len(first) - 1), pa.list_(pa.int64())))
    got = {r.doc_id: r.kept_id for r in near_texts.near_duplicate_classes(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
