import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isolates.llm import op8_bm25
from tests.llm.corpus import SCHEMA


def texts(n, topics=8, seed=6):
    """Texts of one topic each: its own words and some that all topics share."""
    rng = np.random.default_rng(seed)
    shared = [f"all{i}" for i in range(30)]
    out = []
    for i in range(n):
        own = [f"t{i % topics}w{j}" for j in range(60)]
        out.append(" ".join(rng.choice(own, rng.integers(5, 60)).tolist() + rng.choice(shared, 8).tolist()))
    return out


def brute_force(docs, query, k):
    tf = [Counter(t.split()) for t in docs]
    df, n, mean = Counter(w for c in tf for w in c), len(docs), sum(len(t.split()) for t in docs) / len(docs)
    found = []
    for i, c in enumerate(tf):
        norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
        s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w, m in Counter(query.split()).items())
        if s > 0:
            found.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


def opened(docs, block):
    kept = {}

    class Frame:
        filter = select = lambda self, *a: self

        def mapInArrow(self, run, schema):
            kept["run"] = run

    op8_bm25.build_index(Frame())
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(len(docs)), "text": docs})
    (made,) = kept["run"](iter([batch]))
    row = {c: made.column(c)[0].as_py() for c in ("ids", "lengths", "groups", "alike", "starts", "numbers", "counts")}
    return op8_bm25.Shard(row | {"words": made.column("words")[0].values}, sum(len(t.split()) for t in docs) / len(docs))


@pytest.mark.parametrize("block", [4, 16])
def test_most_texts_are_skipped_and_none_of_the_best(monkeypatch, block):
    monkeypatch.setattr(op8_bm25, "BLOCK", block)
    docs = texts(4000)
    queries = [docs[3], docs[40], "t2w1 t2w2 all3", "t5w9"]
    shard = opened(docs, block)
    text, word, count, words, _ = op8_bm25.word_counts(pa.array(queries))
    words = words.cast(pa.string())
    df = np.array([sum(w in set(t.split()) for t in docs) for w in words.to_pylist()])
    rarity = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    asked = [(i, word[text == i], count[text == i]) for i in range(len(queries))]
    got = {int(q[0]): list(zip(d.tolist(), s.tolist())) for q, d, s in shard.best(asked, words, rarity, 5)}
    for i, query in enumerate(queries):
        want = brute_force(docs, query, 5)
        assert [d for d, _ in got[i]] == [d for d, _ in want]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want])
    assert shard.scored < 0.35 * len(docs) * len(queries)


def test_copies_and_parts(spark, monkeypatch):
    """A third of the rows is one text; queries that repeat it are searched once, and its lowest ids win."""
    docs = texts(90)
    docs = [docs[0] if i % 3 == 0 else t for i, t in enumerate(docs)] + [None, "", "all1"]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(docs)], SCHEMA).repartition(5)
    asked = frame.filter("doc_id % 5 = 0 or doc_id >= 90").select(F.col("doc_id").alias("query_id"), "text")
    monkeypatch.setattr(op8_bm25, "QUERY_BYTES", 2000)
    monkeypatch.setattr(op8_bm25, "SHARD_ROWS", 20)
    got = {}
    for r in op8_bm25.top_k(frame, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    plain = [t or "" for t in docs]
    for i in [*range(0, 90, 5), 92]:
        want = brute_force(plain, plain[i], 4)
        assert [d for d, _ in got[i]] == [d for d, _ in want] and np.allclose([s for _, s in got[i]], [s for _, s in want])
    assert 90 not in got and 91 not in got
