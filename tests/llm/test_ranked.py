import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from isolates.llm import op13_hybrid as op13
from tests.llm.corpus import ODD, documents
from tests.llm.test_operators import lower
from tests.llm.test_search import texts

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_force(docs, items, k):
    """{(item_id, text): [(rank, doc_id, score)]} by a loop over all pairs; docs and items are lists of (id, text)."""
    tf = [Counter(TERM.findall(lower(t))) for _, t in docs]
    df = Counter(w for c in tf for w in c)
    n, length = sum(map(bool, tf)), sum(sum(c.values()) for c in tf)
    out = {}
    for item in set(items):
        scores = []
        for (doc, _), c in zip(docs, tf):
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(TERM.findall(lower(item[1]))) if c[w])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out[item] = [(i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def check(spark, docs, items, k=50):
    frame = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, shard string, n int").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, q int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in op13.ranked(frame, asked, k).collect())
    want = Counter((item[0], *r) for item, found in brute_force(docs, items, k).items() if item[1] is not None for r in found)
    assert got == want


def test_ranks_by_brute_force(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in documents()] + [(r[0], r[1]) for r in ODD] + [(900, "Ünï ünÏ _x-y_ 12"), (7, documents()[3][1])]
    items = [(i, documents()[i][1][:80]) for i in (0, 3, 7, 60)] + [(3, "one"), (3, "one"), (None, "x la lo"), (5, None), (6, ""), (8, "nowhere"), (9, "ünÏ Y")]
    check(spark, docs, items)
    monkeypatch.setattr(op13, "SHARD_ROWS", 20)
    monkeypatch.setattr(op13, "WINDOW", 4)
    monkeypatch.setattr(op13, "STEP", 2)
    monkeypatch.setattr(op13, "BLOCK_BYTES", 60)
    check(spark, docs, items, 3)


def test_ties_copies_and_empty_tables(spark):
    same = [(i, "a b c") for i in range(300)] + [(i, "a b c d") for i in range(300, 330)]
    check(spark, same, [(1, "a"), (2, "d a"), (3, "z")])
    check(spark, [(1, None), (2, ""), (3, "w " * 3_000_000), (4, "w v")], [(1, "w v")])  # one text above a slice
    none = spark.createDataFrame([], "doc_id long, text string")
    some, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert op13.ranked(none, items).collect() == [] and op13.ranked(some, items.limit(0)).collect() == []
    assert op13.ranked(some, items).columns == op13.ranked(none, items).columns == ["item_id", "rank", "doc_id", "score"]


def opened(docs, terms):
    kept = {}

    class Frame:
        filter = select = lambda self, *a: self

        def mapInArrow(self, run, schema):
            kept["run"] = run

    op13.build_index(Frame())
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(len(docs)), "text": docs})
    (made,) = kept["run"](iter([batch]))
    row = {c: made.column(c)[0].as_py() for c in ("lengths", "edges", "texts", "counts")}
    length = made.column("terms")[0].as_py()
    return op13.Shard(row | {"words": made.column("words")[0].values}, len(docs), length, terms)


def test_long_lists_are_skipped(monkeypatch):
    """Texts of one topic lie together, as in a crawl: most postings of the long lists are never read."""
    monkeypatch.setattr(op13.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    docs = sorted(texts(4000), key=lambda t: next(w for w in t.split() if w[0] == "t").split("w")[0])
    items = [docs[3], docs[2000], "t2w1 t2w2 all3", "t5w9 t5w8 all1 all2"]
    most = [0.8, 0.8, 0.8, 0.4]  # whole texts need their topic's lists; of two topic words and two that all have, most is skipped
    terms = pa.array(sorted({w for t in items for w in t.split()}))
    shard = opened(docs, terms)
    tf = [Counter(t.split()) for t in docs]
    df = Counter(w for c in tf for w in c)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) for w in terms.to_pylist()])
    number = {w: i for i, w in enumerate(terms.to_pylist())}
    want = brute_force(list(enumerate(docs)), list(enumerate(items)), 10)
    for item in enumerate(items):
        shard.read = shard.held = 0
        own = np.array([number[w] for w in dict.fromkeys(item[1].split())])
        got, scores = shard.best(own, weight[own], 10)
        assert list(zip(got.tolist(), scores.tolist())) == [(d, s) for _, d, s in want[item]]
        assert 0 < shard.read < most[item[0]] * shard.held


def test_a_shard_is_built_in_little_memory(spark, monkeypatch):
    """What numpy holds at most while 16 MB of text are indexed, and what the shards hold together."""
    monkeypatch.setattr(op13.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    kept = {}

    class Frame:
        filter = select = lambda self, *a: self

        def mapInArrow(self, run, schema):
            kept["run"] = run

    op13.build_index(Frame())
    rng = np.random.default_rng(7)
    docs = [" ".join(f"w{x}" for x in row) for row in rng.zipf(1.3, (8000, 300)).clip(max=50_000).tolist()]
    docs = pa.array([d + " " + "pad " * ((2000 - len(d)) // 4) for d in docs])
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(len(docs)), "text": docs})
    tracemalloc.start()
    made = [(b.column("n")[0].as_py(), b.column("terms")[0].as_py()) for b in kept["run"](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in made) == 8000 and sum(t for _, t in made) == sum(len(t.split()) for t in docs.to_pylist())
    assert peak < 50 << 20
