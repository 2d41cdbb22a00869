"""One id on two texts, rows that repeat, null ids: what the deduplicating stages keep of them, text by text."""

import random

from isolates.llm import near_texts, op5_chunks
from tests.llm.corpus import SCHEMA, words


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=str)


def corpus(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(words(rng, "aa", n))
    a, b, c, d, e = (text(60) for _ in range(5))
    near = a + " end"
    rows = [(1, a), (5, near), (5, b), (7, c), (7, c), (7, c), (None, d), (None, d), (9, d), (None, e), (4, None), (4, ""), (2, "short one"), (2, "short one")]
    return (a, b, c, d, e), spark.createDataFrame([(*r, "aa", f"s{i}", 0) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def test_near_texts_lose_no_text_under_a_shared_id(spark):
    (a, b, c, d, e), docs = corpus(spark)
    kept = near_texts.without_near_duplicates(docs)
    want = [(1, a), (5, b), (7, c), (9, d), (None, e), (2, "short one")]
    got = rows_of(kept)
    assert [r for r in got if r[1]] == sorted(want, key=str) and len([r for r in got if not r[1]]) == 1
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.kept_id) for r in near_texts.near_duplicate_classes(docs).collect()), key=str) == sorted(
        [(1, 1), (5, 1), (5, 5), (7, 7), (7, 7), (7, 7), (None, 9), (None, 9), (9, 9), (None, None), (4, 4), (4, 4), (2, 2), (2, 2)], key=str
    )


def test_passages_are_cut_from_their_own_text(spark):
    (a, b, c, d, e), docs = corpus(spark)
    found = op5_chunks.repeated_passages(docs)
    assert {(r.doc_id, tuple(r.kept_in)) for r in found.collect()} == {(5, (1,)), (None, (9,))}
    cut = op5_chunks.cut_passages(docs, found)
    got = rows_of(cut)
    assert cut.columns == docs.columns
    # the near copy loses what it repeats; the other text under its id and every first copy stay whole, repeated rows once
    for whole in ((1, a), (5, b), (7, c), (9, d), (None, e), (2, "short one"), (4, None), (4, "")):
        assert got.count(whole) == 1
    assert len(got) == 10
    (left,) = [t for i, t in got if i == 5 and t != b]
    assert len(left.split()) < 30 and left.endswith("end")
    (rest,) = [t for i, t in got if i is None and t != e]
    assert len(rest.split()) < 25
