import random

import pyarrow as pa
import pytest

from isolates.llm import op5_chunks
from tests.llm.corpus import SCHEMA, documents, words

ROWS = documents()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def chunk_texts(text):
    c = op5_chunks.chunked(pa.array([text]))
    return [c.joined[a:b].decode() for a, b in zip(c.place, c.stop)]


def brute_force(texts, least, within):
    """Which chunks of each text lie in a window (the fewest chunks from one on that have ``least`` words) that stands earlier."""
    first, hit = {}, {}
    for i, text in enumerate(texts):
        parts = chunk_texts(text) if text else []
        for k in range(len(parts)):
            for e in range(k, len(parts)):
                window = " ".join(parts[k : e + 1])
                if len(window.split()) >= least:
                    kept = first.setdefault(window, (i, k))
                    if kept != (i, k) and (within or kept[0] != i):
                        hit.setdefault(i, set()).update(range(k, e + 1))
                    break
    return hit


@pytest.mark.parametrize("within", [True, False])
def test_passages_by_brute_force(spark, within):
    rng = random.Random(4)
    texts = [" ".join(words(rng, "aa", 90)) for _ in range(30)]
    own = " ".join(words(rng, "bb", 60))
    texts += [t + " " + own + " " + words(rng, "aa", 1)[0] for t in texts[:5]] + [own + " between " + own, None, "", "short", "again " * 400]
    texts += [" ".join(texts[3].split()[20:60] + texts[4].split()[:50])]
    want = brute_force(texts, op5_chunks.MIN_WORDS, within)
    got = {}
    for r in op5_chunks.repeated_passages(frame(spark, texts), within=within).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_chunk, r.last_chunk + 1))
        parts = chunk_texts(texts[r.doc_id])[r.first_chunk : r.last_chunk + 1]
        assert r.n_words == len(" ".join(parts).split()) and set(r.kept_in) <= set(range(r.doc_id + 1))
    assert got == want and {30, 31, 32, 33, 34, 40} <= set(want) and (35 in want)


def test_mosaics_of_short_pieces_are_no_passages(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, "aa", 60)) for _ in range(12)]
    mosaic = " ".join(w for t in texts for w in t.split()[10:21])
    found = op5_chunks.repeated_passages(frame(spark, [*texts, mosaic])).collect()
    assert not found


def test_a_passage_twice_in_one_text(spark):
    rng = random.Random(8)
    passage = words(rng, "aa", 60)
    texts = [" ".join(words(rng, "bb", 30) + passage + words(rng, "bb", 30) + passage + words(rng, "bb", 9))]
    docs = frame(spark, texts)
    found = op5_chunks.repeated_passages(docs)
    (r,) = found.collect()
    assert r.n_words >= 40 and r.kept_in == [0]
    (cut,) = op5_chunks.cut_passages(docs, found).collect()
    kept = cut.text.split()
    assert sum(kept[i : i + 60] == passage for i in range(len(kept))) == 1 and len(kept) <= 189 - 40
    assert not op5_chunks.repeated_passages(docs, within=False).collect()


def test_chunks_survive_insertions():
    text = " ".join(ROWS[10][1].split() * 1 + ROWS[11][1].split() + ROWS[13][1].split())
    a, b = chunk_texts(text), chunk_texts("new words stand here " + text)
    assert len(set(a) & set(b)) >= len(a) - 3
    c = op5_chunks.chunked(pa.array(["", text, None, "z" * 3000]))
    assert set(c.row) == {1, 3} and (c.upto - c.before)[c.row == 1].sum() == len(text.split()) and (c.row == 3).sum() > 1
    assert c.begin[c.row == 1][0] == 0 and c.end[c.row == 1][-1] == len(text.encode())


def test_a_text_of_many_slices(spark):
    """One text of over 8 MB, cut where it repeats a passage of another one."""
    rng = random.Random(2)
    passage = " ".join(words(rng, "aa", 55))
    long = " ".join(f"w{i}x{rng.random():.9f}" for i in range(500_000))
    assert len(long) > 8 << 20
    docs = frame(spark, [passage, long[: 5 << 20] + " end " + passage + " " + long[5 << 20 :]])
    found = op5_chunks.repeated_passages(docs)
    (r,) = found.collect()
    assert r.doc_id == 1 and r.kept_in == [0] and r.n_words >= 35
    cut = {x.doc_id: x.text for x in op5_chunks.cut_passages(docs, found).collect()}
    assert cut[0] == passage and 40 * 4 < len(long) + len(passage) + 6 - len(cut[1]) <= len(passage)
