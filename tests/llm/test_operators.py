import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from isolates.llm import near_texts, op1_toxicity, op2_wumanber, op3_sharding, op4_langid, op5_chunks, op6_packing, op7_quality, op8_bm25, op9_maxent, op10_simhash
from tests.llm.corpus import ODD, SCHEMA, documents

ROWS = documents()
SPACE_WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def fingerprint(text):
    w = SPACE_WORDS.findall(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile,shared", [(4096, None), (4, 1), (3, 2)])
def test_simhash_classes(docs, tile, shared):
    want = {i: fingerprint(t) for i, t, *_ in ROWS}
    classes = components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    got = op10_simhash.near_duplicates(docs, tile=tile, shared=shared).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.fingerprint == f"{want[r.doc_id]:016x}" and r.component_id == classes[r.doc_id]


@pytest.mark.parametrize("tile,set_tile", [(16384, 512), (5, 3)])
def test_near_texts(docs, monkeypatch, tile, set_tile):
    monkeypatch.setattr(near_texts, "TILE", tile)
    monkeypatch.setattr(near_texts, "SET_TILE", set_tile)
    sets = {}
    for i, t, *_ in ROWS:
        w = SPACE_WORDS.findall(lower(t))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    classes = components(list(sets), near)
    got = {r.doc_id: r.kept_id for r in near_texts.near_duplicate_classes(docs).collect()}
    assert got == classes
    kept = near_texts.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(classes.values())


def test_contamination(spark, docs):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(lower(t).encode())
    items = [(0, " ".join(ROWS[2][1].split()[3:20])), (11, "one"), (2, ROWS[4][1]), (3, ""), (4, None), (5, " ".join(ROWS[9][1].upper().split()[:4])), (11, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
    for most in (1 << 20, 40):
        got = {r.doc_id: r for r in op2_wumanber.contamination(docs, bench, max_bytes=most).collect()}
        clean = {r.doc_id for r in op2_wumanber.without_contaminated(docs, bench, max_bytes=most).collect()}
        for i, t, *_ in ROWS:
            w, hit, found = cut(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if x := windows.get(tuple(w[k : k + n])):
                        hit |= set(range(k, k + n))
                        found |= x
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (i in clean) == (not hit)


def test_resharding(docs, spark, tmp_path):
    moved = op3_sharding.reshard(docs, F.when(F.col("doc_id") < 90, 0).otherwise(F.col("doc_id") % 4), 4, 6)
    rows = moved.collect()
    assert len(rows) == len(ROWS)
    by_shard = collections.defaultdict(list)
    text = {i: t for i, t, *_ in ROWS}
    for r in rows:
        by_shard[r.shard].append(r)
        assert r["size"] == len((text[r.doc_id] or "").encode()) + 8
        assert r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(text[r.doc_id].encode()))
    sizes = [sum(r["size"] for r in x) for x in by_shard.values()]
    assert len(by_shard) == 6 and max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    for x in by_shard.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    layout = docs.withColumn("shard", F.when(F.col("doc_id") < 90, 0).otherwise(F.col("doc_id") % 4))
    out = str(tmp_path / "out")
    changed = op3_sharding.rewrite(layout, moved, out)
    written = spark.read.parquet(out)
    assert written.count() == sum(len(by_shard[s]) for s in changed)


def test_flow_moves_least():
    sizes, room = [900, 10, 90, 0], [250, 250, 250, 250]
    flow = op3_sharding.transfers(sizes, room)
    for i, s in enumerate(sizes):
        assert sum(f for (a, _), f in flow.items() if a == i) == s
    for j, c in enumerate(room):
        assert sum(f for (_, b), f in flow.items() if b == j) <= c
    assert sum(f for (a, b), f in flow.items() if a != b) == 650


def test_language(docs):
    got = op4_langid.languages(docs, F.col("doc_id") % 3 != 1).collect()
    known = {i: (t, lang) for i, t, lang, *_ in ROWS}
    right = [r.lang_pred == known[r.doc_id][1] for r in got if r.doc_id < 120 and r.doc_id % 3 == 1]
    assert len(got) == len(ROWS) and sum(right) >= 0.95 * len(right)
    for r in got:
        if not re.search(r"[^\W\d_]", known[r.doc_id][0] or ""):
            assert r.lang_pred == "und" and r.score == 0
        assert 0 <= r.score <= 1


def test_bloom_masks():
    keys = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.full(2000, 9)
    f = op4_langid.fill(["x", "y"], [("x", keys[:2000], ones), ("y", keys[1000:3000], ones)])
    mask = f.table[0][op4_langid.places(keys, 0, f.bits)] & f.table[0][op4_langid.places(keys, 1, f.bits)]
    assert (mask[:2000] & 1).all() and (mask[1000:3000] & 2).all() and (mask[:900] & 2).mean() < 0.02 + f.chance[1] * 2


def test_more_languages_than_a_word_of_a_mask(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, words = [], {}
    for k in range(70):
        words[k] = ["".join(rng.choice(letters, 6)) for _ in range(12)]
        rows += [(k * 10 + i, " ".join(rng.choice(words[k], 20)), f"l{k:02d}", "s", 0) for i in range(10)]
    got = op4_langid.languages(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 10 != 1).collect()
    held = [r for r in got if r.doc_id % 10 == 1]
    assert len(held) == 70 and sum(r.lang_pred == f"l{r.doc_id // 10:02d}" for r in held) >= 68


def test_tables_grow_with_the_n_grams():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500_000).astype(np.uint64)
    f = op4_langid.fill(["x"], [("x", keys, np.full(len(keys), 9))])
    assert f.bits > op4_langid.LEAST_BITS and f.chance[0] < 0.1


def test_passages(docs):
    found = op5_chunks.repeated_passages(docs).collect()
    shared = [i for i in range(120) if i % 10 == 4]
    caught = {r.doc_id for r in found}
    assert set(shared[1:]) <= caught and shared[0] not in caught
    assert {120, 121} & caught
    clean = {i for i in range(120) if i % 10 != 4 and i % 12 not in (2, 5)} - {7}
    assert not clean & caught
    for r in found:
        assert r.n_words >= op5_chunks.MIN_WORDS and all(k <= r.doc_id for k in r.kept_in)


def test_cut_passages(docs):
    cut = op5_chunks.cut_passages(docs, op5_chunks.repeated_passages(docs))
    assert cut.columns == docs.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    before = {i: t for i, t, *_ in ROWS}
    assert len(got) == len(ROWS) and got[0] == before[0] and got[122] is None and got[123] == ""
    passage = " ".join(before[4].split()[6:])
    windows = lambda t: {tuple(t.split()[k : k + 50]) for k in range(len(t.split()) - 49)}
    both = [i for i, t in got.items() if t and windows(t) & windows(passage)]
    assert len(both) <= 1
    assert got[121] == ""


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, *_ in ROWS}
    for size in (2048, 64):
        pieces, at = collections.defaultdict(list), collections.defaultdict(list)
        for r in op6_packing.pack_documents(docs, size=size).collect():
            assert r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length <= size
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            pieces[r.doc_id].append((r.start, r.length))
            at[r.sequence_id].append((r.offset, r.length))
        for held, full in ((pieces, {i: len(x) for i, x in ids.items()}), (at, None)):
            for key, parts in held.items():
                end = 0
                for a, n in sorted(parts):
                    assert a == end
                    end += n
                assert end == full[key] if full else end <= size
        used = sum(map(len, ids.values()))
        assert len(at) * size < 1.1 * used + size


def test_bm25(docs, spark):
    queries = spark.createDataFrame([(i, ROWS[i][1]) for i in (0, 7, 20)] + [(500, None), (501, "nosuchword"), (502, "one one")], "query_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tf = {i: collections.Counter(word.findall(lower(t))) for i, t, *_ in ROWS}
    df = collections.Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    for k in (3, 500):
        got = collections.defaultdict(list)
        for r in op8_bm25.top_k(docs, queries, k).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_id, r.score))
        for q, text in [(0, ROWS[0][1]), (7, ROWS[7][1]), (20, ROWS[20][1]), (502, "one one"), (501, "x")]:
            asked = collections.Counter(word.findall(lower(text))) if q != 501 else {}
            score = {}
            for i, c in tf.items():
                s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in asked.items() if c[w])
                if s > 0:
                    score[i] = round(s, 9)
            want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [i for i, _ in want] == [i for i, _ in got[q]]
            assert np.allclose([s for _, s in want], [s for _, s in got[q]], atol=1e-6)


def test_language_model(docs):
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    rows = op9_maxent.scores(docs, learn).collect()
    tokens = {i: SPACE_WORDS.findall(lower(t)) + ["\n"] for i, t, *_ in ROWS}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, kinds = sum(count.values()), len(count)
    assert len(rows) == len(ROWS)
    for r in rows:
        ws = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def labelled(spark, n=600):
    rng = np.random.default_rng(2)
    plain, bad = [f"word{i}" for i in range(300)], ["grunk", "snarf", "blat"]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic, poor = int(i % 6 == 0), int(i % 5 == 2)
        if toxic:
            words[3:6] = rng.choice(bad, 3)
        if poor:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "aa", "s", 0))
        labels.append((i, 1 - poor, toxic))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for score, name in ((op1_toxicity.toxicity, "toxic"), (op7_quality.quality, "quality")):
        got = {r.doc_id: r.score for r in score(docs, labels, F.col("doc_id") % 4 != 2).collect()}
        held = [i for i in got if i % 4 == 2]
        right = [(got[i] >= 0.3) == bool(truth[i][name]) for i in held]
        assert len(got) == 600 and sum(right) >= 0.9 * len(right)
    clean = op1_toxicity.without_toxic(docs, labels, F.col("doc_id") % 4 != 2)
    assert clean.columns == docs.columns
    assert sum(truth[r.doc_id]["toxic"] for r in clean.collect()) <= 5


def test_label_model_finds_classes():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.15
    votes = np.stack([np.where(rng.random(4000) < np.where(y, 0.5, 0.01), 1, 0) for _ in range(6)] + [np.where(rng.random(4000) < np.where(y, 0.1, 0.7), -1, 0) for _ in range(3)], axis=1)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]]).astype(np.float32)
    q = op1_toxicity.label_model(votes, 0.15)
    assert ((q > 0.5) == y).mean() > 0.97


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows_and_empty_tables(spark, empty):
    plain = spark.createDataFrame([] if empty else ODD, SCHEMA)
    # names that the operators use for their own columns
    docs = plain.withColumns({c: F.lit("x") for c in ("score", "block", "fp", "n", "k", "hits", "items", "size", "shard", "learn", "t", "component", "component_id", "digest", "old_shard", "hash", "bucket", "rare", "times", "rep")})
    n = 0 if empty else len(ODD)
    labels = spark.createDataFrame([] if empty else [(None, 1, 1), (1, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([] if empty else [(None, "la"), (1, None), (2, "la la")], "item_id long, text string")
    always = F.lit(True)
    assert op1_toxicity.toxicity(docs, labels, always).count() == n
    assert op1_toxicity.without_toxic(docs, labels, always).columns == docs.columns
    assert op2_wumanber.contamination(docs, bench).count() == n
    assert op3_sharding.reshard(docs, F.lit(0), 2, 3).count() == n
    assert op4_langid.languages(docs, always).count() == n
    assert op5_chunks.repeated_passages(docs).count() == 0
    once = sorted({r[:2] for r in ODD}, key=str)  # of rows that repeat id and text one stays
    assert sorted(((r.doc_id, r.text) for r in op5_chunks.cut_passages(docs, op5_chunks.repeated_passages(docs)).collect()), key=str) == ([] if empty else once)
    assert op6_packing.pack_documents(docs).count() == n
    assert op7_quality.quality(docs, labels, always).count() == n
    found = op8_bm25.top_k(docs, docs.select(F.col("doc_id").alias("query_id"), "text"), 2).collect()
    assert [r.doc_id for r in found] == ([] if empty else [3, 3])
    assert op9_maxent.scores(docs, always).count() == n
    assert op10_simhash.near_duplicates(docs).count() == n
    kept = near_texts.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == ([] if empty else [(1, None), (3, "la la la"), (None, "a b c d e f")])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 80)
    extra = spark.createDataFrame([(r[0] + 1000, *r[1:]) for r in ROWS if r[1] is None or len(r[1]) > 10], SCHEMA)
    docs.union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(ROWS[2][1].split()[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids and 1002 not in ids and not ids & {1120, 1121} and 1007 in ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
