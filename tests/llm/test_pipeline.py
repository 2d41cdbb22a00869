import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from isolates.llm import op1_toxicity, op5_chunks
from isolates.session import shared_dir
from tests.llm.corpus import SCHEMA, documents
from tests.llm.test_operators import SPACE_WORDS, components, labelled, lower
from tests.llm.test_passages import brute_force, chunk_texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_pipeline(docs, labels, bench):
    """What is left of {doc_id: text} after each stage, by loops over all texts and pairs."""
    learn = sorted((i, docs[i]) for i in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    model = op1_toxicity.fit([t for _, t in learn], np.array([labels[i] for i, _ in learn]))
    kept = {i: t for i, t in docs.items() if model.score(pa.array([t], pa.string()))[0] < op1_toxicity.LIMIT}
    stages = [kept]

    sets = {}
    for i, t in kept.items():
        w = SPACE_WORDS.findall(lower(t))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    classes = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    stages.append(kept)

    ids = sorted(kept)
    hit = brute_force([kept[i] for i in ids], op5_chunks.MIN_WORDS, True)
    cut = {}
    for n, i in enumerate(ids):
        text = kept[i]
        if n in hit:
            text = " ".join(x for k, x in enumerate(chunk_texts(text)) if k not in hit[n])
        if n not in hit or text:
            cut[i] = text
    stages.append(cut)

    windows = set()
    for t in bench:
        w = WORD.findall(lower(t).encode())
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1 if w else 0)}
    clean = {}
    for i, t in cut.items():
        w = WORD.findall(lower(t).encode())
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            clean[i] = t
    return [*stages, clean]


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    rows = [tuple(r) for r in docs.collect()] + [(i + 1000, *rest) for i, *rest in documents()]
    held = {r[0]: r[1] for r in rows}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    bench = [" ".join(held[1002].split()[:12]), "one", " ".join(held[50].split()[20:34])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_pipeline(held, truth, bench)

    found = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        found = corpus_pipeline.materialise(stage(spark, found, str(tmp_path)), name)
        got = {r.doc_id: r.text for r in found.collect()}
        words = lambda x: {i: (t or "").split() for i, t in x.items()}
        assert words(got) == words(expected), name
        assert found.columns == docs.columns

    before = folders(spark)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    packed.collect()
    # the result of the last stage but one, and what packing still reads
    assert {name.rsplit("-", 1)[0] for name in folders(spark) - before} <= {"decontamination", "pieces"}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, at = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(got)
    for i, t in got.items():
        ids, end = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == end and zlib.crc32(ids[end : end + r.length].tobytes()) == r.ids_crc32
            end += r.length
        assert end == len(ids)
    for parts in at.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
