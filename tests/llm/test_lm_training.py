import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isolates.llm import op9_maxent
from isolates.llm.text import RollingHash
from tests.llm.corpus import SCHEMA, documents

ROWS = documents()
WORD = re.compile("[^\x20\x09-\x0d]+")
FULL = (1 << 64) - 1
MIX = 0x9E3779B97F4A7C15


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def word_hash(word):
    if word == "\n":
        return 1
    data = np.frombuffer(word.encode(), np.uint8)
    return int(RollingHash(data).of(np.array([0]), np.array([len(data)]))[0])


def row(cell, class_=None):
    if class_ is not None:
        cell += (class_ + 1) * 0xD1B54A32D192ED03
    return (cell * MIX & FULL) >> 49


def chance(model, cells, start, target, class_=None):
    x = [float(s) + sum(float(model.weights[row(c, class_)][k]) for c in cells) for k, s in enumerate(start)]
    return math.exp(x[target]) / sum(map(math.exp, x))


def plain_score(words, model, count, shown):
    """The model's score of one text, word by word: ``shown`` has the output of each frequent word."""

    def output(w):
        return shown[w] if shown.get(w, -1) >= 0 else int(words.form_output[op9_maxent.forms(pa.array([w], pa.large_string()))[0]])

    total, before = 0.0, []
    for w in tokens(shown["text"]):
        h = [word_hash(x) for x in before[::-1]] + [2, 2]
        o = [output(x) for x in before[::-1]] + [op9_maxent.OUTPUTS] * 2
        cells = []
        for i, cell in enumerate((h[0], h[1] * 3 + h[0] * MIX, h[1], o[0] + o[1] * 2 * op9_maxent.OUTPUTS)):
            cell = (cell + i + 1) * MIX & FULL
            cells.append(cell ^ cell >> 31)
        k = output(w)
        class_, member = divmod(k, op9_maxent.WIDTH)
        p = chance(model, cells, model.classes, class_) * chance(model, cells, model.members[class_], member, class_)
        if shown.get(w, -1) < 0:
            n, v = max(1, int(words.n[k])), int(words.v[k])
            p *= (count[w] - op9_maxent.DISCOUNT) / n if count[w] else max(op9_maxent.DISCOUNT * v, op9_maxent.DISCOUNT) / n
        total += math.log10(p)
        before.append(w)
    return total


@pytest.mark.parametrize("head", [1 << 17, 40])
def test_model_score_by_brute_force(spark, monkeypatch, head):
    """``head`` of 40: most words are too rare to be looked up and get their counts by the join."""
    seen = {}

    def kept(name):
        plain = getattr(op9_maxent, name)
        monkeypatch.setattr(op9_maxent, name, lambda *a: seen.setdefault(name, plain(*a)))

    kept("frequent_words")
    kept("train")
    monkeypatch.setattr(op9_maxent, "HEAD", head)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = {r.doc_id: r.score for r in op9_maxent.scores(docs, F.col("doc_id") % 5 != 1).collect()}
    words, model = seen["frequent_words"], seen["train"]
    assert len(words.words) <= head + 1
    count = Counter(w for i, t, *_ in ROWS if i % 5 != 1 for w in tokens(t))
    shown = dict(zip(words.words.to_pylist(), words.output.tolist()))
    assert shown["\n"] >= 0 and np.abs(model.weights).max() > 0.1
    for i, t, *_ in ROWS:
        if i % 4 == 1 or i >= 120:
            assert got[i] == pytest.approx(plain_score(words, model, count, shown | {"text": t}), rel=1e-4)


def test_shares_of_an_output_sum_to_one(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    words = op9_maxent.frequent_words(op9_maxent.count_words(docs))
    count = Counter(w for _, t, *_ in ROWS for w in tokens(t))
    own = {w for w, o in zip(words.words.to_pylist(), words.output) if o >= 0}
    seen, kinds = np.zeros(op9_maxent.OUTPUTS), np.zeros(op9_maxent.OUTPUTS)
    for w, c in count.items():
        if w not in own:
            k = words.form_output[op9_maxent.forms(pa.array([w], pa.large_string()))[0]]
            seen[k] += c - op9_maxent.DISCOUNT
            kinds[k] += 1
    on = np.flatnonzero(kinds)
    assert len(own) == op9_maxent.OUTPUTS - op9_maxent.FORMS and len(on)
    assert np.allclose((seen[on] + op9_maxent.DISCOUNT * kinds[on]) / words.n[on], 1) and (words.v[on] == kinds[on]).all()
    assert words.n.sum() == sum(count.values()) and words.kinds == len(count)


def test_chances_sum_to_one():
    model = op9_maxent.Model.start(np.random.default_rng(0).integers(0, 50, op9_maxent.OUTPUTS))
    model.weights[:] = np.random.default_rng(1).standard_normal(model.weights.shape)
    cells = np.random.default_rng(2).integers(0, 1 << 63, (op9_maxent.FEATURES, 7)).astype(np.uint64)
    of_class = model.chances(op9_maxent.rows_of(cells), model.classes)
    total = np.zeros(7)
    for c in range(op9_maxent.WIDTH):
        class_ = np.full(7, c)
        total += of_class[:, c] * model.chances(op9_maxent.rows_of(cells, class_), model.members[class_]).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-5)


def test_every_training_text_trains_once(spark, monkeypatch):
    rows = ROWS + [(None, "null id", None, None, None)] * 9 + [(1 << 50, "far id", None, None, None)]
    parts, plain = [], op9_maxent.gradient
    monkeypatch.setattr(op9_maxent, "gradient", lambda texts, words, model: parts.append(texts.count()) or plain(texts, words, model))
    found = op9_maxent.scores(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect()
    assert len(parts) == op9_maxent.STEPS and sum(parts) == len(rows) == len(found)
    assert all(np.isfinite(r.score) for r in found)
