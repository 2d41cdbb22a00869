"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

The most frequent words are outputs of their own, all others share an output with the words of the same form (last
letters and shape). Outputs are dealt to classes by rank. The chance of a word is that of its class, given the words
before, times that of its output in the class, given the same, times the word's share of its output. Both softmaxes see
hashed features: the word before, the two before, the one before that alone (a skip), and the outputs of the last two.
All weights lie in one hashed table with a row for each feature, or for each feature and class.

Weights come from distributed gradient updates: each step sums gradients over another part of all training texts, in
tasks that send sums of a fixed size, so every training text is seen once. Words are counted by one shuffle. The
frequent words, in a number that is bounded, are looked up in the tasks; all others are rare, so that the join that
brings their counts to the texts has no hot key. Texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.text import LOWER_TABLE, NOT_SPACE, RollingHash, crc_mod, flat, slices, spaced, spans, spread
from isolates.session import materialise, read_table

END = "\n"
#: Words that tasks look up at most, and the bytes that such a word may have.
HEAD, HEAD_BYTES = 1 << 17, 256
#: Members of a class and classes; outputs that are forms, the rest are words.
WIDTH, FORMS = 32, 256
OUTPUTS = WIDTH * WIDTH
#: Rows of the hashed table, features of a token, gradient steps, and how far a step goes.
ROWS, FEATURES, STEPS, RATE = 1 << 15, 4, 6, 0.5
#: What each word leaves of its count to unseen words of its form.
DISCOUNT = 0.6
#: Bytes of text and tokens handled at once, and rows of the table that are summed together.
SLICE, TOKENS, PART_ROWS = 1 << 20, 1 << 15, 128

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """Words of some texts in order, an end after each text: number in the dictionary, hash if asked for, where texts begin."""

    code: np.ndarray
    words: pa.Array
    hash: np.ndarray | None
    first: np.ndarray


def tokens(column: pa.Array, hashed: bool = False) -> Tokens:
    data, offsets = flat(column)
    data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), np.uint8)
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    joined, s, _ = spaced(data, starts, ends)
    edges = np.append(s, len(joined)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(edges), pa.py_buffer(joined)).dictionary_encode()
    words = pc.utf8_rtrim(coded.dictionary, " ").cast(pa.large_string())
    words = pa.concat_arrays([words, pa.array([END], pa.large_string())])
    code = np.insert(coded.indices.to_numpy(), first[1:], len(words) - 1)
    h = np.insert(RollingHash(data).of(starts, ends), first[1:], np.uint64(1)) if hashed else None
    return Tokens(code, words, h, first + np.arange(len(first)))


def forms(words: pa.Array) -> np.ndarray:
    """The form of each word: its last two letters and its shape (plain, stop, comma, other mark, digits, marks only), hashed."""
    data, offsets = flat(words)
    if not len(data):
        return np.zeros(len(words), np.int32)
    last = data[np.maximum(offsets[1:] - 1, 0)]
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    digits = np.append(0, np.cumsum((data >= 48) & (data <= 57)))
    at = np.maximum.accumulate(np.where(letter, np.arange(len(data)), -1))[np.maximum(offsets[1:] - 1, 0)]
    some = at >= offsets[:-1]
    one = np.where(some, data[np.maximum(at, 0)], 0).astype(np.uint64)
    two = np.where(some & (at > offsets[:-1]), data[np.maximum(at - 1, 0)], 0).astype(np.uint64)
    mark = (last < 48) | (last > 57) & (last < 97) | (last > 122) & (last < 128)
    shape = np.select([digits[offsets[1:]] > digits[offsets[:-1]], ~some, last == ord("."), last == ord(","), mark], [4, 5, 1, 2, 3], 0)
    return (((one + two * np.uint64(256) + shape.astype(np.uint64) * np.uint64(65536) + np.uint64(1)) * _MIX) >> np.uint64(56)).astype(np.int32)


@dataclass
class Words:
    """The frequent words and their counts, which of them are outputs, and counts and kinds of the words of each output."""

    words: pa.Array
    count: np.ndarray
    output: np.ndarray
    form_output: np.ndarray
    n: np.ndarray
    v: np.ndarray
    total: int
    kinds: int

    def of(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the dictionary: its count (-1 if not frequent), its output, and whether it is all of its output."""
        at = pc.fill_null(pc.index_in(t.words, self.words), -1).to_numpy(zero_copy_only=False)
        count = np.where(at >= 0, self.count[at], -1) if len(self.count) else np.full(len(at), -1)
        own = np.where(at >= 0, self.output[at], -1) if len(self.count) else np.full(len(at), -1)
        return count, np.where(own >= 0, own, self.form_output[forms(t.words)]), own >= 0


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, form) of all words of ``docs`` (text); every text has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = tokens(batch.column("text"))
            columns = [t.words.cast(pa.string()), pa.array(np.bincount(t.code, minlength=len(t.words))), pa.array(forms(t.words))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "form"])

    found = docs.select("text").mapInArrow(run, "word string, n long, form int")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.min("form").alias("form"))


def frequent_words(words: DataFrame) -> Words:
    """The words from the lowest count on that leaves ``HEAD`` of them at most, and how the outputs are made up."""
    # counts by steps of a quarter of a power of two: some hundred rows
    level = F.floor(4 * F.log2("n")).cast("int")
    short = F.octet_length("word") <= HEAD_BYTES
    held = words.filter(short).groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    least, room = 1 << 30, HEAD
    for r in held:
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    head = words.filter(short & (level >= least) | (F.col("word") == END)).toArrow()
    head = head.take(np.lexsort((np.array(head.column("word").to_pylist(), object), -head.column("n").to_numpy())))
    count, form = head.column("n").to_numpy(), head.column("form").to_numpy()
    n, v = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    for r in words.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[r["form"]], v[r["form"]] = r["n"], r["v"]
    total, kinds = int(n.sum()), int(v.sum())
    own = np.zeros(len(count), bool)
    own[: OUTPUTS - FORMS] = True
    own |= pc.equal(head.column("word"), END).to_numpy()
    chosen = np.flatnonzero(own)
    if len(chosen) > OUTPUTS - FORMS:  # the end is always an output
        chosen = np.delete(chosen, -2)
    np.subtract.at(n, form[chosen], count[chosen])
    np.subtract.at(v, form[chosen], 1)
    n, v = np.append(n, count[chosen]), np.append(v, np.ones(len(chosen), np.int64))
    rank = np.empty(len(n), np.int64)
    order = np.argsort(-n, kind="stable")
    rank[order] = np.arange(len(n))
    output = np.full(len(count), -1)
    output[chosen] = rank[FORMS:]
    spare = np.zeros(OUTPUTS - len(n), np.int64)
    text = head.column("word").combine_chunks().cast(pa.large_string())
    return Words(text, count, output, rank[:FORMS], np.append(n[order], spare), np.append(v[order], spare), total, kinds)


def features(t: Tokens, output: np.ndarray) -> np.ndarray:
    """A hash for each feature of each token, from what stands before it in its text."""
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))

    def before(x, d, none):
        out = np.full(len(x), none, np.uint64)
        out[d:] = np.where(text[d:] == text[:-d], x[:-d], np.uint64(none))
        return out

    one, two = before(t.hash, 1, 2), before(t.hash, 2, 2)
    kinds = [before(output.astype(np.uint64), d, OUTPUTS) for d in (1, 2)]
    with np.errstate(over="ignore"):
        cells = np.stack([one, two * np.uint64(3) + one * _MIX, two, kinds[0] + kinds[1] * np.uint64(2 * OUTPUTS)])
        cells = (cells + np.arange(1, FEATURES + 1, dtype=np.uint64)[:, None]) * _MIX
        return cells ^ (cells >> np.uint64(31))


def rows_of(cells: np.ndarray, class_: np.ndarray | None = None) -> np.ndarray:
    """The row of the table for each feature, or for each feature in a class."""
    with np.errstate(over="ignore"):
        if class_ is not None:
            cells = cells + (class_.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        return ((cells * _MIX) >> np.uint64(64 - 15)).astype(np.uint16)


@dataclass
class Model:
    """The outputs' logarithmic shares of all words, by class and in their class, and the weights."""

    classes: np.ndarray
    members: np.ndarray
    weights: np.ndarray

    @staticmethod
    def start(n: np.ndarray) -> Model:
        share = (n + 0.5).reshape(WIDTH, WIDTH)
        classes, members = np.log(share.sum(axis=1) / share.sum()), np.log(share / share.sum(axis=1, keepdims=True))
        return Model(classes.astype(np.float32), members.astype(np.float32), np.zeros((ROWS, WIDTH), np.float32))

    def chances(self, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Softmax over a class's members, or the classes, for each token."""
        x = start + self.weights.take(rows[0], axis=0)
        for r in rows[1:]:
            x += self.weights.take(r, axis=0)
        np.exp(x, out=x)  # a weight moves by 2 * RATE a step at most, so this cannot overflow
        x /= (x @ np.ones(WIDTH, np.float32))[:, None]
        return x

    def levels(self, cells: np.ndarray, output: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the classes and for the members of each token's class: rows, what was met, and the chances of all."""
        class_, member = output // WIDTH, output % WIDTH
        rows = rows_of(cells)
        yield rows, class_, self.chances(rows, self.classes)
        rows = rows_of(cells, class_)
        yield rows, member, self.chances(rows, self.members[class_])


def gradient(texts: DataFrame, words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Over all tokens of ``texts``: how often each weight's output was met with its feature, and how often the model expects it."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, expected = np.zeros(ROWS * WIDTH, np.int64), np.zeros((WIDTH, ROWS))
        for batch in slices(batches, limit=SLICE):
            t = tokens(batch.column("text"), hashed=True)
            output = words.value.of(t)[1][t.code]
            cells = features(t, output)
            for a in range(0, len(output), TOKENS):
                for rows, target, p in shared.value.levels(cells[:, a : a + TOKENS], output[a : a + TOKENS]):
                    row = rows.astype(np.int64)
                    np.add.at(met, (row * WIDTH + target).ravel(), 1)
                    for member, x in enumerate(p.T.astype(np.float64)):
                        expected[member] += np.bincount(row.ravel(), np.tile(x, FEATURES), ROWS)
        expected = np.ascontiguousarray(expected.T)
        met, expected = met.reshape(-1, PART_ROWS * WIDTH), expected.reshape(-1, PART_ROWS * WIDTH)
        on = np.flatnonzero(met.any(axis=1))
        columns = [pa.array([x[i].astype(np.float32).tobytes() for i in on], pa.binary()) for x in (met, expected)]
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *columns], ["part", "met", "expected"])

    def add(table: pa.Table) -> pa.Table:
        out = [table.column("part").slice(0, 1)]
        for name in ("met", "expected"):
            total = np.zeros(PART_ROWS * WIDTH)
            for x in table.column(name):
                total += np.frombuffer(x.as_buffer(), np.float32)
            out.append(pa.array([total.astype(np.float32).tobytes()], pa.binary()))
        return pa.table(out, ["part", "met", "expected"])

    # as many tasks as cores, each sends one table of sums; one table in all comes to the driver
    parts = texts.select("text").coalesce(context.defaultParallelism).mapInArrow(run, "part int, met binary, expected binary")
    found = parts.groupBy("part").applyInArrow(add, "part int, met binary, expected binary").toArrow()
    out = np.zeros((2, ROWS // PART_ROWS, PART_ROWS * WIDTH), np.float32)
    for i, name in enumerate(("met", "expected")):
        for part, x in zip(found.column("part").to_pylist(), found.column(name)):
            out[i, part] = np.frombuffer(x.as_buffer(), np.float32)
    shared.destroy()
    return out[0].reshape(ROWS, WIDTH), out[1].reshape(ROWS, WIDTH)


def train(texts: DataFrame, words, n: np.ndarray) -> Model:
    """Weights after ``STEPS`` updates, each from the gradient over another part of all training texts."""
    model = Model.start(n)
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(STEPS))
    for step in range(STEPS):
        met, expected = gradient(texts.filter(part == step), words, model)
        change = RATE * (met - expected) / (0.5 * (met + expected) + 2.0)
        model = Model(model.classes, model.members, model.weights + change.astype(np.float32))
    return model


def scored_texts(docs: DataFrame, words, model) -> DataFrame:
    """For every text what its frequent words add up to, and its other words, each once, with their number and form."""
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<struct<word:string,n:int,form:int>>"
    rare_type = pa.struct([("word", pa.string()), ("n", pa.int32()), ("form", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m, row = words.value, model.value, TaskContext.get().partitionId() << 33
        smooth = known.total + 0.5 * (known.kinds + 1)
        for batch in slices(batches, limit=SLICE):
            t = tokens(batch.column("text"), hashed=m is not None)
            count, output, own = known.of(t)
            base = np.log10((np.maximum(count, 0) + 0.5) / smooth)
            base[count < 0] = 0  # added once the count is known
            mine = np.zeros(len(t.code))
            if m is not None:
                n = known.n[output]
                # the share of an output's words, as far as it is known here
                share = np.where(count >= 0, np.log10(np.maximum(count - DISCOUNT, 0.1)), 0.0) - np.log10(np.maximum(n, 1))
                share[own] = 0
                out = output[t.code]
                cells = features(t, out)
                for a in range(0, len(out), TOKENS):
                    s = slice(a, a + TOKENS)
                    for _, target, p in m.levels(cells[:, s], out[s]):
                        mine[s] += np.log10(np.maximum(p[np.arange(len(p)), target], 1e-30))
                mine += share[t.code]
            length = np.diff(t.first)
            text = np.repeat(np.arange(len(length)), length)
            seldom = np.flatnonzero(count[t.code] < 0)
            pair, times = np.unique(text[seldom] * len(t.words) + t.code[seldom], return_counts=True)
            word = pair % len(t.words)
            form = forms(t.words)
            rare = pa.StructArray.from_arrays([t.words.take(pa.array(word)).cast(pa.string()), pa.array(times.astype(np.int32)), pa.array(form[word])], fields=list(rare_type))
            edges = np.searchsorted(pair // len(t.words), np.arange(len(length) + 1)).astype(np.int32)
            add = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731, B023
            columns = [length, add((count > 0)[t.code].astype(np.int64)), add(base[t.code]), add(mine)]
            rows = pa.array(row + np.arange(batch.num_rows))
            row += batch.num_rows
            names = ["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"]
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), *map(pa.array, columns), pa.ListArray.from_arrays(pa.array(edges), rare)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def scores(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``learn``: the rows that counts and weights come from (a null there learns). Null and empty texts are one end.
    Unseen words of one form are one word, and share what its seen words leave; a model without training texts scores
    as the base. Repeated rows count each and score alike, a null doc_id counts as a text to learn from, ties in
    counts are broken by the word, other columns are ignored. An empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    docs = spread(docs.select("doc_id", "text", F.coalesce(learn, F.lit(True)).alias("learn")))
    texts = docs.filter("learn")
    counts = materialise(count_words(texts), "words")
    known = frequent_words(counts)
    words = context.broadcast(known)
    model = train(texts, words, known.n) if known.total else None
    held = materialise(scored_texts(docs, words, context.broadcast(model)), "scored")
    smooth = known.total + 0.5 * (known.kinds + 1)
    # for each form, what an unseen word of it gets of the form's share
    v = known.v[known.form_output]
    unseen = F.lit(np.log10(np.maximum(DISCOUNT * v, DISCOUNT)).tolist())
    c = F.coalesce("c", F.lit(0))
    share = F.when(c > 0, F.log10(F.greatest(c - DISCOUNT, F.lit(0.1)))).otherwise(F.element_at(unseen, F.col("form") + 1))
    rare = held.select("row", F.inline("rare")).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    rest = rare.groupBy("row").agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / smooth)).alias("_base"),
        F.sum(F.col("n") * share).alias("_model"),
    )
    out = held.drop("rare").join(rest, "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    base = F.col("base") + zero("_base")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("_known")).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base if model is None else F.col("model") + zero("_model")).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the scores counts alone give: every column but the model's, rounded for comparison."""
    found = op9_lm_scoring(spark, sf_dir).drop("score")
    return found.withColumn("base_score", F.round("base_score", 4))


#: crc32 of the id as text, a bit at a time.
CRC = """
xor(list_reduce(flatten(list_transform(range(LEN(CAST(doc_id AS VARCHAR))),
                        lambda i: list_transform(range(8), lambda j: (ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) >> j) & 1))),
                lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295) % 5"""

BASE_ORACLE = (
    r"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS row, doc_id, crc32_mod = 1 AS held_out,
         LIST_APPEND(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w
  FROM (SELECT *, %s AS crc32_mod FROM documents)),
word AS (SELECT row, held_out, UNNEST(w) AS word FROM d),
seen AS (SELECT word, COUNT(*) AS c FROM word WHERE NOT held_out GROUP BY word),
n AS (SELECT SUM(c) AS n, COUNT(*) AS v FROM seen),
score AS (
  SELECT row, COUNT(*) AS n_tokens, COUNT(c) AS n_known, SUM(LOG10((COALESCE(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base
  FROM word LEFT JOIN seen USING (word) CROSS JOIN n GROUP BY row)
SELECT doc_id, held_out, n_tokens, n_known, CAST((SELECT n FROM n) AS BIGINT) AS train_tokens, ROUND(base, 4) AS base_score
FROM d JOIN score USING (row)
"""
    % CRC
)
