"""Exact top-k search by BM25: an inverted index in shards, with block-max WAND a block at a time.

Each task builds shards from the texts it reads, so indexing does not shuffle. A shard orders its texts by content
(groups of texts with like words, then length) and cuts each group into blocks of ``BLOCK``; it keeps each text's words and
counts. Weights leave out a word's rarity, which needs the whole corpus and is put in at query time.

For a query, each block gets the most that one of its texts could score: the sum of the block maxima of the query's
words that are frequent in the group, by one matrix product for many queries, and the most that its texts get from the
other words, from their postings. The best blocks are scored first; the k-th best score so far is the floor, and blocks
whose bound lies below it are skipped, texts and all. Bounds and first scores are in single precision with room for its
error, whatever could be among the best is scored again in double precision. What is left of all shards is merged.
Queries of one text are searched once. They are taken in parts that are broadcast, whose bytes are bounded; documents
are never paired with queries outside the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.llm.text import ALNUM, LOWER_TABLE, flat, slices, spaced, spans, spread
from isolates.session import materialise, read_table

K1, B = 1.2, 0.75
#: Texts in a block, and groups of texts with like words in a shard.
BLOCK, GROUPS = 64, 16
#: Words that tell groups apart at most, and texts that groups start from.
TELLING, STARTS = 384, 256
#: A word is frequent in a group if it is in more than this share of its texts, and so many words are at most.
FREQUENT, COLUMNS = 0.025, 1024
#: Texts and bytes of text that a shard holds at most.
SHARD_ROWS, SHARD_BYTES = 16_384, 48 << 20
#: Queries, and bytes of their texts, that are broadcast at once.
QUERY_ROWS, QUERY_BYTES = 8192, 16 << 20
#: Queries in one matrix product, and blocks of a query that are scored before its floor is raised.
TOGETHER, WAVES = 256, (2, 8, 32, 1 << 40)
#: Room for the error of single precision, as a share of a score.
ROOM = 1e-4
INDEX = "shard string, ids binary, lengths binary, groups binary, alike binary, words array<string>, starts binary, numbers binary, counts binary"


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Sorted (text, word) pairs with their counts, the words they number, and the number of words of each text."""
    data, offsets = flat(column)
    data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), np.uint8)
    starts, ends, first = spans(data, offsets, ALNUM)
    joined, s, e = spaced(data, starts, ends)
    n = len(s)
    # one Arrow string for each word: its bytes with the space after it, which is cut off in the dictionary
    edges = np.append(s, len(joined)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(edges), pa.py_buffer(joined)).dictionary_encode()
    code = words.indices.to_numpy()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = max(1, len(words.dictionary))
    pair, count = np.unique(text * size + code, return_counts=True)
    return pair // size, pair % size, count, pc.utf8_rtrim(words.dictionary, " "), np.diff(first)


def content_groups(text: np.ndarray, word: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """The group of each of ``n`` texts, from the frequent words they have: some rounds of means on the sphere."""
    df = np.bincount(word, minlength=kinds)
    telling = np.argsort(-df, kind="stable")[:TELLING]
    telling = telling[df[telling] < 0.9 * n]
    column = np.full(kinds, -1)
    column[telling] = np.arange(len(telling))
    x = np.zeros((n, len(telling)), np.float32)
    on = column[word] >= 0
    x[text[on], column[word[on]]] = 1
    x *= np.sqrt(np.log(n / df[telling])).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    some = x[np.linspace(0, n - 1, min(n, STARTS)).astype(np.int64)]
    centre = some[:1]
    for _ in range(min(GROUPS, n) - 1):
        centre = np.vstack([centre, some[np.argmin((some @ centre.T).max(axis=1))]])
    for _ in range(4):
        mine = (x @ centre.T).argmax(axis=1)
        for g in range(len(centre)):
            if (mine == g).any():
                centre[g] = x[mine == g].mean(axis=0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
    return (x @ centre.T).argmax(axis=1)


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of an index over ``docs``, one row each, its texts ordered by group and length."""

    def shard(name: str, ids: list, lengths: list, parts: list) -> pa.RecordBatch:
        dictionary, codes, base = pa.chunked_array([p[3] for p in parts]).combine_chunks().dictionary_encode(), [], 0
        codes_of = dictionary.indices.to_numpy()
        text, word, count, at = [], [], [], 0
        for p, n in zip(parts, map(len, ids)):
            text.append(p[0] + base)
            word.append(codes_of[at : at + len(p[3])][p[1]])
            count.append(p[2])
            base, at = base + n, at + len(p[3])
        text, word, count = map(np.concatenate, (text, word, count))
        ids, lengths = np.concatenate(ids).astype(np.int64), np.concatenate(lengths).astype(np.int32)
        group = content_groups(text, word, len(ids), len(dictionary.dictionary))
        with np.errstate(over="ignore"):  # texts with the same words as often have one sum
            mixed = (word.astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            first = np.searchsorted(text, np.arange(len(ids) + 1))
            sums = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
            alike = sums[first[1:]] - sums[first[:-1]]
        placed = np.lexsort((ids, alike, lengths, group))
        rank = np.empty(len(ids), np.int64)
        rank[placed] = np.arange(len(ids))
        text = rank[text]
        order = np.lexsort((word, text))
        starts = np.searchsorted(text[order], np.arange(len(ids) + 1))
        row = {
            "shard": [name],
            "ids": [ids[placed].tobytes()],
            "lengths": [lengths[placed].tobytes()],
            "groups": [np.append(0, np.cumsum(np.bincount(group))).astype(np.int32).tobytes()],
            "alike": [alike[placed].tobytes()],
            "words": pa.array([dictionary.dictionary.cast(pa.string())], pa.list_(pa.string())),
            "starts": [starts.astype(np.int32).tobytes()],
            "numbers": [word[order].astype(np.int32).tobytes()],
            "counts": [count[order].astype(np.uint16 if count.max(initial=0) < 1 << 16 else np.uint32).tobytes()],
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, parts, held = [], [], [], 0
        for batch in slices(batches):
            while batch.num_rows:
                head = batch.slice(0, SHARD_ROWS - sum(map(len, ids)))
                batch = batch.slice(head.num_rows)
                *part, n = word_counts(head.column("text"))
                ids.append(head.column("doc_id").to_numpy())
                lengths.append(n)
                parts.append(part)
                held += head.column("text").nbytes
                if sum(map(len, ids)) >= SHARD_ROWS or held > SHARD_BYTES:
                    yield shard(str(ids[0][0]), ids, lengths, parts)
                    ids, lengths, parts, held = [], [], [], 0
        if ids:
            yield shard(str(ids[0][0]), ids, lengths, parts)

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, INDEX)


def _weights(counts: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / mean))


class Group:
    """Neighbouring texts of a shard with like words: a dense table of the frequent ones, postings of the others."""

    def __init__(self, first: int, text: np.ndarray, word: np.ndarray, weight: np.ndarray, rows: int, kinds: int):
        self.first, self.rows, self.blocks = first, rows, -(-rows // BLOCK)
        df = np.bincount(word, minlength=kinds)
        often = np.flatnonzero(df > max(8, FREQUENT * rows))
        often = often[np.argsort(-df[often], kind="stable")[:COLUMNS]]
        self.column = np.full(kinds, -1, np.int32)
        self.column[often] = np.arange(len(often))
        here = self.column[word]
        on = here >= 0
        self.dense = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        self.dense[text[on], here[on]] = weight[on]
        self.most = self.dense.reshape(self.blocks, BLOCK, -1).max(axis=1)
        on = np.flatnonzero(~on)
        on = on[np.argsort(word[on], kind="stable")]
        self.text, self.weight = text[on].astype(np.int32), weight[on].astype(np.float32)
        self.posting = np.append(0, np.cumsum(np.bincount(word[on], minlength=kinds))).astype(np.int32)


class Shard:
    """A shard of the index, opened for queries; counts the texts that it scores."""

    def __init__(self, row: dict, mean: float):
        self.ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int32)
        self.alike = np.frombuffer(row["alike"], np.uint64)
        self.starts, self.word = np.frombuffer(row["starts"], np.int32).astype(np.int64), np.frombuffer(row["numbers"], np.int32)
        counts = np.frombuffer(row["counts"], np.uint16 if len(row["counts"]) * 2 == len(row["numbers"]) else np.uint32)
        text = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        self.weight = _weights(counts.astype(np.float64), lengths[text].astype(np.float64), mean)
        self.words = row["words"]
        edges, self.groups, self.scored = np.frombuffer(row["groups"], np.int32), [], 0
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if b > a:
                s = slice(self.starts[a], self.starts[b])
                self.groups.append(Group(a, text[s] - a, self.word[s], self.weight[s], b - a, len(self.words)))

    def candidates(self, of: np.ndarray, terms: np.ndarray, factor: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, text) of all that may be among a query's k best here: ``n`` queries, term ``terms[i]`` of query ``of[i]``."""
        tables = []
        for g in self.groups:
            column = g.column[terms]
            on = column >= 0
            factors = np.zeros((n, g.most.shape[1]), np.float32)
            factors[of[on], column[on]] = factor[on]
            # what the other words give each text
            rare = np.flatnonzero(~on)
            size = g.posting[terms[rare] + 1] - g.posting[terms[rare]]
            at = np.repeat(g.posting[terms[rare]] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
            width = g.blocks * BLOCK
            rest = np.bincount(np.repeat(of[rare], size) * width + g.text[at], np.repeat(factor[rare], size) * g.weight[at], n * width)
            rest = rest.astype(np.float32).reshape(n, g.blocks, BLOCK)
            tables.append((factors, rest, factors @ g.most.T + rest.max(axis=2)))
        bound = np.hstack([t[2] for t in tables]) * np.float32(1 + ROOM)
        of_group = np.repeat(np.arange(len(tables)), [g.blocks for g in self.groups])
        in_group = np.concatenate([np.arange(g.blocks) for g in self.groups])
        # blocks in order of their bounds, in waves; the floor rises after each
        best, floor = np.full((n, k), -1, np.float32), np.zeros(n, np.float32)
        order = np.argsort(-bound, axis=1)
        found, begin = [], 0
        for wave in WAVES:
            chosen = order[:, begin : begin + wave]
            begin += wave
            query = np.repeat(np.arange(n), chosen.shape[1])
            block = chosen.ravel()
            top = bound[query, block]
            go = np.flatnonzero((top > 0) & (top >= floor[query]))
            query, block = query[go], block[go]
            by_block = np.argsort(block, kind="stable")
            query, block = query[by_block], block[by_block]
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            met_query, met_score = [], []
            for a, z in zip(cut, np.append(cut[1:], len(block)).astype(np.int64)):
                g, i = of_group[block[a]], in_group[block[a]]
                q = query[a:z]
                factors, rest, _ = tables[g]
                score = factors[q] @ self.groups[g].dense[i * BLOCK : (i + 1) * BLOCK].T + rest[q, i]
                self.scored += len(q) * min(BLOCK, self.groups[g].rows - i * BLOCK)
                r, c = np.nonzero((score >= floor[q, None] * np.float32(1 - ROOM)) & (score > 0))
                found.append((q[r], self.groups[g].first + i * BLOCK + c, score[r, c]))
                met_query.append(q[r])
                met_score.append(score[r, c])
            if not met_query:
                continue
            # the k best so far of each query
            q, x = np.concatenate([*met_query, np.repeat(np.arange(n), k)]), np.concatenate([*met_score, best.ravel()])
            o = np.lexsort((-x, q))
            q, x = q[o], x[o]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            best = x[place < k].reshape(n, k)
            floor = np.maximum(best[:, -1], 0)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, text, score = map(np.concatenate, zip(*found))
        on = score >= floor[query] * (1 - ROOM)
        query, text = query[on], text[on]
        # of texts with the same words as often, those with the k lowest ids are enough
        o = np.lexsort((self.ids[text], self.alike[text], query))
        query, text = query[o], text[o]
        new = np.append(True, (query[1:] != query[:-1]) | (self.alike[text[1:]] != self.alike[text[:-1]])) if len(query) else np.zeros(0, bool)
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        return query[place < k], text[place < k]

    def best(self, queries: list[tuple[int, np.ndarray, np.ndarray]], words: pa.Array, rarity: np.ndarray, k: int):
        """(query, doc_id, score) of the k best texts for each query (id, numbers of its words among ``words``, how often it has each)."""
        own = pc.fill_null(pc.index_in(words, pa.array(self.words, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at_query = np.zeros(len(self.words))
        for a in range(0, len(queries), TOGETHER):
            part = queries[a : a + TOGETHER]
            of = np.repeat(np.arange(len(part)), [len(t) for _, t, _ in part])
            terms = np.concatenate([t for _, t, _ in part])
            factor = rarity[terms] * np.concatenate([n for _, _, n in part])
            here = own[terms]
            of, factor, here = of[here >= 0], factor[here >= 0], here[here >= 0]
            query, text = self.candidates(of, here, factor, len(part), k)
            edge, term_edge = np.searchsorted(query, np.arange(len(part) + 1)), np.searchsorted(of, np.arange(len(part) + 1))
            for j in np.flatnonzero(np.diff(edge)):
                rows, s = text[edge[j] : edge[j + 1]], slice(term_edge[j], term_edge[j + 1])
                at_query[here[s]] = factor[s]
                size = self.starts[rows + 1] - self.starts[rows]
                p = np.repeat(self.starts[rows] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
                score = np.add.reduceat(at_query[self.word[p]] * self.weight[p], np.append(0, np.cumsum(size))[:-1])
                at_query[here[s]] = 0
                best = np.lexsort((self.ids[rows], -np.round(score, 9)))[:k]
                yield np.full(len(best), part[j][0]), self.ids[rows[best]], score[best]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of ``queries`` (query_id, text) its k best rows of ``docs``.

    Words are letters, digits and non-ASCII characters, in lower case. Score: the sum over a query's words, as often as it has them, of
    ``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean words))``, rounded to 9
    places; texts that share no word do not count, ties go to the lower doc_id. N and the mean take in null and empty
    texts, which have no words. Rows with a null id are left out. Repeated document rows are ranked each; of rows
    with one query_id the first by text stays, and one that has no text finds nothing. Empty tables give no rows.
    """
    spark = docs.sparkSession
    index = materialise(build_index(spread(docs.select("doc_id", "text"))), "index")

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("lengths").to_pylist():
                n = np.frombuffer(x, np.int32)
                yield pa.RecordBatch.from_pydict({"n": [len(n)], "words": [int(n.sum())]})

    total = index.select("lengths").mapInArrow(measures, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    asked = queries.filter("query_id is not null").groupBy("query_id").agg(F.min("text").alias("text"))
    asked = materialise(asked.withColumn("digest", F.sha2("text", 256)), "queries")
    # queries of one text are searched once, under the lowest of their ids
    texts = asked.groupBy("digest").agg(F.min("query_id").alias("searched"), F.min("text").alias("text"))
    texts = materialise(texts.filter("text is not null"), "query_texts")
    held = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-held["n"] // QUERY_ROWS), -(-(held["bytes"] or 0) // QUERY_BYTES))
    found = []
    for i in range(parts if total["n"] and total["words"] else 0):
        part = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(parts)) == i)
        table = part.select("searched", "text").orderBy("searched").toArrow()  # about QUERY_BYTES of text
        if table.num_rows:
            best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
            one = _search(index, table, total["n"], total["words"] / total["n"], k)
            ranked = one.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(best))
            found.append(materialise(ranked.filter(F.col("rank") <= k), "best"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    searched = asked.select("query_id", "digest").join(texts.select("digest", "searched"), "digest")
    return searched.join(out.withColumnRenamed("query_id", "searched"), "searched").select("query_id", "rank", "doc_id", "score")


def _search(index: DataFrame, table: pa.Table, n: int, mean: float, k: int) -> DataFrame:
    """The k best of every shard for one part of the queries (searched, text)."""
    context = index.sparkSession.sparkContext
    text, word, count, words, _ = word_counts(table.column("text").combine_chunks())
    words = words.cast(pa.string())
    edge = np.searchsorted(text, np.arange(table.num_rows + 1))
    ids = table.column("searched").to_pylist()
    queries = [(ids[i], word[a:b].astype(np.int32), count[a:b].astype(np.int32)) for i, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
    asked = context.broadcast(words)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = pc.index_in(batch.column("words")[i].values, asked.value)
                word = np.frombuffer(batch.column("numbers")[i].as_py(), np.int32)
                ok = at.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pc.drop_null(at), pa.array(np.bincount(word, minlength=len(ok))[ok])], ["word", "df"])

    df = np.zeros(len(words))
    found = index.select("words", "numbers").mapInArrow(frequencies, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    df[found.column("word").to_numpy()] = found.column("df").to_numpy()
    rarity = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = context.broadcast((queries, words, rarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, words, rarity = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "lengths", "groups", "alike", "starts", "numbers", "counts")}
                got = list(Shard(row | {"words": batch.column("words")[i].values}, mean).best(queries, words, rarity, k))
                if got:
                    q, d, s = map(np.concatenate, zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(s)], ["query_id", "doc_id", "score"])

    return index.mapInArrow(run, "query_id long, doc_id long, score double")


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all documents whose id is divisible by 100, against all documents; a text finds itself too."""
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, queries).withColumn("score", F.round("score", 6))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, word, COUNT(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT word, COUNT(*) AS df FROM tf GROUP BY word),
len AS (SELECT doc_id, SUM(tf) AS words FROM tf GROUP BY doc_id),
n AS (SELECT (SELECT COUNT(*) FROM documents WHERE doc_id IS NOT NULL) AS n,
             (SELECT SUM(words) FROM len) / (SELECT COUNT(*) FROM documents WHERE doc_id IS NOT NULL) AS mean),
scored AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         ROUND(SUM(q.tf * LN(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len.words / n.mean))), 9) AS score
  FROM tf q JOIN tf t USING (word) JOIN df USING (word) JOIN len ON len.doc_id = t.doc_id CROSS JOIN n
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, doc_id, ROUND(score, 6) AS score FROM ranked WHERE rank <= 10
"""
