"""Ranked lexical search, term at a time for short lists and document at a time for long ones.

Tasks build inverted shards from the texts that they read, so indexing does not shuffle. A shard's texts are in the
order of their ids and cut into windows; a long list knows its greatest impact in each window. For an item, the lists
that are short in a shard are summed at once, term at a time, into accumulators: one list of (text, sum) that has bounds
of its own. It is then one of the lists that are gone through document at a time: windows whose bounds together lie
under the floor (the k-th best score so far) are skipped, texts come from the accumulators and from the lists without
which the floor is out of reach, and the other lists are only looked up for texts that can still pass it.

Items are dealt to blocks of bounded bytes, and each block meets each shard, as rows of one join: the stated queries
against all texts. Document frequencies come from the shards' words, N and L from their totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.llm.op8_bm25 import word_counts
from isolates.llm.text import slices
from isolates.session import materialise, read_table

#: Best texts of an item; texts and bytes of text in a shard at most; bytes of items in a block.
TOP, SHARD_ROWS, SHARD_BYTES, BLOCK_BYTES = 50, 4096, 12 << 20, 4 << 20
#: Bytes of text whose terms are counted at once while a shard is built.
COUNT_BYTES = 1 << 20
#: Texts of a window; windows that are gone through before the floor is raised, at first and later; a list is long from this share of a shard's texts on.
WINDOW, SEED, STEP, LONG_SHARE = 64, 4, 16, 1 / 32
#: Parts in which the shards' best are merged before they meet.
SALT = 64
INDEX = "shard string, n long, terms long, ids binary, known binary, lengths binary, words array<string>, edges binary, texts binary, counts binary"


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of an inverted index over ``docs`` (doc_id, text), one row each; texts without terms are not in it."""

    def shard(name: str, ids: list, lengths: list, parts: list) -> pa.RecordBatch:
        dictionary = pa.chunked_array([p[3] for p in parts]).combine_chunks().dictionary_encode()
        codes, at, base, end = dictionary.indices.to_numpy(), 0, 0, 0
        pairs = sum(len(p[0]) for p in parts)
        text, word, count = (np.empty(pairs, np.int32) for _ in range(3))
        for n in map(len, lengths):
            p = parts.pop(0)  # a part goes once it is copied
            s = slice(end, end + len(p[0]))
            text[s] = p[0] + base
            word[s] = codes[at : at + len(p[3])][p[1]]
            count[s] = p[2]
            base, at, end = base + n, at + len(p[3]), s.stop
        lengths = np.concatenate(lengths)
        ids = pa.chunked_array(ids).combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        some = np.flatnonzero(lengths > 0)
        placed = some[np.lexsort((ids[some], ~known[some]))]
        rank = np.zeros(len(ids), np.int32)
        rank[placed] = np.arange(len(placed), dtype=np.int32)
        text = rank[text]
        order = np.lexsort((text, word))
        row = {
            "shard": [name],
            "n": [len(placed)],
            "terms": [int(lengths.sum())],
            "ids": [ids[placed].tobytes()],
            "known": [known[placed].tobytes()],
            "lengths": [lengths[placed].astype(np.int64).tobytes()],
            "words": pa.array([dictionary.dictionary.cast(pa.string())], pa.list_(pa.string())),
            "edges": [np.append(0, np.cumsum(np.bincount(word, minlength=len(dictionary.dictionary)))).astype(np.int64).tobytes()],
            "texts": [text[order].tobytes()],
            "counts": [count[order].tobytes()],
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, lengths, parts, held = [], [], [], 0
        for batch in slices(batches, limit=COUNT_BYTES):
            while batch.num_rows:
                head = batch.slice(0, SHARD_ROWS - sum(map(len, lengths)))
                batch = batch.slice(head.num_rows)
                text, word, count, words, n = word_counts(head.column("text"))
                ids.append(head.column("doc_id"))
                lengths.append(n)
                parts.append((text.astype(np.int32), word.astype(np.int32), count.astype(np.int32), words))
                held += head.column("text").nbytes
                if sum(map(len, lengths)) >= SHARD_ROWS or held > SHARD_BYTES:
                    yield shard(f"{task}-{made}", ids, lengths, parts)
                    made += 1
                    ids, lengths, parts, held = [], [], [], 0
        if ids:
            yield shard(f"{task}-{made}", ids, lengths, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Long:
    """A long list of a shard: texts in order, impacts, and the greatest impact in each window."""

    def __init__(self, texts: np.ndarray, impact: np.ndarray, windows: int):
        self.texts, self.impact = texts, impact
        self.most = window_maxima(texts, impact, windows)
        self.top = int(impact.max())


def window_maxima(texts: np.ndarray, values: np.ndarray, windows: int) -> np.ndarray:
    out = np.zeros(windows, np.int64)
    if len(texts):
        window = texts // WINDOW
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        out[window[first]] = np.maximum.reduceat(values, first)
    return out


class Shard:
    """A shard opened for some terms; counts the long lists' postings that are read, and those that it has of the items' terms."""

    def __init__(self, row: dict, n: int, length: int, terms: pa.Array):
        self.rows = len(row["lengths"]) // 8
        self.windows = -(-self.rows // WINDOW)
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 100 - 50 + (50 * lengths * n) // length
        edges, texts = np.frombuffer(row["edges"], np.int64), np.frombuffer(row["texts"], np.int32)
        counts = np.frombuffer(row["counts"], np.int32)
        code = pc.fill_null(pc.index_in(terms, row["words"]), -1).to_numpy(zero_copy_only=False)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray] | Long] = {}
        self.read = self.held = 0
        for term in np.flatnonzero(code >= 0).tolist():
            s = slice(edges[code[term]], edges[code[term] + 1])
            tf = counts[s].astype(np.int64)
            here = texts[s]
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[here])
            self.lists[term] = Long(here, impact, self.windows) if len(here) > max(WINDOW, LONG_SHARE * self.rows) else (here, impact)

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, scores) of the k best for one item, best first, equal scores in the order of the texts."""
        short, long = [], []
        for t, w in zip(terms.tolist(), weight.tolist()):
            found = self.lists.get(t)
            if isinstance(found, Long):
                long.append((w * found.top, w, found))
                self.held += len(found.texts)
            elif found is not None:
                short.append((found[0], w * found[1]))
        # term at a time: the accumulators
        summed, sums = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if short:
            texts, part = map(np.concatenate, zip(*short))
            order = np.argsort(texts, kind="stable")
            texts, part = texts[order], part[order]
            first = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
            summed, sums = texts[first], np.add.reduceat(part, first)
        floor = int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0
        floor = max(floor, 1)
        # document at a time, the accumulators as one bounded list among the long ones
        long.sort(key=lambda x: -x[0])
        rest = np.append(np.cumsum([x[0] for x in long][::-1])[::-1], 0).astype(np.int64)  # most from this list on
        bound = window_maxima(summed, sums, self.windows)
        for _, w, x in long:
            bound = bound + w * x.most
        best_text, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.flatnonzero(bound >= floor)
        # the windows with the greatest bounds come first and raise the floor; the others follow in order
        step = left[np.sort(np.argsort(-bound[left], kind="stable")[:SEED])]
        left = np.setdiff1d(left, step, assume_unique=True)
        while len(step):
            low, high = step[0] * WINDOW, (step[-1] + 1) * WINDOW
            on = np.zeros(high - low, bool)
            on[((step * WINDOW - low)[:, None] + np.arange(WINDOW)).ravel()] = True
            score = np.zeros(high - low, np.int64)
            met = np.zeros(high - low, bool)
            a, b = np.searchsorted(summed, (low, high))
            score[summed[a:b] - low] = sums[a:b]
            met[summed[a:b] - low] = True
            # lists without which no text gets to the floor
            needed = int(np.flatnonzero(rest < floor)[0])
            for _, w, x in long[:needed]:
                a, b = np.searchsorted(x.texts, (low, high))
                at = x.texts[a:b] - low
                score[at] += w * x.impact[a:b]
                met[at] = True
                self.read += b - a
            at = np.flatnonzero(met & on & (score + rest[needed] >= floor))
            got = score[at]
            for i, (_, w, x) in enumerate(long[needed:], needed):
                place = np.searchsorted(x.texts, at + low)
                place[place == len(x.texts)] = 0
                has = x.texts[place] == at + low
                got = got + np.where(has, w * x.impact[place], 0)
                self.read += len(at)
                ok = got + rest[i + 1] >= floor
                at, got = at[ok], got[ok]
            if len(at):
                best_text, best_score = np.append(best_text, at + low), np.append(best_score, got)
                order = np.lexsort((best_text, -best_score))[:k]
                best_text, best_score = best_text[order], best_score[order]
                if len(order) == k and best_score[-1] > floor:
                    floor = int(best_score[-1])
                    left = left[bound[left] >= floor]
            step, left = left[:STEP], left[STEP:]
        on = best_score > 0
        return best_text[on], best_score[on]


def _frequencies(pairs: DataFrame) -> DataFrame:
    """(block, term, df): in how many texts each term of a block stands, shard by shard and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms = pc.unique(batch.column("items")[i].values.field("terms").flatten())
                code = pc.index_in(terms, batch.column("words")[i].values)
                has = code.is_valid()
                df = np.diff(np.frombuffer(batch.column("edges")[i].as_py(), np.int64))[pc.drop_null(code).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df), batch.column("block")[i].as_py())), terms.filter(has), pa.array(df)], ["block", "term", "df"])

    found = pairs.select("block", "items", "words", "edges").mapInArrow(run, "block long, term string, df long")
    return found.groupBy("block", "term").agg(F.sum("df").alias("df"))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms, weights and scores are those of the contract of ``op13_ranked_search``. Null and empty texts have no term:
    such a document is not counted and never found, such an item finds nothing. Rows of ``items`` that repeat id and
    text are one item; those with one id and several texts are ranked each. Repeated documents are ranked each; a null
    id comes last among equal scores. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    index = materialise(build_index(docs), "index")
    total = index.agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    n, length = total["n"] or 0, total["terms"] or 0
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", capitals, small), F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)")))
    asked = items.select("item_id", "text").filter("text is not null").distinct().select("item_id", F.octet_length("text").alias("bytes"), terms.alias("terms")).filter("size(terms) > 0")
    asked = materialise(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum("bytes")).first()[0] or 0
    if not n or not size:
        empty = asked.select("item_id").limit(0)
        return empty.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-size // BLOCK_BYTES))))).groupBy("block").agg(F.collect_list(F.struct("q", "terms")).alias("items"))
    blocks = materialise(blocks, "blocks")
    df = _frequencies(blocks.crossJoin(index.select("words", "edges"))).groupBy("block").agg(F.collect_list("term").alias("term"), F.collect_list("df").alias("df"))
    blocks = materialise(blocks.join(df, "block"), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, words = batch.column("items")[i].values, batch.column("term")[i].values
                df = batch.column("df")[i].values.to_numpy().astype(np.float64)
                weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
                row = {c: batch.column(c)[i].as_py() for c in ("lengths", "edges", "texts", "counts")}
                shard = Shard(row | {"words": batch.column("words")[i].values}, n, length, words)
                ids, known = np.frombuffer(batch.column("ids")[i].as_py(), np.int64), np.frombuffer(batch.column("known")[i].as_py(), bool)
                lists = asked.field("terms")
                number = pc.index_in(lists.flatten(), words)
                valid = number.is_valid().to_numpy(zero_copy_only=False)
                number = number.fill_null(0).to_numpy()
                edge = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
                q, doc, ok, score = [], [], [], []
                for j, key in enumerate(asked.field("q").to_pylist()):
                    own = number[edge[j] : edge[j + 1]][valid[edge[j] : edge[j + 1]]]
                    texts, scores = shard.best(own, weight[own], k)
                    q.append(np.full(len(texts), key))
                    doc.append(ids[texts])
                    ok.append(known[texts])
                    score.append(scores)
                q, doc, ok, score = map(np.concatenate, (q, doc, ok, score))
                salt = pa.array(np.full(len(q), int(batch.column("shard")[i].as_py().split("-")[0]) % SALT), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), salt, pa.array(doc, pa.int64(), mask=~ok), pa.array(score, pa.int64())], ["q", "salt", "doc_id", "score"])

    found = blocks.crossJoin(index).mapInArrow(run, "q long, salt int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("rank", F.row_number().over(W.partitionBy("q", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against all documents: its 50 best."""
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, text FROM documents),
term AS (
  SELECT row, doc_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT row, doc_id, term, COUNT(*) AS tf FROM term GROUP BY ALL),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
len AS (SELECT row, CAST(SUM(tf) AS BIGINT) AS n FROM tf GROUP BY row),
t AS (SELECT COUNT(*) AS n, CAST(SUM(n) AS BIGINT) AS l FROM len),
item AS (SELECT ROW_NUMBER() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (
  SELECT DISTINCT q, item_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item),
scored AS (
  SELECT q, item_id, row, doc_id,
         CAST(SUM(CAST(FLOOR(1000 * LN(CAST(2 * t.n + 2 AS DOUBLE) / (2 * df.df + 1))) AS BIGINT)
                  * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * len.n * t.n) // t.l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN len USING (row) CROSS JOIN t GROUP BY ALL),
best AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
"""
