"""Language identification by bit-sliced Bloom filters over byte n-grams.

One table of bit masks, a bit for each language: an n-gram sets its languages' bit at ``HASHES`` places, and the
masks at those places, anded, give all languages whose filter contains it. For each text the bits are counted by
language, what a filter's fill would give by chance is taken off, and the largest share of n-grams decides. An
n-gram enters a language's filter if it makes up enough of that language's sample and is not far commoner elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isolates.llm.text import LOWER_TABLE, crc_mod, flat, slices
from isolates.session import read_table

#: Labelled texts that the filters may be filled from, and their bytes, about.
MAX_FIT_ROWS, MAX_FIT_BYTES = 12_000, 256 << 20
#: Languages in a word of a mask; a mask has as many words as it takes.
WORD = 64
GRAM, HASHES = 4, 2
#: Bits of a table's index: from the least, as many as leave three quarters of a language's places empty, up to the most.
LEAST_BITS, MOST_BITS = 20, 24
#: An n-gram belongs to a language if it is so much of its n-grams, and so much of its largest share in any language.
LEAST_SHARE, LEAST_OF_MOST = 2e-6, 0.2

#: Bytes as n-grams see them: letters and bytes of other scripts; all else is one kind of gap.
_FOLD = np.frombuffer(bytes(range(256)).translate(LOWER_TABLE), np.uint8).copy()
_FOLD[[b for b in range(128) if not 97 <= _FOLD[b] <= 122]] = 32
FOLD_TABLE = _FOLD.tobytes()


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram with one gap at most, and the text that holds it."""
    data, offsets = flat(column)
    raw = data.tobytes().translate(FOLD_TABLE) + bytes(GRAM)
    n = max(0, len(data) - GRAM + 1)
    letter = np.frombuffer(raw, np.uint8) != 32
    enough = sum(letter[i : i + n].astype(np.uint8) for i in range(GRAM)) >= GRAM - 1
    for i in range(1, GRAM):  # none that reaches into the next text
        cut = offsets[1:-1] - i
        enough[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(enough)
    wide = np.ndarray((n,), "<u4", raw, strides=(1,))[at].astype(np.uint64)
    wide *= np.uint64(0x9E3779B97F4A7C15)
    return wide ^ (wide >> np.uint64(31)), np.searchsorted(offsets, at, "right") - 1


def places(h: np.ndarray, i: int, bits: int = LEAST_BITS) -> np.ndarray:
    return ((h * np.uint64(2 * i + 1) >> np.uint64(64 - bits - 7 * i)) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Filters:
    """``table[w]`` has a word of each place's mask: bit k is language ``w * WORD + k``; ``chance`` that a foreign n-gram hits."""

    languages: list[str]
    table: np.ndarray
    chance: np.ndarray
    bits: int

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and its share of the evidence for each text; the first (commonest) language without any."""
        h, text = grams(column)
        at = [places(h, i, self.bits) for i in range(HASHES)]
        n = np.bincount(text, minlength=len(column))
        best, top, total = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        for w, table in enumerate(self.table):
            mask = table[at[0]]
            for x in at[1:]:
                mask = mask & table[x]
            for k in range(w * WORD, min(len(self.languages), (w + 1) * WORD)):
                hits = np.bincount(text, mask >> mask.dtype.type(k - w * WORD) & mask.dtype.type(1), len(column))
                share = np.maximum(0, hits - n * self.chance[k]) / np.maximum(1, n) / (1 - self.chance[k])
                best, top, total = np.where(share > top, k, best), np.maximum(share, top), total + share
        return best, top / np.maximum(total, 1e-12)


def fill(languages: list[str], rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Filters:
    """Filters from (language, n-gram hashes, counts); languages in order of their number of texts."""
    number = {x: i for i, x in enumerate(languages)}
    gram = np.concatenate([k for _, k, _ in rows] or [np.zeros(0, np.uint64)])
    count = np.concatenate([c for _, _, c in rows] or [np.zeros(0)]).astype(np.float64)
    of = np.repeat([number[x] for x, _, _ in rows], [len(k) for _, k, _ in rows]).astype(np.int64)
    share = count / np.maximum(1, np.bincount(of, count, len(languages)))[of]
    keys, at = np.unique(gram, return_inverse=True)
    most = np.zeros(len(keys))
    np.maximum.at(most, at, share)
    member = (count >= 2) & (share >= LEAST_SHARE) & (share >= LEAST_OF_MOST * most[at])
    held = int(np.bincount(of[member], minlength=1).max(initial=1))
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(4 * HASHES * max(1, held))))))
    kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
    table, chance = np.zeros((max(1, -(-len(languages) // WORD)), 1 << bits), kind), np.zeros(len(languages))
    for k in range(len(languages)):
        own, (w, bit) = gram[member & (of == k)], divmod(k, WORD)
        for i in range(HASHES):
            table[w, places(own, i, bits)] |= kind(1 << bit)
        chance[k] = min(0.99, ((table[w] >> kind(bit) & kind(1)).mean()) ** HASHES)
    return Filters(languages, table, chance, bits)


def fit(docs: DataFrame, learn: Column, max_rows: int = MAX_FIT_ROWS) -> Filters | None:
    """Filters from a hash sample of at most about ``max_rows`` texts and ``MAX_FIT_BYTES`` with a language; None if there is none."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").collect()
    total = sum(r["n"] for r in sizes)
    if not total:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30))
    # the same number of texts of each language, as far as there are
    each, bytes_each = max(1, max_rows // len(sizes)), max(1, MAX_FIT_BYTES // len(sizes))
    shares = [(r["lang"], int(min(1, each / r["n"], bytes_each / max(1, r["bytes"])) * (1 << 30))) for r in sizes]
    taken = docs.sparkSession.createDataFrame(shares, "lang string, take long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in slices(batches):
            h, text = grams(batch.column("text"))
            names = batch.column("lang").to_numpy(zero_copy_only=False)
            for name in np.unique(names):
                k, c = np.unique(h[(names == name)[text]], return_counts=True)
                held.setdefault(name, []).append((k, c))
                if len(held[name]) > 8:
                    held[name] = [_merge(held[name])]
        for name, parts in held.items():
            k, c = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    # one row a language
    counted = known.join(F.broadcast(taken), "lang").filter(place < F.col("take")).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    languages = [r["lang"] for r in sizes]
    names, gram, n = (summed.column(c).to_numpy() for c in ("lang", "gram", "n"))
    return fill(languages, [(x, gram[names == x].view(np.uint64), n[names == x]) for x in languages])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(k)).astype(np.int64)


def languages(docs: DataFrame, learn: Column, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``.

    ``und`` with score 0 for null texts and texts without a letter, and for every text if no row can be learned from.
    Null languages are not learned. A text with letters but no known n-gram gets the commonest language with score 0.
    Ties go to the commoner language. Repeated rows are treated alike; other columns are ignored.
    """
    filters = fit(docs, learn, max_rows)
    letters = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if filters is None:
        return letters.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*shared.value.languages, "und"], object)
        for batch in slices(batches):
            best, score = shared.value.predict(batch.column("text"))
            has = batch.column("letters").to_numpy(zero_copy_only=False)
            name = known[np.where(has, best, len(known) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return letters.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = languages(docs, crc_mod("doc_id", 3) != 1)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
