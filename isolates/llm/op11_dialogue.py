"""Conversation structure repair: weighted interval parsing (CYK) with a repair grammar in Chomsky normal form.

A conversation is legal if its roles read ``(system? (user assistant)+)?``. A nonterminal ``(p, q)`` derives the spans whose
edited roles lead from place ``p`` of that pattern to place ``q``; its binary rules are ``(p, q) -> (p, r) (r, q)``. A span of
one row is kept, given another role or deleted; insertions derive the empty span and are closed over both ends of every
one-row span. A cell holds the least (cost, audit) of each nonterminal. Cells are combined bottom-up by span length over
all splits, within segments of ``SPAN`` rows; whole segments are the one-row spans of the next chart. Since rows have a
cost of their own for each edit, two audits of one span and cost never begin one another, so least cells of the parts
give the least cell of the whole.

Two narrow passes: the parse reads one letter a row, sorted by conversation and turn, and keeps what it needs of one
conversation (a byte a row and state); its audit is then met by the texts, sorted alike, which stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from isolates.llm.text import flat, slices
from isolates.session import materialise, read_table

#: Rows of a segment, and cells of segments in one chart. Spans that are kept for the next conversations at most.
SPAN, KEPT_CELLS = 8, 1 << 14
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Places in the pattern: at the start, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
PAIRS = [(p, q) for p in range(4) for q in range(4) if q >= p or (p, q) == (ASSISTANT, USER)]
NUMBER = {pair: i for i, pair in enumerate(PAIRS)}
#: The binary rules: number of the whole, of its left part and of its right part.
RULES = [(NUMBER[p, q], NUMBER[p, r], NUMBER[r, q]) for p, q in PAIRS for r in range(4) if (p, r) in NUMBER and (r, q) in NUMBER]
#: Where a row of a role leads, from each place that may take it.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\f\r"

Cell = list  # of (cost, audit) or None, by number of the nonterminal


def _better(cell: Cell, i: int, cost: int, audit: str) -> None:
    if cell[i] is None or (cost, audit) < cell[i]:
        cell[i] = (cost, audit)


def joined(parts: Iterator[tuple[Cell, Cell]]) -> Cell:
    """The cell of a span from the cells of its parts, for each split."""
    out: Cell = [None] * len(PAIRS)
    for left, right in parts:
        for i, a, b in RULES:
            x, y = left[a], right[b]
            if x and y:
                cost = x[0] + y[0]
                if out[i] is None or cost < out[i][0]:
                    out[i] = (cost, x[1] + y[1])
                elif cost == out[i][0]:
                    out[i] = min(out[i], (cost, x[1] + y[1]))
    return out


def _empty() -> Cell:
    """The insertion closure: what the empty span costs, by one insertion after the other until nothing gets cheaper."""
    cell: Cell = [None] * len(PAIRS)
    for p in range(4):
        cell[NUMBER[p, p]] = (0, "")
    while True:
        longer = [*cell]
        for p, q in PAIRS:
            for role in "ua":
                r = MOVES[role].get(q)
                if r is not None and cell[NUMBER[p, q]]:
                    cost, audit = cell[NUMBER[p, q]]
                    _better(longer, NUMBER[p, r], cost + INSERT, audit + "I")
        if longer == cell:
            return cell
        cell = longer


EMPTY = _empty()


@lru_cache(maxsize=None)
def row_cell(symbol: str) -> Cell:
    """The cell of a row: b, d: must be deleted; s, u, a: its role; o: any other role; a capital: a truncated text."""
    cell: Cell = [None] * len(PAIRS)
    for p in range(4):
        cell[NUMBER[p, p]] = (DELETE, "D")
    if symbol not in "bd":
        extra = TRUNCATED if symbol.isupper() else 0
        for role, moves in MOVES.items():
            own = role == symbol.lower()
            if own or role != "s":
                for p, q in moves.items():
                    _better(cell, NUMBER[p, q], (KEEP if own else REROLE) + extra, "K" if own else "R")
    return joined(iter([(joined(iter([(EMPTY, cell)])), EMPTY)]))


_cells: dict[str, Cell] = {}


def span_cell(symbols: str) -> Cell:
    """The cell of a segment: all its spans, bottom-up by length. A span's cell depends on its symbols alone and is kept for the next ones."""
    if len(_cells) > KEPT_CELLS:
        _cells.clear()
    for size in range(1, len(symbols) + 1):
        for i in range(len(symbols) - size + 1):
            span = symbols[i : i + size]
            if span not in _cells:
                _cells[span] = row_cell(span) if size == 1 else joined((_cells[span[:k]], _cells[span[k:]]) for k in range(1, size))
    return _cells[symbols]


def chart(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up by how many of them a span takes in."""
    held = {(i, i + 1): c for i, c in enumerate(cells)}
    for size in range(2, len(cells) + 1):
        for i in range(len(cells) - size + 1):
            held[i, i + size] = joined((held[i, k], held[k, i + size]) for k in range(i + 1, i + size))
    return held[0, len(cells)]


def _parse(symbols: str) -> tuple[int, str]:
    cells = [span_cell(symbols[i : i + SPAN]) for i in range(0, len(symbols), SPAN)]
    while len(cells) > 1:
        cells = [chart(cells[i : i + SPAN]) for i in range(0, len(cells), SPAN)]
    return min(c for c in (cells[0][NUMBER[START, START]], cells[0][NUMBER[START, ASSISTANT]]) if c)


_parse_short = lru_cache(maxsize=1 << 14)(_parse)


def parse(symbols: str) -> tuple[int, str]:
    """The least (cost, audit) that makes the rows legal."""
    if not symbols:
        return 0, ""
    return _parse_short(symbols) if len(symbols) <= 64 else _parse(symbols)


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the crc32 of ``conv_id:turn``, nulls in the text columns as one space.

    Of 20 remainders 0 drops the row (it is still here, with ``gone``), 1 empties the text, 2 takes away its sentence
    marks, 3 repeats the row and 4 makes it the user's.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    rows = conversations.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy"))
    return rows.drop("copy")


def as_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations as they are, none of them gone."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", written("role"), written("text"), F.lit(False).alias("gone"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


REPORT = [(c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", "string")]


def _report_schema(rows: DataFrame) -> StructType:
    out = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)])
    for name, kind in REPORT:
        out = out.add(name, kind)
    return out


def conversation_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conv_id of ``rows`` (see :func:`damage`).

    Rows go by turn, nulls first; those of one turn by role, then by their text's digest. A null conv_id is a conversation
    of its own. Conversations whose rows are all gone have zeros and an empty audit. An empty role is none of the three.
    Repeated rows are duplicates of the first; an empty table gives no rows.
    """
    solid = F.rtrim("text", F.lit(SPACE))
    one = rows.select("conv_id", "turn", "role", _digest(), (solid == "").alias("blank"), F.substr(solid, F.lit(-1), F.lit(1)).isin(".", "!", "?").alias("ended"), "gone")
    nth = F.row_number().over(W.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first()))
    initial = F.substr("role", F.lit(1), F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("gone"), "-").when(F.col("blank"), "b").when(F.col("nth") > 1, "d").when(F.col("ended"), initial).otherwise(F.upper(initial))
    letters = one.withColumn("nth", nth).select(
        "conv_id", F.when(~F.col("gone"), F.col("turn").cast("long")).alias("turn"), "role", "digest", "nth", symbol.alias("symbol"), F.when(F.col("gone"), "-").otherwise(initial).alias("initial")
    )
    schema = _report_schema(rows)
    ordered = letters.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "nth").select("conv_id", "turn", "symbol", "initial")

    def report(conv, symbols: str, initials: str, turns: tuple) -> tuple:
        symbols, initials = symbols.replace("-", ""), initials.replace("-", "")
        low, high, distinct = turns
        faults = [symbols.count("b"), symbols.count("d"), sum(symbols.count(c) for c in "SUAO")]
        cost, audit = parse(symbols)
        return conv, high - low + 1 - distinct if distinct else 0, *faults, illegal_pairs(initials), cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, symbols, initials, turns = None, [], [], (0, 0, 0)
        names = [f.name for f in schema]
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)]
            done.clear()
            types = [kind] + [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id")
            kind = conv.type
            code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            s, i = (flat(batch.column(c))[0].tobytes().decode() for c in ("symbol", "initial"))
            known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
            turn = batch.column("turn").fill_null(0).to_numpy()
            for a, b in zip(cut, cut[1:]):
                this = conv[a].as_py()
                if held is None or held[0] != this:
                    if held is not None:
                        done.append(report(held[0], "".join(symbols), "".join(initials), turns))
                    held, symbols, initials, turns = (this,), [], [], (0, 0, 0)
                symbols.append(s[a:b])
                initials.append(i[a:b])
                t = turn[a:b][known[a:b]]
                if len(t):
                    low, high, distinct = turns
                    more = int((np.diff(t) != 0).sum()) + (not distinct or int(t[0]) != high)
                    turns = (low if distinct else int(t[0]), int(t[-1]), distinct + more)
            if len(done) > 4096:
                yield out()
        if held is not None:
            done.append(report(held[0], "".join(symbols), "".join(initials), turns))
        if done:
            yield out()

    return ordered.mapInArrow(run, schema)


class Editor:
    """Applies one audit to rows that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user_next = audit, 0, True

    def _turned(self) -> str:
        self.user_next = not self.user_next
        return "assistant" if self.user_next else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._turned(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._turned(), text
        elif edit == "K":
            if role[:1] != "s":
                self._turned()
            yield edit, role, text


def _with_audits(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of ``report`` (head) each before its conversation's rows, in their order, a conversation within one task."""
    texts = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(), "text", F.lit(None).alias("head"))
    head = F.struct(*[c for c, _ in REPORT])
    heads = report.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).alias(c) for c in ("turn", "role", "digest", "text")], head.alias("head"))
    both = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "head")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict | None, Iterator[tuple[str, str, str]]]]:
    """(conv_id, head or None, edited rows) as they come; a head begins a conversation, an empty head at the end closes the last."""
    editor = None
    for batch in slices(batches):
        for conv, kind, role, text, head in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "head"))):
            if kind == 0:
                if editor:
                    yield None, None, editor.inserted()
                editor = Editor(head["audit"])
                yield conv, head, iter(())
            else:
                yield conv, None, editor.row(role, text)
    if editor:
        yield None, None, editor.inserted()


def repaired_rows(rows: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of each repaired conversation, numbered from 0; deleted rows are not among them.

    ``edit``: K kept, R another role, I inserted. ``rows`` as :func:`damage` or :func:`as_rows` gives them. Conversations
    that lose every row have none here.
    """
    report = materialise(conversation_report(rows), "repairs") if report is None else report
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType)]).add("place", "long").add("edit", "string").add("role", "string").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, held, size = None, 0, [], 0
        batches = iter(batches)
        kind: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind[:] = [batch.schema.field("conv_id").type]
                yield batch

        def out() -> pa.RecordBatch:
            types = [kind[0], pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], [f.name for f in schema])

        for this, head, edited in _edited(seen()):
            if head is not None:
                conv, place = this, 0
            for edit, role, text in edited:
                held.append((conv, place, edit, role, text))
                place, size = place + 1, size + len(text)
            if size > 4 << 20 or len(held) > 1 << 14:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return _with_audits(rows, report).mapInArrow(run, schema)


def repair_digests(rows: DataFrame) -> DataFrame:
    """The report of each conversation with ``repaired_sha256``: of its repaired ``role:text`` lines, joined by newlines, as they stream by."""
    report = materialise(conversation_report(rows), "repairs")
    schema = _report_schema(rows).add("repaired_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, types = [], []
        batches = iter(batches)

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.schema.field("conv_id").type] + [pa.int64()] * 6 + [pa.string()] * 2
                yield batch

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

        conv, report, digest, first = None, None, None, True
        for this, head, edited in _edited(seen()):
            if head is not None:
                if report is not None:
                    done.append((conv, *report.values(), digest.hexdigest()))
                    if len(done) > 4096:
                        yield out()
                conv, report, digest, first = this, head, hashlib.sha256(), True
            for _, role, text in edited:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if report is not None:
            done.append((conv, *report.values(), digest.hexdigest()))
            yield out()

    return _with_audits(rows, report).mapInArrow(run, schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults, the cheapest repair and the digest of the repaired rows."""
    return repair_digests(damage(read_table(spark, sf_dir, "conversations")))


_CRC = """
xor(list_reduce(flatten(list_transform(range(LEN(key)), lambda i: list_transform(range(8), lambda j: (ascii(substr(key, i + 1, 1)) >> j) & 1))),
                lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295) % 20"""


def _step(moves: dict[int, list[str]]) -> str:
    return ", ".join(f"LEAST({', '.join(moves[q])}) AS p{q}" for q in range(4))


def _oracle() -> str:
    """The least repairs row by row: a state for each place in the pattern, of packed (cost, audit) and the repaired lines."""
    add = lambda p, cost, letter, line: f"CASE WHEN p{p} IS NOT NULL THEN {{'k': printf('%08d', CAST(p{p}.k[1:8] AS INT) + {cost}) || p{p}.k[9:] || '{letter}', 't': p{p}.t || {line}}} END"
    said = lambda role: f"[{role} || ':' || r.text]"
    inserted = {q: [f"p{q}"] for q in range(4)}
    for role, moves in (("user", MOVES["u"]), ("assistant", MOVES["a"])):
        for p, q in moves.items():
            inserted[q].append(add(p, INSERT, "I", f"['{role}:']"))
    edited = {q: [add(q, DELETE, "D", "CAST([] AS VARCHAR[])")] for q in range(4)}
    for letter, role, moves in (("s", None, MOVES["s"]), ("u", "user", MOVES["u"]), ("a", "assistant", MOVES["a"])):
        for p, q in moves.items():
            kept = add(p, "r.extra", "K", said("r.role"))
            edited[q].append(f"CASE WHEN NOT r.out AND r.initial = '{letter}' THEN {kept} END")
            if role:
                moved = add(p, "r.extra + 1", "R", said(f"'{role}'"))
                edited[q].append(f"CASE WHEN NOT r.out AND r.initial <> '{letter}' THEN {moved} END")
    closure = lambda source: f"SELECT conv, i, {_step(inserted)} FROM ({source})"
    closed = lambda source: closure(closure(closure(source)))
    nothing = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[]))"
    return rf"""
WITH RECURSIVE source AS (
  SELECT conv_id, COALESCE(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {_CRC} AS kind FROM source),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, UNNEST(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0)),
placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM damaged),
seen AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM placed),
line AS (
  SELECT conv, i, turn, role, text, blank, again AND NOT blank AS twice, cut AND NOT again AND NOT blank AS cut, blank OR again AS out,
         CASE WHEN cut AND NOT again AND NOT blank THEN {TRUNCATED} ELSE 0 END AS extra,
         CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS initial FROM seen),
following AS (SELECT *, LAG(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM line),
counted AS (
  SELECT conv, COUNT(*) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
         COUNT(*) FILTER (blank) AS blank, COUNT(*) FILTER (twice) AS duplicate, COUNT(*) FILTER (cut) AS truncated,
         COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM following GROUP BY conv),
walk AS (
  {closed(f"SELECT conv, CAST(0 AS BIGINT) AS i, {{'k': '00000000', 't': CAST([] AS VARCHAR[])}} AS p0, {nothing} AS p1, {nothing} AS p2, {nothing} AS p3 FROM counted")}
  UNION ALL
  {closed(f"SELECT w.conv, r.i AS i, {_step(edited)} FROM walk w JOIN line r ON r.conv = w.conv AND r.i = w.i + 1")}),
best AS (SELECT w.conv, LEAST(p0, p3) AS b FROM walk w JOIN counted c ON c.conv = w.conv AND c.n = w.i)
SELECT conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, CAST(COALESCE(b.k[1:8], '0') AS BIGINT) AS cost, COALESCE(b.k[9:], '') AS audit,
       sha256(COALESCE(ARRAY_TO_STRING(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM source) LEFT JOIN counted USING (conv) LEFT JOIN best USING (conv)
"""


ORACLE = _oracle()
