"""Records that span several lines, read from splits of a file: FASTQ and FASTA on any file system that Spark reads.

Spark's text source cuts a large file into splits and knows each line's file and where its split begins. A record can lie
across a cut. Each split is parsed as it streams by; what belongs to a record of the split before or after is handed on as
fragments (a few lines of each split), which are put together by file. Compressed files are one split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isolates.session import ship_package

#: Lines from which a split's first whole record is found, and bases of a piece of a sequence.
LOOK, PIECE = 64, 1 << 16


def _split_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, start, value): lines with their file and the first byte of their split, in the order of the file within a split."""
    ship_package(spark)
    lines = spark.read.text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _sample() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(path, start, lines) of runs of lines that lie in one split, a batch at a time."""
    for batch in batches:
        paths, starts, values = (batch.column(c).to_pylist() for c in ("path", "start", "value"))
        a = 0
        while a < len(values):
            z = a + 1
            while z < len(values) and starts[z] == starts[a] and paths[z] == paths[a]:
                z += 1
            yield paths[a], starts[a], values[a:z]
            a = z


def first_record(lines: list[str]) -> int | None:
    """Which of the first lines of a split begins a FASTQ record; None where there are too few lines to tell.

    A record's third line begins with +, which no bases do, so no line but its first can look like one.
    """
    for p in range(min(4, len(lines) - 3)):
        whole = [lines[i : i + 4] for i in range(p, len(lines) - 3, 4)]
        if all(head[:1] == "@" and plus[:1] == "+" and len(seq) == len(qual) for head, seq, plus, qual in whole):
            return p
    return None


class _Split:
    """Parses one split of a FASTQ file as its lines come."""

    def __init__(self, path: str, start: int):
        self.path, self.start, self.held, self.found, self.order, self.n = path, start, [], start == 0, 0, 0

    def feed(self, lines: list[str], last: bool) -> tuple[list[tuple], list[tuple]]:
        """Whole records (n, name, seq, qual) and fragments (order, line) so far."""
        self.held += lines
        records, fragments = [], []
        if not self.found and (len(self.held) >= LOOK or last):
            p = first_record(self.held[:LOOK])
            # without a whole record all lines are handed on
            fragments += self._out(len(self.held) if p is None else p)
            self.found = p is not None
        if self.found:
            whole = len(self.held) // 4 * 4
            for i in range(0, whole, 4):
                head, seq, plus, qual = self.held[i : i + 4]
                records.append((self.n, *record(head, seq, plus, qual, self.path)))
                self.n += 1
            self.held = self.held[whole:]
            if last:
                fragments += self._out(len(self.held))
        return records, fragments

    def _out(self, n: int) -> list[tuple]:
        out = [(self.order + i, line) for i, line in enumerate(self.held[:n])]
        self.order, self.held = self.order + n, self.held[n:]
        return out


def record(head: str, seq: str, plus: str, qual: str, path: str) -> tuple[str, str, str]:
    if not head.startswith("@") or not plus.startswith("+") or len(seq.strip()) != len(qual.strip()):
        raise ValueError(f"{path}: {head[:40]!r} begins no FASTQ record")
    return head[1:].strip(), seq.strip(), qual.strip()


_PARSED = "path string, start long, n long, name string, seq string, qual string, line string"


def read_fastq(spark: SparkSession, paths: str | list[str], max_records: int = 0, max_bases: int = 0) -> DataFrame:
    """(sample_id, name, seq, qual) of FASTQ files, plain or compressed, read in splits.

    ``max_records`` and ``max_bases`` bound the rows of each file from its top on: a file stops at so many records, or
    with the record that reaches so many bases; 0 is no bound. Each split then hands on no more than that, and the bounds
    are applied over a file's splits in order. A last record that lacks lines is left out; any other that is none is an
    error. ``sample_id``: the file's name up to the first point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PARSED.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        split: _Split | None = None
        seen = {"records": 0, "bases": 0}

        def out(records: list[tuple], fragments: list[tuple]) -> pa.RecordBatch:
            kept = []
            for r in records:
                if not (max_records and seen["records"] >= max_records) and not (max_bases and seen["bases"] >= max_bases):
                    kept.append((split.path, split.start, *r, None))
                    seen["records"] += 1
                    seen["bases"] += len(r[2])
            kept += [(split.path, split.start, order, None, None, None, line) for order, line in fragments]
            columns = zip(*kept) if kept else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for path, start, lines in _by_split(batches):
            if split is None or (path, start) != (split.path, split.start):
                if split is not None:
                    yield out(*split.feed([], True))
                split = _Split(path, start)
                seen.update(records=0, bases=0)
            yield out(*split.feed(lines, False))
        if split is not None:
            yield out(*split.feed([], True))

    parsed = _split_lines(spark, paths).mapInArrow(run, _PARSED)
    whole = parsed.filter("line is null").select("path", "start", "n", "name", "seq", "qual")
    # a record over a cut: its lines follow each other in the order of splits; a few lines of each split
    lines = F.array_sort(F.collect_list(F.struct("start", F.col("n").alias("order"), "line")))
    joined = parsed.filter("line is not null").groupBy("path").agg(lines.alias("lines"))
    at = F.sequence(F.lit(0), F.floor(F.size("lines") / 4).cast("int") - 1)
    cut = joined.filter("size(lines) >= 4").select("path", F.explode(F.transform(at, lambda i: F.slice("lines", i * 4 + 1, 4))).alias("r"))
    line = lambda i: F.col("r")[i]["line"]
    bad = ~F.startswith(line(0), F.lit("@")) | ~F.startswith(line(2), F.lit("+")) | (F.length(F.trim(line(1))) != F.length(F.trim(line(3))))
    cut = cut.filter(F.assert_true(~bad, F.concat("path", F.lit(": a record over a cut is no FASTQ record"))).isNull())
    # it comes after the whole records of the split that it begins in
    cut = cut.select("path", F.col("r")[0]["start"].alias("start"), F.lit(1 << 62).alias("n"), F.trim(F.substr(line(0), F.lit(2))).alias("name"), F.trim(line(1)).alias("seq"), F.trim(line(3)).alias("qual"))
    rows = whole.unionByName(cut)
    if max_records or max_bases:
        on = W.partitionBy("path").orderBy("start", "n")
        before = F.coalesce(F.sum(F.length("seq")).over(on.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumns({"i": F.row_number().over(on), "before": before})
        rows = rows.filter((F.lit(max_records == 0) | (F.col("i") <= max_records)) & (F.lit(max_bases == 0) | (F.col("before") < max_bases)))
    return rows.select(_sample().alias("sample_id"), "name", "seq", "qual")


_PIECES = "path string, start long, run long, header string, n long, bases string"


def read_fasta_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample_id, record, name, header, at, bases): FASTA sequences in pieces of about ``PIECE`` bases, ``at`` counts the bases before it.

    No sequence is ever whole in a row, and a contig is read by as many tasks as its file has splits. ``record`` numbers
    the records of a file. A record without bases has one empty piece; blank lines and those that begin with ; are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        done: list[tuple] = []
        now = None  # path, start, run, header, pieces so far
        held: list[str] = []
        size = 0

        def piece() -> None:
            nonlocal held, size
            if now is not None and (held or (now[3] is not None and now[4] == 0)):
                done.append((now[0], now[1], now[2], now[3], now[4], "".join(held).upper()))
                now[4] += 1
            held, size = [], 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done.clear()
            return batch

        for path, start, lines in _by_split(batches):
            if now is None or (path, start) != (now[0], now[1]):
                piece()
                now = [path, start, 0, None, 0]
            for line in lines:
                if line.startswith(">"):
                    piece()
                    now = [path, start, now[2] + 1, line[1:].strip(), 0]
                elif line and not line.startswith(";"):
                    line = line.strip()
                    held.append(line)
                    size += len(line)
                    if size >= PIECE:
                        piece()
            if len(done) > 64:
                yield out()
        piece()
        if done:
            yield out()

    pieces = _split_lines(spark, paths).mapInArrow(run, _PIECES)
    # which record a split's first bases belong to, and how many bases it has before: from a row for each record and split
    runs = pieces.groupBy("path", "start", "run").agg(F.max("header").alias("header"), F.sum(F.length("bases")).alias("size"))
    on = W.partitionBy("path").orderBy("start", "run")
    runs = runs.withColumn("record", F.count("header").over(on.rowsBetween(W.unboundedPreceding, W.currentRow)))
    of = W.partitionBy("path", "record").orderBy("start", "run")
    earlier = F.coalesce(F.sum("size").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.filter("record > 0").select("path", "start", "run", "record", F.max("header").over(W.partitionBy("path", "record")).alias("whole_header"), earlier.alias("earlier"))
    own = W.partitionBy("path", "start", "run").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("within", F.coalesce(F.sum(F.length("bases")).over(own), F.lit(0)))
    placed = pieces.join(runs, ["path", "start", "run"])
    name = F.element_at(F.split("whole_header", r"\s+"), 1)
    return placed.select(_sample().alias("sample_id"), "record", name.alias("name"), F.col("whole_header").alias("header"), (F.col("earlier") + F.col("within")).cast("long").alias("at"), "bases")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample_id, name, header, seq) of whole FASTA records, in upper case; for sequences that fit in a row."""
    pieces = read_fasta_pieces(spark, paths)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.length("bases").alias("n"), "bases"))), lambda x: x["bases"]), "")
    return pieces.groupBy("sample_id", "record", "name", "header").agg(whole.alias("seq")).drop("record")
