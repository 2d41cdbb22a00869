"""The report tables of a run, all views of all samples in one write.

Views with unlike columns become rows of one long table (view, sample_id, ordinal, line), a line being the tab-separated
cells of a row. Every sample has a header line in every view, so a view that found nothing is a file with a header and not a
missing file. One job writes the long table by dynamic partitions, and the rows of each view are counted while they pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The views of a sample and of a cohort, by name.
SAMPLE_VIEWS = ("summary", "drugs", "catalogue_calls", "disagreements", "variants", "variant_catalogue", "checks", "observations", "lineage_support", "databases", "tools")
COHORT_VIEWS = ("distances", "clusters", "matrix", "databases", "tools", "samples")
#: The sample_id under which a cohort's own views stand.
COHORT = "cohort"


def _shown(c: Column, kind: str) -> Column:
    """A value as text: yes and no, whole numbers without a point, others with six decimals at most, NaN as NA."""
    if kind == "boolean":
        return F.when(c, "yes").otherwise("no")
    if kind in ("double", "float"):
        short = F.rtrim(F.rtrim(F.format_string("%.6f", c.cast("double")), F.lit("0")), F.lit("."))
        whole = (F.floor(c) == c) & (F.abs(c) < 1e15)
        return F.when(F.isnan(c), "NA").when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(F.when(short == "-0", "0").otherwise(short))
    return F.regexp_replace(c.cast("string"), r"[\t\r\n]", " ")


def cell(df: DataFrame, name: str) -> Column:
    """A column as the text of a table's cell: NULL as NA, lists joined by semicolons, no tabs or line ends inside."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind.startswith("array<"):
        inner = kind[len("array<") : -1]
        text = F.array_join(F.transform(c, lambda x: F.coalesce(_shown(x, inner), F.lit("NA"))), ";")
    else:
        text = _shown(c, kind)
    return F.when(c.isNull(), "NA").otherwise(text)


def lines(view: str, df: DataFrame, order: list[str]) -> DataFrame:
    """(view, sample_id, ordinal, line) of one view (with sample_id); ``order``: columns that its rows are sorted by, then by all cells.

    ``ordinal`` is a text that sorts as the rows do, so no window has to hold a sample's rows.
    """
    shown = [c for c in df.columns if c != "sample_id"]
    cells = [cell(df, c) for c in shown]
    key = F.concat_ws("\u0001", *[_sortable(df, c) for c in order], *cells)
    line = F.concat_ws("\t", F.coalesce(F.col("sample_id"), F.lit("NA")), *cells)
    return df.select(F.lit(view).alias("view"), "sample_id", F.concat(F.lit("1"), key).alias("ordinal"), line.alias("line"))


def _sortable(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # shifted, so that negative numbers sort before positive ones
        return F.coalesce(F.lpad((c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("~"))
    return F.coalesce(c.cast("string"), F.lit("~"))


def headers(view: str, columns: list[str], samples: DataFrame) -> DataFrame:
    """A header line of ``view`` for each sample."""
    head = "\t".join(["sample_id", *[c for c in columns if c != "sample_id"]])
    return samples.select(F.lit(view).alias("view"), "sample_id", F.lit("0").alias("ordinal"), F.lit(head).alias("line"))


def all_lines(views: dict[str, DataFrame], samples: DataFrame, order: dict[str, list[str]] | None = None, names: tuple[str, ...] = SAMPLE_VIEWS) -> DataFrame:
    """The long table of the named views; an unknown name is an error, a name without a table has headers alone.

    ``views``: tables with sample_id; rows of samples that are not among ``samples`` are left out. A view that is the same
    for all samples (databases, tools) may lack sample_id and is then given to each.
    """
    unknown = sorted(set(views) - set(names))
    if unknown:
        raise ValueError(f"no view is named {', '.join(unknown)}; the views are {', '.join(names)}")
    samples = samples.select("sample_id").distinct()
    out = None
    for name in names:
        df = views.get(name)
        if df is not None and "sample_id" not in df.columns:
            df = samples.crossJoin(df)
        part = headers(name, df.columns if df is not None else ["sample_id"], samples)
        if df is not None:
            part = part.unionByName(lines(name, df.join(samples, "sample_id", "left_semi"), (order or {}).get(name, [])))
        out = part if out is None else out.unionByName(part)
    return out


def write_lines(table: DataFrame, root: str) -> dict[str, int]:
    """Write the long table as text files under ``root``/view=V/sample_id=S, header first, rows in order; returns the rows of each view.

    One job: a view of a sample lies in one task, which sorts it and writes it to a file of its own; counts are observed
    while rows pass, headers not counted. A root that is written again is replaced.
    """
    seen = Observation()
    counted = table.observe(seen, *[F.count_if((F.col("view") == v) & (F.col("ordinal") != "0")).alias(v) for v in sorted({*SAMPLE_VIEWS, *COHORT_VIEWS})])
    placed = counted.repartition("view", "sample_id").sortWithinPartitions("view", "sample_id", "ordinal")
    placed.select("view", "sample_id", "line").write.mode("overwrite").partitionBy("view", "sample_id").text(root)
    return dict(seen.get)


def write_run(root: str, samples: DataFrame, views: dict[str, DataFrame], cohort: dict[str, DataFrame] | None = None, order: dict[str, list[str]] | None = None) -> dict[str, int]:
    """All tables of a run: the views of each sample and, under the sample name ``cohort``, those of the cohort; in one write.

    Returns the rows by view. Without any sample there is nothing to write, which is an error rather than an empty folder.
    """
    if samples.isEmpty():
        raise ValueError("there are no results to write")
    table = all_lines(views, samples, order)
    if cohort:
        whole = samples.select(F.lit(COHORT).alias("sample_id")).distinct()
        named = {n: df.withColumn("sample_id", F.lit(COHORT)) for n, df in cohort.items()}
        own = all_lines(named, whole, order, COHORT_VIEWS)
        table = table.unionByName(own)
    return {v: n for v, n in write_lines(table, root).items() if v in SAMPLE_VIEWS or cohort}
