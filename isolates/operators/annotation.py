"""Names of whole variant tables: substitutions, blocks, insertions, deletions and lost genes in one job on a tiled reference.

No row carries a contig. The reference is a table of tiles, keyed by (chrom, tile), each with a margin of its neighbours;
variants, genes and tiles meet by equal bins and tiles. What a name depends on is an allele (chrom, pos, ref, alt), so
alleles are named once, however many samples have them, and joined back. Coding sequences are put together from tiles once
for each gene, with their translation, and only insertions and deletions meet them.

Left alignment has no window: within the margin the shift is counted base by base; a shift that uses up the margin lies in
a long repeat, and long repeats (stretches where the reference equals itself some bases on) are a small table, built for
the lengths that need it, to which such rows are joined by tile. Their shift is then a subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isolates.functions import expressions as E
from isolates.functions.thresholds import VALUE
from isolates.operators.intervals import BIN
from isolates.operators.naming import NON_CODING, coding_offset, gene_spans, name_indels
from isolates.session import materialise, ship_package

#: Positions of a tile, and bases of its neighbours on each side.
TILE, MARGIN = 1024, 64
#: Bases to each side in which other placements of an insertion or deletion are looked for.
PLACEMENTS = 24
ALLELE = ["chrom", "pos", "ref", "alt"]
GENE = ["gene", "locus_tag", "start_pos", "end_pos", "strand", "biotype"]
# Effects that count as a loss of the gene's function.
LOSS = ("frameshift_variant", "stop_gained", "start_lost", "large_deletion", "stop_lost")


# --- the reference ---


def tile_of(pos: Column) -> Column:
    return F.floor((pos - 1) / TILE)


def sequence_tiles(sequences: DataFrame) -> DataFrame:
    """(chrom, tile, first_pos, bases): the reference (chrom, seq) in upper case, cut into tiles with margins.

    Tile t holds positions t * TILE + 1 to (t + 1) * TILE and ``MARGIN`` bases of the tiles beside it; ``first_pos`` is the
    position of its first base. Each contig is cut in one pass; margins reach their tiles by a shuffle on (chrom, tile).
    """
    pieces = F.posexplode(F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s)(.{{1,{TILE}}})"), 1)).alias("tile", "piece")
    return _with_margins(sequences.filter("seq is not null").select("chrom", pieces))


def tiles_of_pieces(pieces: DataFrame) -> DataFrame:
    """The same tiles of a reference that comes in pieces (chrom, at, bases), ``at`` counting the bases before: no contig is ever in one row."""
    some = pieces.filter("bases <> ''")
    first, last = F.floor(F.col("at") / TILE), F.floor((F.col("at") + F.length("bases") - 1) / TILE)
    cut = some.select("chrom", "at", F.upper("bases").alias("bases"), F.explode(F.sequence(first, last)).alias("tile"))
    low, high = F.greatest(F.col("at"), F.col("tile") * TILE), F.least(F.col("at") + F.length("bases"), (F.col("tile") + 1) * TILE)
    cut = cut.select("chrom", "tile", low.alias("low"), F.substr("bases", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda x: x["part"]), "")
    return _with_margins(cut.groupBy("chrom", F.col("tile").cast("int").alias("tile")).agg(whole.alias("piece")))


def _with_margins(cut: DataFrame) -> DataFrame:
    """Tiles from their own bases (chrom, tile, piece)."""
    parts = F.array(
        F.struct(F.lit(0).alias("by"), F.col("piece").alias("part")),
        F.struct(F.lit(1).alias("by"), F.substr("piece", F.lit(1), F.lit(MARGIN)).alias("part")),
        F.struct(F.lit(-1).alias("by"), F.substr("piece", F.greatest(F.length("piece") - MARGIN + 1, F.lit(1))).alias("part")),
    )
    spread = cut.select("chrom", "tile", F.explode(parts).alias("p")).select("chrom", (F.col("tile") - F.col("p.by")).alias("tile"), "p.by", "p.part")
    of = lambda by: F.max(F.when(F.col("by") == by, F.col("part")))
    tiles = spread.groupBy("chrom", "tile").agg(of(-1).alias("left"), of(0).alias("own"), of(1).alias("right")).filter("own is not null")
    left = F.coalesce("left", F.lit(""))
    return tiles.select(
        "chrom", F.col("tile").cast("long").alias("tile"), (F.col("tile") * TILE + 1 - F.length(left)).cast("int").alias("first_pos"), F.concat(left, "own", F.coalesce("right", F.lit(""))).alias("bases")
    )


def _bases(first: Column, n: Column | int) -> Column:
    """``n`` bases from position ``first`` on, of the tile on the row; fewer where the contig ends, NULL without a tile."""
    n = F.lit(n) if isinstance(n, int) else n
    skip = F.greatest(F.col("first_pos") - first, F.lit(0))
    return F.substr("bases", F.greatest(first - F.col("first_pos") + 1, F.lit(1)).cast("int"), F.greatest(n - skip, F.lit(0)).cast("int"))


def coding_sequences(genes: DataFrame, tiles: DataFrame) -> DataFrame:
    """(chrom, gene, start_pos, end_pos, strand, cds, protein) of the genes with a reading frame.

    ``cds`` reads as the contig does, ``protein`` as the gene does, stops and all. A gene that leaves its contig has what
    is there; one without a reference is not here.
    """
    frames = with_labels(genes).filter(_coding()).select("chrom", "gene", "start_pos", "end_pos", "strand").distinct()
    whole = fetched(frames, frames.columns, F.col("start_pos"), F.col("end_pos"), tiles).withColumnRenamed("around", "cds")
    return whole.withColumn("protein", E.translate(_oriented(F.col("cds"))))


def with_labels(genes: DataFrame) -> DataFrame:
    """``genes`` with their label in ``gene``: the name, or the locus tag of an unnamed one; missing biotypes are coding."""
    for name in ("locus_tag", "biotype"):
        genes = genes if name in genes.columns else genes.withColumn(name, F.lit(None).cast("string"))
    label = F.coalesce(F.when(F.col("name") != "", F.col("name")), "locus_tag")
    return genes.select("chrom", label.alias("gene"), "locus_tag", "start_pos", "end_pos", "strand", F.coalesce("biotype", F.lit("protein_coding")).alias("biotype"))


def _coding() -> Column:
    return ~F.lower("biotype").isin(*NON_CODING)


def _oriented(bases: Column) -> Column:
    return F.when(F.col("strand") == "-", E.reverse_complement(bases)).otherwise(bases)


# --- alleles and genes ---


def gene_pairs(places: DataFrame, genes: DataFrame, at: str = "pos", upstream: int = int(VALUE["promoter_window"])) -> DataFrame:
    """``places`` once for each gene that holds position ``at`` or has it in its promoter, with ``within``, ``offset`` and ``rank``.

    The least rank names the position: inside genes the shortest, outside all the nearest start.
    """
    spans = gene_spans(with_labels(genes), upstream).select("chrom", "bin", "low", "high", *GENE)
    met = places.withColumn("bin", F.floor(F.col(at) / BIN)).join(spans, ["chrom", "bin"]).filter(F.col(at).between(F.col("low"), F.col("high")))
    within = F.col(at).between(F.col("start_pos"), F.col("end_pos"))
    met = met.withColumns({"within": within, "offset": coding_offset(F.col(at))}).drop("bin", "low", "high")
    distance = F.when(F.col("within"), F.col("end_pos") - F.col("start_pos")).otherwise(F.abs("offset"))
    return met.withColumn("rank", F.struct((~F.col("within")).alias("outside"), distance.alias("distance"), "start_pos", "gene"))


def nearest_gene(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The pair of each place (``keys``) with the least rank."""
    rest = [c for c in pairs.columns if c not in keys]
    return pairs.groupBy(*keys).agg(F.min_by(F.struct(*rest), "rank").alias("best")).select(*keys, "best.*")


def changed_bases(alleles: DataFrame) -> DataFrame:
    """Alleles of equal lengths once for each base that they change: i, at, r, a."""
    same = alleles.filter(F.length("ref") == F.length("alt"))
    each = same.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("ref") - 1)))
    letter = lambda c: F.substr(c, F.col("i") + 1, F.lit(1))
    return each.withColumns({"r": letter("ref"), "a": letter("alt"), "at": (F.col("pos") + F.col("i")).cast("int")}).filter("r <> a")


def _codon_number() -> Column:
    """The codon that the base at ``at`` lies in, NULL outside a reading frame."""
    c = coding_offset(F.col("at"))
    return F.when((c > 0) & _coding(), F.floor((c - 1) / 3).cast("int") + 1)


def with_codon(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """``rows`` (a changed base at ``at``, a gene) with ``c``, codon ``number`` and ``codon`` as the gene reads it; NULL without one."""
    c, number = coding_offset(F.col("at")), _codon_number()
    first = F.when(F.col("strand") == "+", F.col("start_pos") + (number - 1) * 3).otherwise(F.col("end_pos") - number * 3 + 1)
    rows = rows.withColumns({"c": c, "number": number, "low": first, "tile": tile_of(F.col("at"))}).join(tiles, ["chrom", "tile"], "left")
    codon = _oriented(_bases(F.col("low"), 3))
    return rows.withColumn("codon", F.when(F.length(codon) == 3, codon)).drop("tile", "first_pos", "bases")


def _residues(before: Column, number: Column, after: Column) -> Column:
    return F.concat(F.lit("p."), E.three_letter(before), number.cast("string"), E.three_letter(after))


def base_names(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`with_codon` with ``hgvs`` and ``effect`` of the one changed base, in the gene's own direction."""
    prefix = F.when(_coding(), "c.").otherwise("n.")
    plain = F.concat(prefix, F.col("c").cast("string"), _oriented(F.col("r")), F.lit(">"), _oriented(F.col("a")))
    place = F.pmod(F.col("c") - 1, F.lit(3)).cast("int")
    mutant = F.concat(F.substr("codon", F.lit(1), place), _oriented(F.col("a")), F.substr("codon", place + 2))
    rows = rows.withColumns({"before": E.amino_acid(F.col("codon")), "after": F.when(F.col("codon").isNotNull(), E.amino_acid(mutant))})
    effect = (
        F.when(F.col("c") < 0, "upstream_variant")
        .when(~_coding(), "non_coding_variant")
        .when(F.col("codon").isNull(), "coding_variant")
        .when(F.col("number") == 1, "start_lost")
        .when(F.col("before") == F.col("after"), "synonymous_variant")
        .when(F.col("after") == "*", "stop_gained")
        .otherwise("missense_variant")
    )
    rows = rows.withColumn("effect", effect)
    protein = F.col("effect").isin("missense_variant", "stop_gained")
    return rows.withColumn("hgvs", F.when(protein, _residues(F.col("before"), F.col("number"), F.col("after"))).otherwise(plain)).drop("before", "after")


def codon_changes(rows: DataFrame) -> DataFrame:
    """(allele, gene, start_pos, number, protein): the residue that all changed bases of a codon make together, where it is another one.

    ``rows``: those of :func:`with_codon`; bases outside the gene count for nothing.
    """
    inside = rows.filter(F.col("codon").isNotNull() & F.col("at").between(F.col("start_pos"), F.col("end_pos")))
    place = F.pmod(F.col("c") - 1, F.lit(3)).cast("int")
    codons = inside.groupBy(*ALLELE, "gene", "start_pos", "number").agg(F.first("codon").alias("codon"), F.map_from_entries(F.collect_set(F.struct(place, _oriented(F.col("a"))))).alias("new"))
    mutant = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.col("new")[i], F.substr("codon", i + 1, F.lit(1)))), "")
    codons = codons.withColumns({"before": E.amino_acid(F.col("codon")), "after": E.amino_acid(mutant)}).filter("before <> after")
    return codons.select(*ALLELE, "gene", "start_pos", "number", _residues(F.col("before"), F.col("number"), F.col("after")).alias("protein"))


def name_alleles(alleles: DataFrame, genes: DataFrame, tiles: DataFrame, upstream: int = int(VALUE["promoter_window"]), pairs: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, gene, locus_tag, hgvs, effect): the one name of each distinct allele.

    A substitution is named by its base, a block by the whole codon that its first changed base lies in, an insertion or
    deletion by what it puts in or takes out. Between genes there is no gene and no name. A block that changes nothing has
    the gene and no name; without a reference the nucleotide name stands. ``pairs``: the alleles' :func:`gene_pairs`, if
    there are any yet; then ``alleles`` are distinct.
    """
    if pairs is None:
        alleles = alleles.select(*ALLELE).distinct()
        pairs = gene_pairs(alleles, genes, upstream=upstream)
    best = materialise(nearest_gene(pairs, ALLELE), "named_genes")
    bases = changed_bases(best)
    first = bases.groupBy(*ALLELE).agg(F.min_by(F.struct("i", "at", "r", "a", *GENE), "i").alias("x")).select(*ALLELE, "x.*")
    coded = with_codon(bases, tiles)
    single = base_names(with_codon(first, tiles)).select(*ALLELE, "number", "c", F.col("hgvs").alias("base_name"), F.col("effect").alias("base_effect"))
    whole = codon_changes(coded.filter(F.length("ref") > 1)).select(*ALLELE, "number", "protein")
    subs = single.join(whole, [*ALLELE, "number"], "left")
    block_effect = F.when(F.col("protein").endswith("Ter"), "stop_gained").when(F.col("number") == 1, "start_lost").otherwise("missense_variant")
    by_codon = F.col("protein").isNotNull()
    subs = subs.select(*ALLELE, F.when(by_codon, F.col("protein")).otherwise(F.col("base_name")).alias("hgvs"), F.when(by_codon, block_effect).otherwise(F.col("base_effect")).alias("effect"))
    indels = name_indels(best).select(*ALLELE, "hgvs", "effect")
    named = best.select(*ALLELE, "gene", "locus_tag").join(subs.unionByName(indels), ALLELE, "left")
    out = alleles.join(named, ALLELE, "left")
    return out.withColumn("effect", F.when(F.col("gene").isNull(), "intergenic_variant").otherwise(F.coalesce("effect", F.lit("no_change"))))


def annotate(variants: DataFrame, genes: DataFrame, tiles: DataFrame, upstream: int = int(VALUE["promoter_window"])) -> DataFrame:
    """``variants`` with gene, locus_tag, hgvs and effect; rows that already have gene and hgvs stay as they are.

    Every distinct allele is named once. A row that finds no name keeps an effect of its own, if it has one.
    """
    for name in ("gene", "locus_tag", "hgvs", "effect"):
        variants = variants if name in variants.columns else variants.withColumn(name, F.lit(None).cast("string"))
    known = (F.coalesce("gene", F.lit("")) != "") & (F.coalesce("hgvs", F.lit("")) != "")
    named = name_alleles(variants.filter(~known), genes, tiles, upstream)
    new = named.select(*ALLELE, *[F.col(c).alias(f"__{c}") for c in ("gene", "locus_tag", "hgvs", "effect")])
    met = variants.join(new, ALLELE, "left")
    fresh = ~known & F.col("__hgvs").isNotNull()
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    out = {
        "gene": F.when(fresh, F.col("__gene")).otherwise(F.col("gene")),
        "locus_tag": F.when(fresh, F.coalesce(text("locus_tag"), "__locus_tag")).otherwise(F.col("locus_tag")),
        "hgvs": F.when(fresh, F.col("__hgvs")).otherwise(F.col("hgvs")),
        "effect": F.when(known, F.col("effect")).when(fresh, F.col("__effect")).otherwise(F.coalesce(text("effect"), "__effect")),
    }
    return met.select(*[out.get(c, F.col(c)).alias(c) for c in variants.columns])


# --- insertions and deletions in proteins ---


def _shared(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(unlike > 0, unlike - 1).otherwise(F.greatest(F.size(a), F.size(b))).cast("int")


def protein_changes(indels: DataFrame, coding: DataFrame) -> DataFrame:
    """``indels`` (an allele, gene, start_pos) with ``protein``, the p. name of an in-frame change, and ``frameshift``, each NULL if there is none.

    The coding sequence is changed and translated, and both products are cut down to what differs. A deletion is
    moved as far to the end as the residues allow, an insertion that repeats what stands before it is a duplication.
    ``frameshift`` names the first residue that differs where the lengths are out of frame, and where the product gets
    shorter. Changes that reach out of the gene, or whose reference bases are not there, have neither.
    """
    ship_package(indels.sparkSession)
    rows = indels.join(coding.select("chrom", "gene", "start_pos", "strand", F.col("cds").alias("__cds"), F.col("protein").alias("__old")), ["chrom", "gene", "start_pos", "strand"])
    at = F.col("pos") - F.col("start_pos")
    rows = rows.filter((at >= 0) & (F.substr("__cds", at + 1, F.length("ref")) == F.upper("ref")) & (F.col("__old") != "") & F.col("alt").isNotNull())
    kept = indels.columns
    own = [at.cast("int").alias("__at"), F.upper("ref").alias("__ref"), F.upper("alt").alias("__alt"), (F.col("strand") == "-").alias("__back")]
    out = T.StructType([*indels.schema.fields, T.StructField("protein", T.StringType()), T.StructField("frameshift", T.StringType()), T.StructField("__made", T.BooleanType())])
    return rows.select(*kept, "__cds", "__old", *own).mapInArrow(partial(_products, width=len(kept)), out).filter("__made").drop("__made")


def _products(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Names of the changed product of each row, whose first ``width`` columns pass by."""
    for batch in batches:
        names = [_changed_product(*row) for row in zip(*(c.to_pylist() for c in batch.columns[width:]))]
        made = [pa.array([x[i] for x in names], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*batch.schema.names[:width], "protein", "frameshift", "__made"])


_TURNED = str.maketrans("ACGTacgt", "TGCAtgca")
_RESIDUE = {a + b + c: E.AMINO_ACIDS[i * 16 + j * 4 + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def _alike(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _changed_product(cds: str, old: str, at: int, ref: str, alt: str, back: bool) -> tuple[str | None, str | None, bool]:
    """The p. name, the frameshift and whether there is a product, of ``cds`` with ``alt`` for the ``ref`` after ``at`` bases; ``old`` is its product."""
    rest = at + len(ref)
    changed = cds[:at] + alt + cds[rest:]
    if len(changed) < 3:
        return None, None, False
    # codons before the change are those of the old product
    same = min((len(cds) - rest if back else at) // 3, len(old), len(changed) // 3)
    read = changed[::-1].translate(_TURNED) if back else changed
    new = old[:same] + "".join([_RESIDUE.get(c) or _RESIDUE.get(c.upper(), "X") for c in [read[i : i + 3] for i in range(same * 3, len(read) - 2, 3)]])
    most = min(len(old), len(new))
    head = min(same + _alike(old[same:], new[same:]), most)
    tail = min(_alike(old[::-1], new[::-1]), most - head)
    gone, more = len(old) - head - tail, len(new) - head - tail
    spot = lambda i: f"{E.THREE.get(old[i - 1], 'Xaa')}{i}"
    protein, shifted = None, None
    framed = (len(alt) - len(ref)) % 3 == 0
    if framed and gone > 0 and more == 0:
        # a deletion goes on while the residue that it leaves equals the one after it
        first = head + 1 + _alike(old[head:], old[head + gone :])
        protein = f"p.{spot(first)}del" if gone == 1 else f"p.{spot(first)}_{spot(first + gone - 1)}del"
    elif framed and more > 0 and gone == 0:
        added = new[head : head + more]
        # an insertion goes on while what follows is the same residues; over more than one step they are all one residue
        on = 0
        if old[head : head + more] == added:
            on = len(old) - head - len(old[head:].lstrip(added[0])) - more + 1 if len(set(added)) == 1 else 1
        before = head + max(on, 0)
        start = before - more + 1
        if start >= 1 and old[start - 1 : start - 1 + more] == added:
            protein = f"p.{spot(before)}dup" if more == 1 else f"p.{spot(start)}_{spot(before)}dup"
        elif 1 <= before < len(old):
            protein = f"p.{spot(before)}_{spot(before + 1)}ins" + "".join([E.THREE.get(x, "Xaa") for x in added])
    if (not framed or len(new) < len(old)) and head < len(old):
        shifted = f"p.{spot(head + 1)}fs"
    return protein, shifted, True


# --- placements and left alignment ---


def fetched(rows: DataFrame, keys: list[str], first: Column, last: Column, tiles: DataFrame) -> DataFrame:
    """(keys, around): the reference from position ``first`` to ``last`` for each of ``rows``, put together from the tiles that hold it."""
    spans = rows.select(*keys, first.cast("long").alias("__a"), last.cast("long").alias("__z")).withColumn("tile", F.explode(F.sequence(tile_of(F.col("__a")), tile_of(F.col("__z")))))
    met = spans.join(tiles, ["chrom", "tile"])
    own_first, own_last = F.greatest(F.col("tile") * TILE + 1, F.col("__a")), F.least((F.col("tile") + 1) * TILE, F.col("__z"))
    pieces = met.withColumn("piece", _bases(own_first, own_last - own_first + 1))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy(*keys).agg(whole.alias("around"))


def _indel_context(alleles: DataFrame, tiles: DataFrame) -> DataFrame:
    """Distinct insertions and deletions, trimmed (tpos, tref, talt), with the reference up to the anchor (before) and after the alleles (after).

    ``before`` has ``MARGIN`` bases, and those of an insertion more, so that all of its bases and as many of the
    reference can be compared. ``block``: what is put in or taken out; ``fits``: one allele is the anchor alone, the other
    begins with it, and the reference has what the allele says.
    """
    # trimmed before the aggregate, which keeps the expression from being copied into all that use it
    unlike = alleles.filter(F.length("ref") != F.length("alt"))
    rows = unlike.select(*ALLELE, E.trimmed(F.col("pos"), F.upper("ref"), F.upper("alt")).alias("t")).distinct()
    rows = rows.select(*ALLELE, F.col("t.pos").cast("int").alias("tpos"), F.col("t.ref").alias("tref"), F.col("t.alt").alias("talt"))
    deleted = F.length("tref") > F.length("talt")
    rows = rows.withColumns({"deleted": deleted, "block": F.substr(F.when(deleted, F.col("tref")).otherwise(F.col("talt")), F.lit(2))}).withColumn("n", F.length("block"))
    reach = MARGIN + F.when(F.col("deleted"), 0).otherwise(F.col("n"))
    rows = rows.withColumn("low", F.greatest(F.col("tpos") - reach + 1, F.lit(1)))
    around = fetched(rows, ALLELE, F.col("low"), F.col("tpos") + F.length("tref") - 1 + MARGIN, tiles)
    rows = rows.join(around, ALLELE, "left")
    size = F.col("tpos") - F.col("low") + 1
    rows = rows.withColumns({"before": F.substr("around", F.lit(1), size), "there": F.substr("around", size, F.length("tref")), "after": F.substr("around", size + F.length("tref"), F.lit(MARGIN))})
    pure = (F.least(F.length("tref"), F.length("talt")) == 1) & (F.substr("tref", F.lit(1), F.lit(1)) == F.substr("talt", F.lit(1), F.lit(1)))
    return rows.withColumn("fits", F.coalesce(pure & (F.col("there") == F.col("tref")), F.lit(False))).drop("around", "there", "low")


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def long_repeats(tiles: DataFrame, periods: DataFrame, least: int | None = None) -> DataFrame:
    """(chrom, period, first_pos, last_pos): the longest stretches, of ``least`` positions (a margin) or more, where each base equals the one ``period`` on.

    ``periods``: (chrom, period). A tile is compared with the tiles that hold its bases ``period`` on; stretches that end at
    a tile's edge are joined over the edges, only these and long ones are carried on.
    """
    least = MARGIN if least is None else least
    own = tiles.select("chrom", "tile", F.substr("bases", (F.col("tile") * TILE + 1 - F.col("first_pos") + 1).cast("int"), F.lit(TILE)).alias("own"))
    wanted = own.join(periods.select("chrom", "period").distinct(), "chrom").withColumn("ahead", F.explode(F.array(F.floor(F.col("period") / TILE), F.floor(F.col("period") / TILE) + 1)))
    other = own.select("chrom", F.col("tile").alias("other"), F.col("own").alias("bases"))
    met = wanted.withColumn("other", F.col("tile") + F.col("ahead")).join(other, ["chrom", "other"])
    both = met.groupBy("chrom", "period", "tile").agg(F.first("own").alias("own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "bases"))), lambda x: x["bases"]), "").alias("on"), F.min("other").alias("from"))
    # where the period is a multiple of the tile, the first of the two tiles lines up; else its first bases are skipped
    skip = F.col("tile") * TILE + F.col("period") - F.col("from") * TILE
    both = both.filter(skip >= 0).withColumn("on", F.substr("on", (skip + 1).cast("int"), F.length("own")))
    same = F.zip_with(_letters(F.substr("own", F.lit(1), F.length("on"))), _letters(F.col("on")), lambda x, y: x == y)
    both = both.withColumn("same", same).withColumn("size", F.size("same")).filter("size > 0")
    at = lambda i: F.coalesce(F.get("same", i - 1), F.lit(False))
    begins = F.filter(F.sequence(F.lit(1), F.col("size")), lambda i: at(i) & ~at(i - 1))
    ends = F.filter(F.sequence(F.lit(1), F.col("size")), lambda i: at(i) & ~at(i + 1))
    runs = both.select("chrom", "period", "tile", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("z"))).alias("r"))
    runs = runs.select("chrom", "period", (F.col("tile") * TILE + F.col("r.a")).alias("a"), (F.col("tile") * TILE + F.col("r.z")).alias("z"))
    runs = runs.filter((F.col("z") - F.col("a") + 1 >= least) | (F.pmod("a", F.lit(TILE)) == 1) | (F.pmod("z", F.lit(TILE)) == 0))
    on = W.partitionBy("chrom", "period").orderBy("a")
    runs = runs.withColumn("new", F.when(F.lag("z").over(on) == F.col("a") - 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(on))
    found = runs.groupBy("chrom", "period", "run").agg(F.min("a").cast("int").alias("first_pos"), F.max("z").cast("int").alias("last_pos")).drop("run")
    return found.filter(F.col("last_pos") - F.col("first_pos") + 1 >= least)


def left_aligned_alleles(alleles: DataFrame, tiles: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, new_pos, new_ref, new_alt, aligned) of each distinct insertion and deletion, at its leftmost place.

    ``aligned`` is false where the last bases of both alleles agree but the reference that would tell the next base is
    missing; at a contig's first base nothing is left to move. The shift is not bounded.
    """
    rows = _indel_context(alleles, tiles)
    n, size = F.col("n"), F.length("before")
    anchor = F.substr("tref", F.lit(1), F.lit(1))
    # going left, each base must equal the one n places to its right
    text = _letters(F.reverse(F.concat("before", "block")))
    steps = _shared(F.slice(text, n + 1, size), F.slice(text, F.lit(1), size))
    rows = rows.withColumn("steps", F.when(F.col("fits"), F.least(steps, size)).otherwise(0))
    # near: the first base that was not compared. It can only move on within the stretch of its period that was met so far
    rows = rows.withColumns({"spent": F.col("fits") & (F.col("steps") == size) & (F.col("tpos") > size), "near": F.col("tpos") - F.col("steps")})
    rows = materialise(rows, "indels")
    repeats = long_repeats(tiles, rows.filter("spent").select("chrom", F.col("n").alias("period")))
    repeats = repeats.withColumn("tile", F.explode(F.sequence(tile_of(F.col("first_pos")), tile_of(F.col("last_pos")))))
    repeats = repeats.select("chrom", F.col("period").alias("n"), "tile", F.col("first_pos").alias("run_first"), F.col("last_pos").alias("run_last"))
    far = rows.filter("spent").withColumn("tile", tile_of(F.col("near"))).join(repeats, ["chrom", "n", "tile"]).filter(F.col("near").between(F.col("run_first"), F.col("run_last")))
    far = far.groupBy(*ALLELE).agg(F.max(F.col("near") - F.col("run_first") + 1).alias("beyond"))
    rows = rows.join(far, ALLELE, "left").withColumn("shift", F.least(F.col("steps") + F.coalesce("beyond", F.lit(0)), F.col("tpos") - 1).cast("int"))
    # the block turns by the shift; its anchor is the base that now stands before it
    rows = rows.withColumn("turn", F.pmod(F.col("shift"), F.col("n")).cast("int"))
    rows = rows.withColumn("new_pos", F.col("tpos") - F.col("shift")).withColumn("tile", tile_of(F.col("new_pos"))).join(tiles, ["chrom", "tile"], "left")
    rows = rows.withColumns({"first": F.when(F.col("shift") == 0, anchor).otherwise(_bases(F.col("new_pos"), 1))})
    turned = F.concat(F.substr("block", F.col("n") - F.col("turn") + 1), F.substr("block", F.lit(1), F.col("n") - F.col("turn")))
    longer = F.concat("first", turned)
    moved = F.col("fits")
    shared = F.substr("tref", F.lit(-1), F.lit(1)) == F.substr("talt", F.lit(-1), F.lit(1))
    return rows.select(
        *ALLELE,
        F.when(moved, F.col("new_pos")).otherwise(F.col("tpos")).cast("int").alias("new_pos"),
        F.when(moved & F.col("deleted"), longer).when(moved, F.col("first")).otherwise(F.col("tref")).alias("new_ref"),
        F.when(moved & F.col("deleted"), F.col("first")).when(moved, longer).otherwise(F.col("talt")).alias("new_alt"),
        (F.col("fits") | ~shared | (F.col("tpos") <= 1)).alias("aligned"),
    )


def normalise_variants(variants: DataFrame, tiles: DataFrame) -> DataFrame:
    """``variants`` with pos, ref and alt trimmed and leftmost, in upper case; ``filters`` gains not-left-aligned where that was not possible.

    Rows keep all other columns. Substitutions are trimmed only.
    """
    filters = F.coalesce("filters", F.array().cast("array<string>")) if "filters" in variants.columns else F.array().cast("array<string>")
    moved = left_aligned_alleles(variants.select(*ALLELE), tiles)
    t = E.trimmed(F.col("pos"), F.upper("ref"), F.upper("alt"))
    met = variants.join(moved, ALLELE, "left").withColumn("__t", t)
    out = {c: F.coalesce(f"new_{c}", F.col(f"__t.{c}")) for c in ("pos", "ref", "alt")}
    out["pos"] = out["pos"].cast("int")
    out["filters"] = F.when(F.coalesce("aligned", F.lit(True)), filters).otherwise(F.array_union(filters, F.array(F.lit("not-left-aligned"))))
    names = [*variants.columns, *([] if "filters" in variants.columns else ["filters"])]
    return met.select(*[out.get(c, F.col(c)).alias(c) for c in names])


def placements(alleles: DataFrame, tiles: DataFrame, window: int = PLACEMENTS) -> DataFrame:
    """(chrom, pos, ref, alt, at_pos, at_ref, at_alt): every placement of an insertion or deletion within ``window`` bases that gives the same sequence.

    An allele that the reference does not bear out, or that is more than an insertion or deletion, has its own placement only.
    """
    ship_package(alleles.sparkSession)
    rows = _indel_context(alleles, tiles).select(*ALLELE, "tpos", "before", "block", "after", "deleted", "fits")
    out = "chrom string, pos int, ref string, alt string, at_pos int, at_ref string, at_alt string"
    return rows.withColumn("pos", F.col("pos").cast("int")).mapInArrow(partial(_placed, window=window), out)


def _placed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The placements of each row of an allele and what is around it."""
    for batch in batches:
        row, found = [], []
        for i, (pos, ref, alt, tpos, before, block, after, deleted, fits) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            own = _places(tpos, before, block, after, deleted, window) if fits else [(pos, ref, alt)]
            row += [i] * len(own)
            found += own
        same = batch.select(ALLELE).take(pa.array(row, pa.int32())).columns
        places = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*same, *places], names=[*ALLELE, "at_pos", "at_ref", "at_alt"])


def _places(pos: int, before: str, block: str, after: str, deleted: bool, window: int) -> list[tuple[int, str, str]]:
    """Where ``block``, put in or taken out after ``before``, can stand as well, with the alleles there."""
    left, right, n = before[-window - 1 :], after[:window], len(block)
    text, size = left + block + right, len(left)
    # it moves back while the base before it equals its last, and on while its first equals the next
    back = 0
    while back < size - 1 and text[size - 1 - back] == text[size + n - 1 - back]:
        back += 1
    onward = 0
    while onward < len(right) and text[size + onward] == text[size + n + onward]:
        onward += 1
    longer = [(pos + s, text[size + s - 1 : size + s + n], text[size + s - 1]) for s in range(-back, onward + 1)]
    return longer if deleted else [(at, anchor, whole) for at, whole, anchor in longer]


# --- every name that a catalogue may have ---


def _one_placement(placed: DataFrame) -> DataFrame:
    """``placed`` (an insertion or deletion at one of its placements, own_pos, own_ref and own_alt its allele, and a gene that holds it) with one placement in each gene.

    All placements give the same sequence, so those inside a gene change its product alike; the first of them is the one
    that may be whole in the gene if any is. A gene said to begin before its contig has all of them, as its sequence does not.
    """
    keys = ["chrom", "own_pos", "own_ref", "own_alt", "gene", "start_pos", "strand"]
    odd = F.when(F.col("start_pos") < 1, F.col("pos"))
    first = placed.filter("within").groupBy(*keys, odd.alias("odd")).agg(F.min(F.struct("pos", "ref", "alt")).alias("x"))
    return first.select(*keys, "x.*")


def genes_touched(alleles: DataFrame, genes: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, gene, lost_bases, whole): the coding genes that a deletion takes bases from, how many, and whether all."""
    gone = alleles.select(*ALLELE).distinct().filter(F.length("ref") > F.length("alt"))
    gone = gone.withColumns({"gone_from": F.col("pos") + 1, "gone_to": F.col("pos") + F.length("ref") - F.length("alt")})
    gone = gone.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gone_from") / BIN), F.floor(F.col("gone_to") / BIN))))
    spans = with_labels(genes).filter(_coding()).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_pos") / BIN), F.floor(F.col("end_pos") / BIN))))
    first = F.greatest("gone_from", "start_pos")
    met = gone.join(spans.select("chrom", "bin", "gene", "start_pos", "end_pos"), ["chrom", "bin"]).filter((F.col("start_pos") <= F.col("gone_to")) & (F.col("end_pos") >= F.col("gone_from")) & (F.floor(first / BIN) == F.col("bin")))
    bases = F.least("gone_to", "end_pos") - first + 1
    return met.select(*ALLELE, "gene", bases.cast("int").alias("lost_bases"), (bases == F.col("end_pos") - F.col("start_pos") + 1).alias("whole"))


def legitimate_names(variants: DataFrame, genes: DataFrame, tiles: DataFrame, upstream: int = int(VALUE["promoter_window"])) -> DataFrame:
    """(chrom, pos, ref, alt, gene, name): every name under which a catalogue may hold a distinct allele, ``LoF`` among them.

    The name that is printed; the names for promoters of other genes; for insertions and deletions those of every placement
    within 24 bases, in bases and in residues; for blocks each base, each changed codon and the whole block; and
    ``LoF`` for a change that ends the product, for genes that lose bases and for frameshifts.
    """
    alleles = materialise(variants.select(*ALLELE).distinct(), "alleles")
    pairs = materialise(gene_pairs(alleles, genes, upstream=upstream), "pairs")
    primary = materialise(name_alleles(alleles, genes, tiles, upstream, pairs).filter("gene is not null"), "names")
    sub, block = F.length("ref") == F.length("alt"), (F.length("ref") == F.length("alt")) & (F.length("ref") > 1)
    parts = [primary.filter("hgvs is not null").select(*ALLELE, "gene", F.col("hgvs").alias("name"))]

    # other genes' promoters
    others = pairs.filter("not within").join(primary.select(*ALLELE, F.col("gene").alias("named")), ALLELE, "left").filter(~F.col("gene").eqNullSafe(F.col("named")))
    first = changed_bases(others.select(*ALLELE, *GENE)).groupBy(*ALLELE, *GENE).agg(F.min_by(F.struct("i", "at", "r", "a"), "i").alias("x")).select(*ALLELE, *GENE, "x.*")
    parts.append(base_names(with_codon(first, tiles)).select(*ALLELE, "gene", F.col("hgvs").alias("name")))
    parts.append(name_indels(others).select(*ALLELE, "gene", F.col("hgvs").alias("name")))

    # every placement of an insertion or deletion, in all genes that hold it, or else in the promoters
    placed = placements(alleles.filter(~sub), tiles)
    own = [F.col(c).alias(f"own_{c}") for c in ("pos", "ref", "alt")]
    placed = placed.select("chrom", *own, F.col("at_pos").alias("pos"), F.col("at_ref").alias("ref"), F.col("at_alt").alias("alt"))
    back = [F.col("chrom"), *[F.col(f"own_{c}").alias(c) for c in ("pos", "ref", "alt")], "gene"]
    keys = ["chrom", "own_pos", "own_ref", "own_alt", "pos"]
    met = gene_pairs(placed, genes, upstream=upstream).withColumn("any_within", F.max("within").over(W.partitionBy(*keys))).filter("within or not any_within")
    met = materialise(met, "placed")
    parts.append(name_indels(met).select(*back, F.col("hgvs").alias("name")))
    protein = materialise(protein_changes(_one_placement(met), coding_sequences(genes, tiles)).select(*back, "protein", "frameshift"), "protein")
    parts.append(protein.filter("protein is not null").select(*ALLELE, "gene", F.col("protein").alias("name")))
    parts.append(protein.filter("frameshift is not null").select(*ALLELE, "gene", F.explode(F.array("frameshift", F.lit("LoF"))).alias("name")))

    # blocks: each base in the gene that names it and in the promoters of others, each codon, and the block as a whole
    bases = changed_bases(alleles.filter(block))
    at = materialise(gene_pairs(bases, genes, at="at", upstream=upstream), "bases")
    keys = [*ALLELE, "i"]
    best = materialise(nearest_gene(at, keys), "best")
    upstreams = at.filter("not within").join(best.select(*keys, F.col("gene").alias("named")), keys).filter("gene <> named")
    coded = with_codon(best.select(*ALLELE, "i", "r", "a", "at", *GENE).unionByName(upstreams.select(*ALLELE, "i", "r", "a", "at", *GENE)), tiles)
    single = base_names(coded)
    parts.append(single.select(*ALLELE, "gene", F.col("hgvs").alias("name")))
    meant = best.select(*ALLELE, "gene", "start_pos", _codon_number().alias("number")).filter("number is not null").distinct()
    codons = codon_changes(with_codon(at.filter("within").select(*ALLELE, "i", "r", "a", "at", *GENE), tiles)).join(meant, [*ALLELE, "gene", "start_pos", "number"])
    ended = F.col("protein").endswith("Ter") | (F.col("number") == 1)
    parts.append(codons.select(*ALLELE, "gene", F.explode(F.when(ended, F.array("protein", F.lit("LoF"))).otherwise(F.array("protein"))).alias("name")))
    whole = nearest_gene(pairs.filter(block).filter("within"), ALLELE)
    ends = [coding_offset(F.col("pos")), coding_offset((F.col("pos") + F.length("ref") - 1).cast("int"))]
    span = F.concat(F.least(*ends).cast("string"), F.lit("_"), F.greatest(*ends).cast("string"))
    replaced = F.concat(F.when(_coding(), "c.").otherwise("n."), span, F.lit("del"), _oriented(F.col("ref")), F.lit("ins"), _oriented(F.col("alt")))
    parts.append(whole.select(*ALLELE, "gene", replaced.alias("name")))

    # a lost product: of the named gene, of all coding genes there, and of genes that lose bases
    loss = F.col("effect").isin(*LOSS) | F.coalesce(F.col("hgvs").startswith("p.") & F.col("hgvs").endswith("Ter"), F.lit(False))
    disruptive = loss | F.coalesce(F.col("hgvs").rlike(r"^p\.Ter\d+"), F.lit(False))
    parts.append(primary.filter(loss).select(*ALLELE, "gene", F.lit("LoF").alias("name")))
    parts.append(pairs.filter(_coding()).join(primary.filter(disruptive).select(*ALLELE), ALLELE, "left_semi").select(*ALLELE, "gene", F.lit("LoF").alias("name")))
    parts.append(genes_touched(alleles, genes).select(*ALLELE, "gene", F.lit("LoF").alias("name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # names are counted, as a filter would be pushed into each part and take all that makes a name into its condition, too large to be compiled
    return out.filter("gene <> ''").groupBy(*ALLELE, "gene", "name").agg(F.count("name").alias("n")).filter("n > 0").drop("n")
