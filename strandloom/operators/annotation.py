"""Annotation rows: attributes, names, overlaps, exons, transcripts and circular sequences.

Rows have line_no, seqname, source, feature, start, end, score, strand, frame, attribute; positions are 1-based and closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.positions import rotate_position
from strandloom.operators.intervals import TILE, periods_and_gaps

CORE = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame"]


def parse_attributes(attribute: Column) -> Column:
    """Array of (k, v) of ``key "value"; key "value";``: split at semicolon and blank, key and value at the first blank, quotes dropped."""
    text = F.regexp_replace(F.trim(attribute), ";$", "")
    items = F.filter(F.split(text, "; "), lambda s: F.trim(s) != "")
    return F.transform(
        items,
        lambda s: F.struct(
            F.split(F.trim(s), " ", 2)[0].alias("k"),
            F.regexp_replace(F.coalesce(F.get(F.split(F.trim(s), " ", 2), F.lit(1)), F.lit("")), '"', "").alias("v"),
        ),
    )


def attribute_of(parsed: Column, key: str, sep: str = "__") -> Column:
    """The values of a key joined by ``__``, null if there is none."""
    own = F.transform(F.filter(parsed, lambda s: s["k"] == key), lambda s: s["v"])
    return F.when(F.size(own) > 0, F.array_join(own, sep))


def attributes_long(gtf: DataFrame) -> DataFrame:
    return gtf.select("line_no", F.posexplode(parse_attributes(F.col("attribute"))).alias("pos", "a")).select("line_no", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("a.k").alias("attribute"), F.col("a.v").alias("value"))


def with_attributes(gtf: DataFrame, keys: list[str], rename: dict[str, str] | None = None, replace: bool = False) -> DataFrame:
    """The core columns and one column per key, without a shuffle.

    ``rename`` gives a key a further name (or, with ``replace``, another one); a key that has the new name already gives way to it.
    """
    rename = rename or {}
    source = {k: k for k in keys}
    for old, new in rename.items():
        source[new] = old
        if replace:
            source.pop(old, None)
    parsed = gtf.select("line_no", *CORE, parse_attributes(F.col("attribute")).alias("_parsed"))  # a column of its own: parsed once for all keys
    return parsed.select("line_no", *CORE, *[attribute_of(F.col("_parsed"), old).alias(new) for new, old in source.items()])


def filter_rows(gtf: DataFrame, seqnames: list[str] | None = None, features: list[str] | None = None, gene_names: list[str] | None = None) -> DataFrame:
    """Rows of the sequences and features, and with one of the names as a quoted value of any attribute, regardless of case."""
    out = gtf
    if seqnames:
        out = out.where(F.col("seqname").isin(seqnames))
    if features:
        out = out.where(F.col("feature").isin(features))
    if gene_names:
        out = out.where(F.col("attribute").rlike("(?i)" + "|".join(f'"\\Q{n}\\E"' for n in gene_names)))
    return out


def relabel_features(gtf: DataFrame, remove_exons: bool = False, to_exon: list[str] | None = None, exons_only: bool = False) -> DataFrame:
    """Exons dropped, other features made exons, all but exons dropped: in this order."""
    out = gtf.where("feature is null or feature <> 'exon'") if remove_exons else gtf
    if to_exon:
        out = out.withColumn("feature", F.when(F.col("feature").isin(to_exon), "exon").otherwise(F.col("feature")))
    return out.where("feature = 'exon'") if exons_only else out


def keep_with_exon(gtf: DataFrame) -> DataFrame:
    """Rows whose transcript has an exon, and the gene rows of such transcripts' genes; needs transcript_id and gene_id."""
    exons = gtf.where("feature = 'exon' and transcript_id is not null").select("transcript_id", "gene_id")
    own = gtf.join(exons.select("transcript_id").distinct(), "transcript_id", "left_semi").where("feature is null or feature <> 'gene'")
    genes = gtf.where("feature = 'gene'").join(exons.select("gene_id").distinct(), "gene_id", "left_semi")
    return own.unionByName(genes)


def fill_gene_names(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Null gene_name filled with the most frequent of the gene_id, of equals the first in order. ``strict`` fails if a gene_id has several."""
    known = rows.where("gene_name is not null and gene_id is not null").groupBy("gene_id").agg(F.mode("gene_name", True).alias("_usual"), F.count_distinct("gene_name").alias("_n"))
    if strict:
        known = known.withColumn("_usual", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several gene names for "), F.col("gene_id")))).otherwise(F.col("_usual")))
    return rows.join(known.drop("_n"), "gene_id", "left").withColumn("gene_name", F.coalesce("gene_name", "_usual")).drop("_usual")


def clean_names(name: Column, prefix: str = "") -> Column:
    """Runs of other signs than letters and digits become one dash, one dash at either end goes."""
    out = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit(prefix), out) if prefix else out


def fix_duplicate_names(rows: DataFrame, name: str = "gene_name", owner: str = "gene_id", order: str = "line_no") -> DataFrame:
    """A name that several owners share becomes ``name--k`` for each, k by the owners' first appearance; rows with null keep theirs."""
    pairs = rows.where(F.col(name).isNotNull() & F.col(owner).isNotNull()).groupBy(name, owner).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(name)
    ranked = pairs.select(F.col(name).alias("_n"), F.col(owner).alias("_o"), F.count("*").over(w).alias("_c"), F.row_number().over(w.orderBy("_first", owner)).alias("_k")).where("_c > 1")
    joined = rows.join(ranked, (F.col(name) == F.col("_n")) & (F.col(owner) == F.col("_o")), "left")
    return joined.withColumn(name, F.when(F.col("_k").isNotNull(), F.concat(F.col(name), F.lit("--"), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_n", "_o", "_c", "_k")


def fix_duplicates(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Names that stand for several things made unique, in this order: a gene_name of several gene_ids, a gene_id of several gene_names, a transcript_id of several gene_ids, as
    far as there are such columns; see ``fix_duplicate_names``. Rows are joined on both columns, so none is repeated."""
    for name, owner in (("gene_name", "gene_id"), ("gene_id", "gene_name"), ("transcript_id", "gene_id")):
        if {name, owner} <= set(rows.columns):
            rows = fix_duplicate_names(rows, name, owner, order)
    return rows


#: Distinct attribute keys that a table may hold where all are asked for.
MOST_KEYS = 1000


def attribute_keys(gtf: DataFrame) -> list[str]:
    """All attribute keys of the rows, in order: a job that runs when this is called. More than ``MOST_KEYS`` fail, as each is to be a column."""
    found = attributes_long(gtf).select("attribute").distinct().limit(MOST_KEYS + 1).collect()
    if len(found) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} attribute keys")
    return sorted(r["attribute"] for r in found)


def aggregate_exons(rows: DataFrame) -> DataFrame:
    """One exon per transcript: least start, greatest end, the most frequent of the rest, lines joined by ``---``."""
    exons = rows.where("feature = 'exon' and transcript_id is not null")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")), "---")
    usual = [F.mode(c, True).alias(c) for c in ("seqname", "source", "strand", "gene_id", "gene_name")]
    return exons.groupBy("transcript_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), *usual, lines.alias("index"), F.lit(1).cast("bigint").alias("exon_number"))


def gene_spans(rows: DataFrame) -> DataFrame:
    good = rows.where("gene_id is not null and seqname is not null and start is not null and end is not null and start <= end")
    return good.groupBy("seqname", "gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def merge_overlapping(rows: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """Rows (seqname, start, end, strand, *columns, n): overlapping rows as one, whatever their strands.

    The strand is the common one, else +. Of each column the distinct values, in order of their first line, are joined by ``---``; '' for none.

    Rows are aggregated by their start before anything is joined. The period of a start is the last one that begins at or before it, in its tile or an earlier one:
    a window over the starts of a tile, at most ``tile``, and one over the tiles of a sequence tell it, so that no period is expanded, however long it is.
    """
    good = rows.where("seqname is not null and start is not null and end is not null and start <= end")
    periods = periods_and_gaps(good, tile=tile).where("kind = 'period'")
    p_type = "struct<seg_start:bigint,seg_end:bigint>"
    begun = periods.select("seqname", F.col("seg_start").alias("start"), F.struct("seg_start", "seg_end").alias("p"))
    starts = good.select("seqname", "start").distinct().select("seqname", "start", F.lit(None).cast(p_type).alias("p")).unionByName(begun)
    starts = starts.withColumn("t", F.expr(f"(start - pmod(start, {tile}L)) div {tile}L"))
    own = F.last("p", ignorenulls=True).over(Window.partitionBy("seqname", "t").orderBy("start", F.col("p").isNull()))
    earlier = F.last(F.max("p"), ignorenulls=True).over(Window.partitionBy("seqname").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    before = starts.groupBy("seqname", "t").agg(earlier.alias("before"))
    placed = starts.select("seqname", "t", "start", own.alias("own"), "p").where("p is null").join(before, ["seqname", "t"])
    home = placed.select("seqname", "start", F.coalesce("own", "before").alias("p"))
    # one row for the strand and one for each column, that of the strand counts
    cells = [F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(["strand", *columns])]
    long = good.select("seqname", "start", "line_no", F.explode(F.array(*cells)).alias("x")).where("x.c = 0 or x.v is not null")
    values = long.groupBy("seqname", "start", "x.c", "x.v").agg(F.min("line_no").alias("first"), F.count("*").alias("n")).join(home, ["seqname", "start"])
    values = values.groupBy("seqname", "p", "c", "v").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    strand = F.when(F.col("c") == 0, F.col("v"))
    listed = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == i, F.struct("first", "v")))), lambda s: s["v"]), "---").alias(c) for i, c in enumerate(columns, 1)]
    out = values.groupBy("seqname", "p").agg(F.when(F.min(strand) == F.max(strand), F.min(strand)).otherwise("+").alias("strand"), *listed, F.sum(F.when(F.col("c") == 0, F.col("n"))).alias("n"))
    return out.select("seqname", F.col("p.seg_start").alias("start"), F.col("p.seg_end").alias("end"), "strand", *columns, "n")


def introns(rows: DataFrame) -> DataFrame:
    """Rows (transcript_id, seqname, strand, intron_no, start, end): what lies between consecutive exons of a transcript, by position."""
    exons = rows.where("feature = 'exon' and transcript_id is not null and start is not null and end is not null and start <= end").select("transcript_id", "seqname", "strand", "start", "end").distinct()
    w = Window.partitionBy("transcript_id", "seqname", "strand").orderBy("start", "end")
    gaps = exons.select("transcript_id", "seqname", "strand", (F.col("end") + 1).alias("start"), (F.lead("start").over(w) - 1).alias("end")).where("end >= start")
    return gaps.select("transcript_id", "seqname", "strand", F.row_number().over(w).cast("bigint").alias("intron_no"), "start", "end")


def exon_sums(rows: DataFrame) -> DataFrame:
    """Exons in transcript order with nt, its running sum, the bases of the last codon begun and the phase of the following intron."""
    exons = rows.where("feature = 'exon' and transcript_id is not null and start is not null and end is not null and start <= end").select("transcript_id", "seqname", "strand", "start", "end").distinct()
    along = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    w = Window.partitionBy("transcript_id", "seqname", "strand").orderBy("_along", "start", "end")
    rows = exons.withColumn("_along", along).withColumn("nt", F.col("end") - F.col("start") + 1)
    rows = rows.withColumn("nt_cumsum", F.sum("nt").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("exon_no", F.row_number().over(w).cast("bigint"))
    return rows.select("transcript_id", "seqname", "strand", "exon_no", "start", "end", "nt", "nt_cumsum", (F.col("nt_cumsum") / 3).alias("codon_cumsum"), (F.col("nt_cumsum") % 3).cast("string").alias("intron_phase"))


def best_cuts(rows: DataFrame, length: Column | None = None) -> DataFrame:
    """Rows (seqname, gap_start, gap_size, cut): of each sequence, taken as a circle, the widest room between genes and its middle.

    The circle's length is the last gene's end plus the first gene's start - 1, or ``length`` (an aggregate). Of equal gaps the first counts.
    """
    genes = gene_spans(rows)
    gaps = periods_and_gaps(genes).where("kind = 'gap'").select("seqname", F.col("seg_start").alias("gap_start"), (F.col("seg_end") - F.col("seg_start") + 1).alias("gap_size"))
    ends = genes.groupBy("seqname").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), (length if length is not None else F.max("end") + F.min("start") - 1).alias("len"))
    around = ends.select("seqname", (F.col("hi") + 1).alias("gap_start"), (F.col("len") - F.col("hi") + F.col("lo") - 1).alias("gap_size"))
    best = gaps.unionByName(around).groupBy("seqname").agg(F.max(F.struct(F.col("gap_size"), (-F.col("gap_start")).alias("s"))).alias("b"))
    out = best.join(ends.select("seqname", "len"), "seqname").select("seqname", (-F.col("b.s")).alias("gap_start"), F.col("b.gap_size").alias("gap_size"), "len")
    middle = F.floor((F.col("gap_start") + F.col("gap_start") + F.col("gap_size") - 1) / 2).cast("bigint")
    return out.select("seqname", "gap_start", "gap_size", (F.pmod(middle - 1, F.col("len")) + 1).alias("cut"))


def wrapped_genes(rows: DataFrame) -> DataFrame:
    """Genes whose exons, in the order of their numbers, don't run in one direction: they lie across the origin. Needs exon_number."""
    exons = rows.where("feature in ('CDS', 'exon') and gene_id is not null and exon_number is not null and start is not null")
    has_cds = exons.groupBy("gene_id").agg(F.bool_or(F.col("feature") == "CDS").alias("cds"))
    used = exons.join(has_cds, "gene_id").where("feature = if(cds, 'CDS', 'exon')")
    w = Window.partitionBy("gene_id", "transcript_id").orderBy("exon_number", "line_no")
    step = used.select("gene_id", "strand", (F.col("start") - F.lag("start").over(w)).alias("step"))
    against = F.when(F.col("strand") == "-", F.col("step") > 0).otherwise(F.col("step") < 0)
    return step.groupBy("gene_id").agg(F.bool_or(against).alias("wraps")).where("wraps").select("gene_id")


def with_circle(rows: DataFrame, length: int) -> DataFrame:
    """The rows with ``circle``, the length of their sequence: the given one, or the greatest end where rows reach beyond it."""
    ends = rows.groupBy(F.col("seqname").alias("_name")).agg(F.greatest(F.lit(length).cast("bigint"), F.max("end")).alias("circle"))
    return rows.join(ends, F.col("seqname").eqNullSafe(F.col("_name"))).drop("_name")


def rotate_rows(rows: DataFrame, cut: int, length: int | Column) -> DataFrame:
    """Positions after the circle was opened so that ``cut`` is 1; a row across the new origin becomes two, part 1 and 2."""
    s, e = rotate_position(F.col("start"), cut, length), rotate_position(F.col("end"), cut, length)
    halves = F.when(s <= e, F.array(F.struct(F.lit(1).alias("part"), s.alias("s"), e.alias("e")))).otherwise(
        F.array(F.struct(F.lit(1).alias("part"), s.alias("s"), F.lit(length).cast("bigint").alias("e")), F.struct(F.lit(2).alias("part"), F.lit(1).cast("bigint").alias("s"), e.alias("e")))
    )
    cut_rows = rows.withColumn("_h", F.explode(halves))
    return cut_rows.withColumn("start", F.col("_h.s")).withColumn("end", F.col("_h.e")).withColumn("part", F.col("_h.part")).drop("_h")


def key_value_column(rows: DataFrame, keys: list[str]) -> Column:
    """``key "value"; `` for each key, NA for nulls."""
    return F.concat(*[F.concat(F.lit(f'{k} "'), F.coalesce(F.col(k).cast("string"), F.lit("NA")), F.lit('"; ')) for k in keys])


def coverage_runs(rows: DataFrame) -> DataFrame:
    """Rows (seqname, first, last, depth): stretches of one depth, where at least one row covers them.

    Depth changes only where a row starts or ends: the sums of these changes are cut into tiles with the depth each tile begins with, so no
    position is expanded and a hot sequence is spread over its tiles.
    """
    good = rows.where("seqname is not null and start is not null and end is not null and start <= end")
    steps = good.select("seqname", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy("seqname", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d")).where("d <> 0").withColumn("t", F.expr(f"p div {TILE}L"))
    tiles = steps.groupBy("seqname", "t").agg(F.sum("d").alias("d"), F.min("p").alias("p"))
    w = Window.partitionBy("seqname").orderBy("t")
    tiles = tiles.select(F.col("seqname").alias("_s"), F.col("t").alias("_t"), F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("p").over(w).alias("beyond"))
    inside = Window.partitionBy("seqname", "t").orderBy("p")
    joined = steps.join(tiles, (F.col("seqname") == F.col("_s")) & (F.col("t") == F.col("_t")))
    runs = joined.select("seqname", F.col("p").alias("first"), (F.coalesce(F.lead("p").over(inside), F.col("beyond")) - 1).alias("last"), (F.col("before") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"))
    return runs.where("depth > 0")


def rebase_to_gene(rows: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Rows with positions counted from their gene's first base, ``left`` bases more before it, and the stretch to cut from the sequence."""
    spans = gene_spans(rows).select("seqname", "gene_id", F.greatest(F.col("start") - left, F.lit(1)).alias("cut_start"), (F.col("end") + right).alias("cut_end"))
    return rows.join(spans, ["seqname", "gene_id"]).withColumn("new_start", F.col("start") - F.col("cut_start") + 1).withColumn("new_end", F.col("end") - F.col("cut_start") + 1)


def prepare_annotation(
    gtf: DataFrame, keys: list[str] | None = None, rename: dict[str, str] | None = None, remove_exons: bool = False, to_exon: list[str] | None = None, exons_only: bool = False, strict_names: bool = False,
    prefix: str = "", clean: bool = True, replace_names: dict[str, str] | None = None, names_from: str | None = None, all_keys: bool = False, rotate: tuple[int, int] | None = None, one_exon: bool = False, merge: bool = False, need_exon: bool = False, as_text: bool = False,
) -> DataFrame:
    """Annotation rows brought into order, step by step: features filtered and relabelled, attributes parsed, renamed and kept (``all_keys``: every one there is), gene names filled
    (with ``names_from`` from that column where a gene has none), replaced, cleaned, names and ids made unique, positions rotated by (cut, length), exons of a transcript made one, overlapping rows merged, rows without an exon dropped, and keys written back as attribute text.
    """
    keys = attribute_keys(gtf) if all_keys else keys or ["gene_id", "gene_name", "transcript_id", "transcript_name", "exon_number"]
    rows = with_attributes(relabel_features(gtf, remove_exons, to_exon, exons_only), keys, rename)
    if names_from and "gene_name" not in rows.columns:
        rows = rows.withColumn("gene_name", F.lit(None).cast("string"))
    if {"gene_id", "gene_name"} <= set(rows.columns):
        rows = fill_gene_names(rows, strict_names)
        name = F.coalesce("gene_name", names_from) if names_from else F.col("gene_name")
        for old, new in (replace_names or {}).items():
            name = F.when(name == old, new).otherwise(name)
        rows = rows.withColumn("gene_name", clean_names(name, prefix) if clean else name)
        rows = fix_duplicates(rows)
    if rotate:
        rows = rotate_rows(rows.where("start is not null and end is not null and start <= end"), *rotate)
    if one_exon:
        return aggregate_exons(rows)
    if merge:
        return merge_overlapping(rows, [k for k in keys if k in rows.columns])
    if need_exon:
        rows = keep_with_exon(rows)
    if as_text:
        rows = rows.withColumn("attribute", key_value_column(rows, [k for k in keys if k in rows.columns]))
    return rows
