"""Queries on cells and clonotypes, alignments and plot tables. Reads stand for contigs: a first mate is a TRA, a second a TRB sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.seqexpr import any_false, translate_dna
from strandloom.operators import aggregates as G
from strandloom.operators import align, clonotypes, fuzzy, reads
from strandloom.operators.annotation import with_attributes
from strandloom.plans import plotdata
from strandloom.plans.read_queries import _AA, _MATCH, _PAIRS, _pairs, _refs, _seq_pairs
from strandloom.plans.annotation_queries import _R
from strandloom.session import cut_lineage, table
from strandloom.sources.files import in_ranges


def _cells(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").where("sample is not null and length(seq) >= 3")
    r = r.select("sample", F.col("read_ind").alias("barcode"), F.when(F.col("mate") == "r1", "TRA").otherwise("TRB").alias("chain"), "seq").distinct()
    # never null, as optimizers know by the coalesce: else a later check for nulls translates all a second time
    return r.select("sample", "barcode", "chain", F.coalesce(translate_dna("seq"), F.lit("")).alias("cdr3")).distinct()


def cells_wide(spark: SparkSession, d: str) -> DataFrame:
    return clonotypes.wide_cells(_cells(spark, d))


def cells_plausible(spark: SparkSession, d: str) -> DataFrame:
    return clonotypes.plausible_cells(clonotypes.wide_cells(_cells(spark, d)))


def cells_nested(spark: SparkSession, d: str) -> DataFrame:
    return clonotypes.nested_cells(_cells(spark, d)).select("sample", "barcode", F.size("data").cast("bigint").alias("n"), F.col("data")[0]["cdr3"].alias("first_cdr3"))


def cells_named(spark: SparkSession, d: str) -> DataFrame:
    return clonotypes.name_clonotypes(_cells(spark, d))


def clonotype_levels(spark: SparkSession, d: str) -> DataFrame:
    return clonotypes.clonotype_levels(clonotypes.name_clonotypes(_cells(spark, d)))


def cells_collapsed_once(spark: SparkSession, d: str) -> DataFrame:
    w = clonotypes.wide_cells(_cells(spark, d)).withColumn("cl_name", F.md5(F.concat_ws("|", F.coalesce("cdr3_TRA", F.lit("NA")), F.coalesce("cdr3_TRB", F.lit("NA")))))
    return clonotypes.collapse_clonotypes(w, ["cdr3_TRB", "sample"])


def sample_pivot(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").where("sample is not null")
    return G.pivot_columns(r, ["sample"], "mate", ["r1", "r2"], {"n": F.count("read_ind"), "longest": F.max(F.length("seq"))})


def sample_unpivot(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("sample", "patient", F.col("replicate").cast("string").alias("replicate"), "fluid")
    return G.unpivot_non_null(s, ["sample"], ["patient", "replicate", "fluid"], "field", "value")


def sample_collapsed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    return s.groupBy("patient").agg(
        G.collapse(F.col("fluid"), F.col("sample")).alias("fluids"), G.collapse(F.col("fluid"), ordered=True).alias("sorted_fluids"), G.collapse(F.col("fluid"), F.col("sample"), unique=True).alias("fluid_or_all"),
        G.distinct_with_null(F.col("fluid")).alias("n_fluids"), G.most_frequent(F.col("fluid")).alias("usual_fluid"),
    )


def events_first_mode(spark: SparkSession, d: str) -> DataFrame:
    return G.first_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id", "usual")


def events_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.consecutive_runs(table(spark, d, "events"), ["user_id"], "event_id")


def gtf_ranked(spark: SparkSession, d: str) -> DataFrame:
    return G.with_rank(table(spark, d, "gtf"), "line_no", "place", ["seqname"]).select("line_no", "seqname", "place")


def gtf_unique_names(spark: SparkSession, d: str) -> DataFrame:
    return G.make_unique(table(spark, d, "gtf").select("line_no", "source").where("source is not null"), "source", "line_no", "name").select("line_no", "name")


def reads_constant(spark: SparkSession, d: str) -> DataFrame:
    return G.constant_columns(table(spark, d, "reads"), ["read_ind"], ["sample", "seq", "qual"])


def samples_coalesced(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "samples")
    left = raw.select("sample", F.when(F.col("replicate") > 1, F.col("fluid")).alias("fluid"))
    return G.coalesce_join(left, raw.select("sample", "fluid", "patient"), ["sample"])


def documents_joined(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return G.join_many({c: docs.where(f"{c} is not null").select("doc_id", F.col(c).alias("value")) for c in ("lang", "author", "source")}, ["doc_id"], "value")


def pairs_full_join(spark: SparkSession, d: str) -> DataFrame:
    """First and second mates of each read as two tables, fully joined."""
    p = table(spark, d, "reads").where("read_ind is not null")
    side = lambda m: p.where(F.col("mate") == m).groupBy("read_ind").agg(F.max("seq").alias(f"{m}_seq"))
    return side("r1").join(side("r2"), "read_ind", "full")


def aligned_mates(spark: SparkSession, d: str) -> DataFrame:
    return align.align_columns(_pairs(spark, d), ["read_ind"], "r1_seq", "r2_seq")


def aligned_local(spark: SparkSession, d: str) -> DataFrame:
    return align.align_columns(_pairs(spark, d), ["read_ind"], "r1_seq", "r2_seq", mode="local", gap_open=-10, gap_extend=-4, match=1, mismatch=-3)


def aligned_positions(spark: SparkSession, d: str) -> DataFrame:
    """All first mates of a read in the frame of the second."""
    done = align.align_columns(_seq_pairs(spark, d), ["read_ind", "r2_seq"], "r1_seq", "r2_seq").withColumn("name", F.lit("r1"))
    return align.multi_alignment(done, "r2_seq", ["read_ind"], "name")


def printed_mates(spark: SparkSession, d: str) -> DataFrame:
    done = aligned_mates(spark, d).where("first_aligned is not null and second_aligned is not null")
    return plotdata.printed_alignment(done, ["read_ind"], "first_aligned", "second_aligned", 60)


def plot_rows(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gtf").where("feature = 'gene' and seqname is not null and start <= end").select("seqname", "line_no", "start", "end")
    return plotdata.pack_rows(g, ["seqname"], "start", "end", 10)


def plot_references(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.reads_per_reference(reads.match_pairs(_pairs(spark, d), _refs(spark, d), 0), 1, 5)


def plot_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines the genes of each sequence need, and how many of them overlap on one line: none."""
    placed = plot_rows(spark, d)
    before = F.lag("end").over(Window.partitionBy("seqname", "y").orderBy("start", "end"))
    return placed.withColumn("_close", (F.col("start") <= before + 10).cast("int")).groupBy("seqname").agg(F.max("y").alias("n_lines"), F.coalesce(F.sum("_close"), F.lit(0)).alias("n_close"))


def aligned_checked(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of the mates checked: they have one length, without gaps they are the sequences, and their columns give their score (null where a sequence holds ``-`` itself)."""
    p = _pairs(spark, d)
    done = align.align_columns(p, ["read_ind", "r1_seq", "r2_seq"], "r1_seq", "r2_seq").where("score is not null")
    plain = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    inner = lambda c: F.length(F.col(c)) - F.length(F.ltrim(F.col(c), F.lit("-"))), lambda c: F.length(F.rtrim(F.col(c), F.lit("-")))
    first = F.greatest(inner[0]("first_aligned"), inner[0]("second_aligned"))
    last = F.least(inner[1]("first_aligned"), inner[1]("second_aligned"))
    cut = lambda c: F.split(F.substr(F.col(c), first + 1, F.greatest(last - first, F.lit(0))), "")
    points = F.aggregate(F.zip_with(cut("first_aligned"), cut("second_aligned"), lambda x, y: F.when(x == "", 0).when(x == y, 1).otherwise(-1)), F.lit(0), lambda a, x: a + x)
    return done.select(
        "read_ind", ((plain("first_aligned") == plain("r1_seq")) & (plain("second_aligned") == plain("r2_seq"))).alias("whole"),
        F.when(~F.col("r1_seq").contains("-") & ~F.col("r2_seq").contains("-"), points == F.col("score")).alias("scored"), (F.length("first_aligned") == F.length("second_aligned")).alias("even")
    )


def consensus_joined(spark: SparkSession, d: str) -> DataFrame:
    """Tables of consensus rows, their sequences and references, all kept, and the contigs that point to them."""
    r = table(spark, d, "reads").where("sample is not null and read_ind is not null and seq is not null")
    side = lambda m, k: r.where(f"mate = '{m}' and read_ind % {k} <> 0").groupBy("sample", F.col("read_ind").alias("consensus_id")).agg(F.max("seq").alias("seq"))
    notes = r.where("read_ind % 5 <> 0").groupBy("sample", F.col("read_ind").alias("consensus_id")).agg(F.count("*").alias("n"))
    return clonotypes.consensus_table(notes, side("r1", 3), side("r2", 2))


def contigs_joined(spark: SparkSession, d: str) -> DataFrame:
    """Contigs with their consensus; null ids meet null ids."""
    r = table(spark, d, "reads").where("read_ind is not null")
    contigs = r.where("mate = 'r1'").groupBy("sample", F.col("read_ind").alias("contig_id")).agg(F.max("seq").alias("seq")).withColumn("clonotype_id", F.col("contig_id") % 50).withColumn("consensus_id", F.when(F.col("contig_id") % 7 > 0, F.col("contig_id") % 7))
    consensus = r.withColumn("clonotype_id", F.col("read_ind") % 50).withColumn("consensus_id", F.when(F.col("read_ind") % 7 > 0, F.col("read_ind") % 7)).groupBy("sample", "clonotype_id", "consensus_id").agg(F.max("seq").alias("consensus_seq"))
    return clonotypes.contigs_with_consensus(contigs, consensus)


def names_changed(spark: SparkSession, d: str) -> DataFrame:
    """How cells move from the names of their pairs to those of one pass."""
    before = clonotypes.wide_cells(_cells(spark, d)).withColumn("cl_name", F.md5(F.concat_ws("|", F.coalesce("cdr3_TRA", F.lit("NA")), F.coalesce("cdr3_TRB", F.lit("NA")))))
    return clonotypes.name_changes(before, clonotypes.collapse_clonotypes(before, ["cdr3_TRB", "sample"]))


def samples_any_false(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads")
    return r.groupBy("sample", "mate").agg(any_false(F.length("seq") >= 10).alias("all_long"), any_false(F.when(F.col("seq") == "", F.lit(True))).alias("none_known"))


def names_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The names of genes nearest to each gene's name with its last letter changed."""
    names = cut_lineage(with_attributes(table(spark, d, "gtf").drop("exon_number"), ["gene_name"]).select("gene_name").where("gene_name is not null").distinct())  # read on both sides, and the attributes are dear to parse
    asked = names.select(F.concat(F.col("gene_name"), F.lit("x")).alias("asked"))
    return fuzzy.nearest_names(asked, names, "asked", "gene_name")


def reads_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """First mates as alignments, with a deletion and a skipped stretch, that overlap ranges of their sample."""
    r = _reads_placed(spark, d)
    return in_ranges(r, [("a", 100, 140), ("a", 130, 131), ("b", 1, 60)]).select("read_ind", "pos", "genomic_range")


def _reads_placed(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).where("length(r1_seq) >= 10")
    cigar = F.concat(F.lit("3S4M2D5N"), (F.length("r1_seq") - 7).cast("string"), F.lit("M1H"))
    return p.select("read_ind", F.when(F.col("read_ind") % 3 == 0, "a").when(F.col("read_ind") % 3 == 1, "b").alias("rname"), (F.col("read_ind") % 200 + 1).cast("int").alias("pos"), cigar.alias("cigar"))


def names_picked(spark: SparkSession, d: str) -> DataFrame:
    return clonotypes.pick_names(500, spark, avoid=["Baba"], forbidden="z").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_distinct"))


QUERIES = {
    f.__name__: f
    for f in (
        cells_wide, cells_plausible, cells_nested, cells_named, clonotype_levels, cells_collapsed_once, sample_pivot, sample_unpivot, sample_collapsed, events_first_mode, events_runs, gtf_ranked, gtf_unique_names,
        reads_constant, samples_coalesced, documents_joined, pairs_full_join, aligned_mates, aligned_local, aligned_positions, printed_mates, plot_rows, plot_references, names_picked,
        plot_lines, aligned_checked, consensus_joined, contigs_joined, names_changed, samples_any_false, names_nearest, reads_in_ranges,
    )
}

_CELLS = f"""
c AS (SELECT DISTINCT sample, read_ind AS barcode, CASE WHEN mate = 'r1' THEN 'TRA' ELSE 'TRB' END AS chain, {_AA.format(x='seq')} AS cdr3 FROM reads WHERE sample IS NOT NULL AND length(seq) >= 3),
w AS (SELECT sample, barcode, string_agg(cdr3, ',' ORDER BY cdr3) FILTER (chain = 'TRA') AS "cdr3_TRA", string_agg(cdr3, ',' ORDER BY cdr3) FILTER (chain = 'TRB') AS "cdr3_TRB" FROM c WHERE barcode IS NOT NULL GROUP BY 1, 2)"""


def _pass_sql(before: str, after: str, split: list[str]) -> str:
    key = " || '_' || ".join(f"coalesce(\"{c}\", 'NA')" for c in split)
    other = [c for c in ("cdr3_TRB", "cdr3_TRA") if c not in split]
    rule = "true"
    if other:
        o = f'"{other[0]}"'
        n, na, multi = f"count(DISTINCT {o})", f"bool_or({o} IS NULL)", f"count(DISTINCT CASE WHEN contains({o}, ',') THEN {o} END)"
        rule = f"{n} <= 1 OR ({na} AND {n} IN (2, 3) AND {multi} = 1 AND len(list_distinct(string_split(string_agg(DISTINCT {o}, ','), ','))) = 2)"
    return f"""{after}_k AS MATERIALIZED (SELECT *, {key} AS k FROM {before}), {after}_g AS MATERIALIZED (SELECT k, min(cl_name) AS f FROM {after}_k WHERE NOT contains(k, 'NA_NA') GROUP BY k HAVING count(DISTINCT cl_name) > 1 AND ({rule})),
{after} AS MATERIALIZED (SELECT * EXCLUDE (k, f, cl_name), coalesce(f, cl_name) AS cl_name FROM {after}_k LEFT JOIN {after}_g USING (k))"""


_START = """n0 AS (SELECT *, split_part(sample, '_', 1) AS patient, split_part(sample, '_', 2) AS replicate, split_part(sample, '_', 3) AS body_fluid, md5(coalesce("cdr3_TRA", 'NA') || '|' || coalesce("cdr3_TRB", 'NA')) AS cl_name FROM w)"""
_NAMED = f"""{_CELLS}, {_START}, {', '.join(_pass_sql(f'n{i}', f'n{i + 1}', s) for i, s in enumerate(clonotypes.PASSES))},
s AS (SELECT cl_name, bool_or("cdr3_TRA" IS NULL OR "cdr3_TRB" IS NULL) AS o FROM n9 GROUP BY 1 HAVING count(DISTINCT patient) > 1),
named AS (SELECT sample, patient, replicate, body_fluid, barcode, "cdr3_TRA", "cdr3_TRB", CASE WHEN o THEN md5('patient|' || cl_name || '|' || patient) WHEN NOT o THEN md5('shared|' || cl_name) ELSE cl_name END AS cl_name FROM n9 LEFT JOIN s USING (cl_name))"""

_BY_READ = "FROM reads WHERE sample IS NOT NULL AND read_ind IS NOT NULL AND seq IS NOT NULL"
_IDS = "read_ind % 50 AS clonotype_id, CASE WHEN read_ind % 7 > 0 THEN read_ind % 7 END AS consensus_id"

ORACLES = {
    "plot_lines": """WITH g AS (SELECT seqname, "start" AS s, "end" AS e FROM gtf WHERE feature = 'gene' AND seqname IS NOT NULL AND "start" <= "end"),
        x AS (SELECT seqname, s AS p, 1 AS d FROM g UNION ALL SELECT seqname, e + 11, -1 FROM g), y AS (SELECT seqname, p, sum(d) AS d FROM x GROUP BY 1, 2),
        z AS (SELECT seqname, sum(d) OVER (PARTITION BY seqname ORDER BY p) AS depth FROM y) SELECT seqname, CAST(max(depth) AS INTEGER) AS n_lines, CAST(0 AS BIGINT) AS n_close FROM z GROUP BY 1""",
    "aligned_checked": f"WITH {_PAIRS} SELECT read_ind, true AS whole, CASE WHEN NOT contains(r1_seq, '-') AND NOT contains(r2_seq, '-') THEN true END AS scored, true AS even FROM p WHERE r1_seq IS NOT NULL AND r2_seq IS NOT NULL",
    "consensus_joined": f"""WITH n AS (SELECT sample, read_ind AS consensus_id, count(*) AS n {_BY_READ} AND read_ind % 5 <> 0 GROUP BY 1, 2), a AS (SELECT sample, read_ind AS consensus_id, max(seq) AS consensus_seq {_BY_READ} AND mate = 'r1' AND read_ind % 3 <> 0 GROUP BY 1, 2),
        b AS (SELECT sample, read_ind AS consensus_id, max(seq) AS reference_seq {_BY_READ} AND mate = 'r2' AND read_ind % 2 <> 0 GROUP BY 1, 2) SELECT * FROM n FULL JOIN a USING (sample, consensus_id) FULL JOIN b USING (sample, consensus_id)""",
    "contigs_joined": f"""WITH a AS (SELECT sample, read_ind AS contig_id, {_IDS}, max(seq) AS seq FROM reads WHERE read_ind IS NOT NULL AND mate = 'r1' GROUP BY 1, 2, 3, 4),
        b AS (SELECT sample AS s, read_ind % 50 AS c, CASE WHEN read_ind % 7 > 0 THEN read_ind % 7 END AS i, max(seq) AS consensus_seq FROM reads WHERE read_ind IS NOT NULL GROUP BY 1, 2, 3)
        SELECT a.*, consensus_seq FROM a LEFT JOIN b ON a.sample IS NOT DISTINCT FROM s AND a.clonotype_id IS NOT DISTINCT FROM c AND a.consensus_id IS NOT DISTINCT FROM i""",
    "names_changed": f"""WITH {_CELLS}, a0 AS (SELECT *, md5(coalesce("cdr3_TRA", 'NA') || '|' || coalesce("cdr3_TRB", 'NA')) AS cl_name FROM w), {_pass_sql('a0', 'a1', ['cdr3_TRB', 'sample'])}
        SELECT a0.cl_name AS old_name, a1.cl_name AS new_name, count(*) AS n_cells FROM a0 JOIN a1 USING (sample, barcode) GROUP BY 1, 2""",
    "samples_any_false": "SELECT sample, mate, coalesce(bool_and(length(seq) >= 10), true) AS all_long, true AS none_known FROM reads GROUP BY 1, 2",
    "names_nearest": f"""WITH {_R}, n AS (SELECT DISTINCT gene_name, regexp_extract(lower(gene_name), '^[a-z]+[0-9]+', 0) AS p FROM r WHERE gene_name IS NOT NULL), q AS (SELECT gene_name || 'x' AS asked, regexp_extract(lower(gene_name || 'x'), '^[a-z]+[0-9]+', 0) AS p FROM n),
        s AS (SELECT asked, gene_name, CAST(levenshtein(lower(asked), lower(gene_name)) AS INTEGER) AS lv, min(levenshtein(lower(asked), lower(gene_name))) OVER (PARTITION BY asked) AS least FROM q JOIN n USING (p)) SELECT asked, gene_name, lv FROM s WHERE lv = least""",
    "reads_in_ranges": f"""WITH {_PAIRS}, a AS (SELECT read_ind, CASE read_ind % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS rname, CAST(read_ind % 200 + 1 AS INTEGER) AS pos, read_ind % 200 + 1 + 4 + 2 + 5 + length(r1_seq) - 7 - 1 AS e FROM p WHERE length(r1_seq) >= 10)
        SELECT read_ind, pos, g AS genomic_range FROM a JOIN (VALUES ('a', 100, 140, 'a:100-140'), ('a', 130, 131, 'a:130-131'), ('b', 1, 60, 'b:1-60')) v(n, f, l, g) ON rname = n AND pos <= l AND e >= f""",
    "cells_wide": f"WITH {_CELLS} SELECT * FROM w",
    "cells_plausible": f"""WITH {_CELLS} SELECT * FROM w WHERE coalesce(len(string_split("cdr3_TRB", ',')), 0) <= 1 AND coalesce(len(string_split("cdr3_TRA", ',')), 0) <= 2""",
    "cells_nested": f"WITH {_CELLS} SELECT sample, barcode, count(*) AS n, arg_min(cdr3, chain || cdr3) AS first_cdr3 FROM c GROUP BY 1, 2",
    "cells_named": f"WITH {_NAMED} SELECT * FROM named",
    "clonotype_levels": f"""WITH {_NAMED} SELECT cl_name, count(*) AS n_cells, count(DISTINCT sample) AS n_samples, count(DISTINCT patient) AS n_patients, count(DISTINCT "cdr3_TRA") + max(CAST("cdr3_TRA" IS NULL AS INTEGER)) AS n_tra,
        count(DISTINCT "cdr3_TRB") + max(CAST("cdr3_TRB" IS NULL AS INTEGER)) AS n_trb, count(DISTINCT coalesce("cdr3_TRA", 'NA') || '|' || coalesce("cdr3_TRB", 'NA')) AS n_pairs FROM named GROUP BY 1""",
    "cells_collapsed_once": f"""WITH {_CELLS}, a0 AS (SELECT *, md5(coalesce("cdr3_TRA", 'NA') || '|' || coalesce("cdr3_TRB", 'NA')) AS cl_name FROM w), {_pass_sql('a0', 'a1', ['cdr3_TRB', 'sample'])} SELECT * FROM a1""",
    "sample_pivot": """SELECT sample, count(read_ind) FILTER (mate = 'r1') AS n_r1, CAST(max(length(seq)) FILTER (mate = 'r1') AS INTEGER) AS longest_r1, count(read_ind) FILTER (mate = 'r2') AS n_r2, CAST(max(length(seq)) FILTER (mate = 'r2') AS INTEGER) AS longest_r2
        FROM reads WHERE sample IS NOT NULL GROUP BY 1""",
    "sample_unpivot": "SELECT sample, 'patient' AS field, patient AS value FROM samples UNION ALL SELECT sample, 'replicate', CAST(replicate AS VARCHAR) FROM samples UNION ALL SELECT sample, 'fluid', fluid FROM samples",
    "sample_collapsed": """WITH m AS (SELECT patient, fluid, row_number() OVER (PARTITION BY patient ORDER BY count(*) DESC, fluid) AS k FROM samples GROUP BY 1, 2)
        SELECT patient, string_agg(fluid, ',' ORDER BY sample) AS fluids, string_agg(fluid, ',' ORDER BY fluid) AS sorted_fluids, CASE WHEN count(DISTINCT fluid) = 1 THEN min(fluid) ELSE string_agg(fluid, ',' ORDER BY sample) END AS fluid_or_all,
        count(DISTINCT fluid) AS n_fluids, (SELECT fluid FROM m WHERE m.patient = s.patient AND k = 1) AS usual_fluid FROM samples s GROUP BY 1""",
    "events_first_mode": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
        SELECT user_id, event_type AS usual FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""",
    "events_runs": """WITH d AS (SELECT DISTINCT user_id, event_id FROM events WHERE event_id IS NOT NULL), i AS (SELECT *, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM d)
        SELECT user_id, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS n FROM i GROUP BY user_id, g""",
    "gtf_ranked": "SELECT line_no, seqname, row_number() OVER (PARTITION BY seqname ORDER BY line_no) AS place FROM gtf",
    "gtf_unique_names": "SELECT line_no, CASE WHEN k = 1 THEN source ELSE source || '.' || (k - 1) END AS name FROM (SELECT line_no, source, row_number() OVER (PARTITION BY source ORDER BY line_no) AS k FROM gtf WHERE source IS NOT NULL)",
    "reads_constant": f"""SELECT read_ind, {', '.join(f"CASE WHEN count(DISTINCT {c}) = 1 THEN max({c}) END AS {c}" for c in ('sample', 'seq', 'qual'))} FROM reads GROUP BY 1""",
    "samples_coalesced": "SELECT sample, fluid, patient FROM samples",
    "documents_joined": "SELECT doc_id, max(lang) AS lang, max(author) AS author, max(source) AS source FROM documents WHERE lang IS NOT NULL OR author IS NOT NULL OR source IS NOT NULL GROUP BY 1",
    "pairs_full_join": "WITH a AS (SELECT read_ind, max(seq) AS r1_seq FROM reads WHERE mate = 'r1' AND read_ind IS NOT NULL GROUP BY 1), b AS (SELECT read_ind, max(seq) AS r2_seq FROM reads WHERE mate = 'r2' AND read_ind IS NOT NULL GROUP BY 1) SELECT * FROM a FULL JOIN b USING (read_ind)",
    "plot_references": f"WITH {_MATCH} SELECT ref_name, ref_ind, count(*) AS n_reads FROM m GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 5",
    "names_picked": "SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS n_distinct",
}
