"""Queries over the annotation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import annotation as A
from strandloom.session import table

KEYS = ["gene_id", "gene_name", "transcript_id", "exon_number", "tag"]


def _gtf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gtf").drop("exon_number")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return A.with_attributes(_gtf(spark, d), KEYS)


def gtf_attributes(spark: SparkSession, d: str) -> DataFrame:
    return A.attributes_long(_gtf(spark, d))


def gtf_wide(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d)


def gtf_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_rows(_gtf(spark, d), ["chr1", "chr2"], ["exon", "gene"], ["Vimvim1", "borpik2", "Zabpik4", "Pikdal19", "murrus17", "Rusgor20"]).select("line_no", *A.CORE)


def gtf_relabel(spark: SparkSession, d: str) -> DataFrame:
    return A.relabel_features(_gtf(spark, d), remove_exons=True, to_exon=["CDS"], exons_only=True).select("line_no", "feature")


def gtf_rename(spark: SparkSession, d: str) -> DataFrame:
    return A.with_attributes(_gtf(spark, d), ["gene_id", "gene_name"], {"gene_id": "locus", "transcript_id": "gene_name"}).select("line_no", "gene_id", "gene_name", "locus")


def gtf_with_exon(spark: SparkSession, d: str) -> DataFrame:
    return A.keep_with_exon(_rows(spark, d)).select("line_no", "feature", "gene_id", "transcript_id")


def gtf_filled_names(spark: SparkSession, d: str) -> DataFrame:
    filled = A.fill_gene_names(_rows(spark, d))
    return filled.select("line_no", "gene_id", "gene_name", A.clean_names(F.col("gene_name"), "g-").alias("clean_name"))


def gtf_fixed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return A.fix_duplicate_names(_rows(spark, d)).select("line_no", "gene_id", "gene_name")


def gtf_fixed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Gene names, gene ids and transcript ids, each made unique by the one it belongs to."""
    return A.fix_duplicates(_rows(spark, d)).select("line_no", "gene_id", "gene_name", "transcript_id")


def gtf_aggregated_exons(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate_exons(_rows(spark, d))


def gtf_gene_spans(spark: SparkSession, d: str) -> DataFrame:
    return A.gene_spans(_rows(spark, d))


def gtf_merged_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_overlapping(_rows(spark, d).where("feature = 'exon'"), ["gene_id", "transcript_id"])


def gtf_introns(spark: SparkSession, d: str) -> DataFrame:
    return A.introns(_rows(spark, d))


def gtf_exon_sums(spark: SparkSession, d: str) -> DataFrame:
    return A.exon_sums(_rows(spark, d)).withColumn("codon_cumsum", F.round("codon_cumsum", 6))


def gtf_best_cuts(spark: SparkSession, d: str) -> DataFrame:
    return A.best_cuts(_rows(spark, d))


def gtf_wrapped_genes(spark: SparkSession, d: str) -> DataFrame:
    return A.wrapped_genes(_rows(spark, d).withColumn("exon_number", F.expr("try_cast(exon_number as bigint)")))


def gtf_rotated(spark: SparkSession, d: str) -> DataFrame:
    """Circles of 100 million positions, or longer ones where the rows of a sequence end behind that."""
    good = _gtf(spark, d).where("start is not null and end is not null and start <= end")
    return A.rotate_rows(A.with_circle(good, 100_000_000), 1_000_001, F.col("circle")).select("line_no", "seqname", "start", "end", "part")


def gtf_key_values(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("line_no", A.key_value_column(_rows(spark, d), KEYS[:3]).alias("attribute"))


def gtf_coverage_runs(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage_runs(_gtf(spark, d).where("feature = 'exon'"))


def gtf_rebased(spark: SparkSession, d: str) -> DataFrame:
    return A.rebase_to_gene(_rows(spark, d), 10, 10).select("line_no", "gene_id", "cut_start", "cut_end", "new_start", "new_end")


def gtf_prepared(spark: SparkSession, d: str) -> DataFrame:
    """Names filled, cleaned and made unique, rows without an exon dropped, keys written as text."""
    return A.prepare_annotation(_gtf(spark, d), KEYS[:3], to_exon=["CDS"], need_exon=True, as_text=True).select("line_no", "feature", "gene_name", "attribute")


QUERIES = {
    f.__name__: f
    for f in (
        gtf_attributes, gtf_wide, gtf_filter, gtf_relabel, gtf_rename, gtf_with_exon, gtf_filled_names, gtf_fixed_duplicates, gtf_fixed_ids, gtf_aggregated_exons, gtf_gene_spans,
        gtf_merged_overlaps, gtf_introns, gtf_exon_sums, gtf_best_cuts, gtf_wrapped_genes, gtf_rotated, gtf_key_values, gtf_coverage_runs, gtf_rebased, gtf_prepared,
    )
}

_ITEMS = "list_filter(string_split(regexp_replace(trim(attribute), ';$', ''), '; '), lambda s: trim(s) <> '')"
_KV = "list_transform({items}, lambda s: struct_pack(k := split_part(trim(s), ' ', 1), v := replace(CASE WHEN strpos(trim(s), ' ') > 0 THEN substr(trim(s), strpos(trim(s), ' ') + 1) ELSE '' END, '\"', '')))".format(items=_ITEMS)


def _key(k: str, name: str | None = None) -> str:
    own = f"list_filter(a, lambda s: s.k = '{k}')"
    return f"CASE WHEN len({own}) > 0 THEN array_to_string(list_transform({own}, lambda s: s.v), '__') END AS {name or k}"


def _unique(before: str, after: str, name: str, owner: str) -> str:
    """CTE ``after``: the rows of ``before`` with the names that several owners share numbered by the owners' first lines."""
    return f"""{after}_q AS (SELECT {name} AS qn, {owner} AS qo, min(line_no) AS f FROM {before} WHERE {name} IS NOT NULL AND {owner} IS NOT NULL GROUP BY 1, 2),
        {after}_k AS (SELECT *, count(*) OVER (PARTITION BY qn) AS c, row_number() OVER (PARTITION BY qn ORDER BY f, qo) AS k FROM {after}_q),
        {after} AS (SELECT r.* REPLACE (CASE WHEN k.c > 1 THEN r.{name} || '--' || k.k ELSE r.{name} END AS {name}) FROM {before} r LEFT JOIN {after}_k k ON r.{name} = k.qn AND r.{owner} = k.qo)"""


_FIXED = ", ".join(_unique(f"{'r' if i == 0 else f'u{i}'}", f"u{i + 1}", n, o) for i, (n, o) in enumerate((("gene_name", "gene_id"), ("gene_id", "gene_name"), ("transcript_id", "gene_id"))))

_P = f"p AS (SELECT line_no, seqname, source, feature, \"start\", \"end\", score, strand, frame, attribute, {_KV} AS a FROM gtf)"
_R = f"{_P}, r AS (SELECT line_no, seqname, source, feature, \"start\", \"end\", score, strand, frame, {', '.join(map(_key, KEYS))} FROM p)"
_GOOD = 'seqname IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND "start" <= "end"'
_SPANS = f'sp AS (SELECT seqname, gene_id, min("start") AS s, max("end") AS e FROM r WHERE gene_id IS NOT NULL AND {_GOOD} GROUP BY 1, 2)'
_MODE = "(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM x y WHERE y.transcript_id = x.transcript_id AND {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
_EX = f"ex AS (SELECT DISTINCT transcript_id, seqname, strand, \"start\" AS s, \"end\" AS e FROM r WHERE feature = 'exon' AND transcript_id IS NOT NULL AND \"start\" IS NOT NULL AND \"end\" IS NOT NULL AND \"start\" <= \"end\")"


def _mode(c: str) -> str:
    return f"m_{c} AS (SELECT transcript_id, {c} FROM (SELECT transcript_id, {c}, row_number() OVER (PARTITION BY transcript_id ORDER BY count(*) DESC, {c}) AS k FROM x WHERE {c} IS NOT NULL GROUP BY 1, 2) WHERE k = 1)"


_MODES = ("seqname", "source", "strand", "gene_id", "gene_name")
_ISLANDS = """
m AS (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM x),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY s, e, line_no ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


def _list_of(c: str) -> str:
    return f"t_{c} AS (SELECT seqname, island, string_agg({c}, '---' ORDER BY f) AS {c} FROM (SELECT seqname, island, {c}, min(line_no) AS f FROM g WHERE {c} IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"


ORACLES = {
    "gtf_prepared": f"""WITH {_R}, c AS (SELECT gene_id, gene_name, row_number() OVER (PARTITION BY gene_id ORDER BY count(*) DESC, gene_name) AS k FROM r WHERE gene_name IS NOT NULL AND gene_id IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT line_no, CASE WHEN feature = 'CDS' THEN 'exon' ELSE feature END AS feature, r.gene_id, transcript_id, regexp_replace(regexp_replace(coalesce(r.gene_name, c.gene_name), '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS gene_name FROM r LEFT JOIN c ON r.gene_id = c.gene_id AND c.k = 1),
        {_FIXED.replace("FROM r WHERE", "FROM f WHERE").replace("FROM r r", "FROM f r")}, n AS (SELECT * FROM u3),
        e AS (SELECT transcript_id, gene_id FROM n WHERE feature = 'exon' AND transcript_id IS NOT NULL)
        SELECT line_no, feature, gene_name, 'gene_id "' || coalesce(gene_id, 'NA') || '"; gene_name "' || coalesce(gene_name, 'NA') || '"; transcript_id "' || coalesce(transcript_id, 'NA') || '"; ' AS attribute FROM n
        WHERE feature IS DISTINCT FROM 'gene' AND transcript_id IN (SELECT transcript_id FROM e) OR feature = 'gene' AND gene_id IN (SELECT gene_id FROM e WHERE gene_id IS NOT NULL)""",
    "gtf_attributes": f"WITH {_P} SELECT line_no, CAST(pos AS BIGINT) AS pos, x.k AS attribute, x.v AS value FROM (SELECT line_no, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS pos FROM p)",
    "gtf_wide": f"WITH {_R} SELECT * FROM r",
    "gtf_filter": """SELECT line_no, seqname, source, feature, "start", "end", score, strand, frame FROM gtf WHERE seqname IN ('chr1', 'chr2') AND feature IN ('exon', 'gene')
        AND regexp_matches(attribute, '(?i)"vimvim1"|"borpik2"|"zabpik4"|"pikdal19"|"murrus17"|"rusgor20"')""",
    "gtf_relabel": "SELECT line_no, 'exon' AS feature FROM gtf WHERE feature = 'CDS'",
    "gtf_rename": f"WITH {_P} SELECT line_no, {_key('gene_id')}, {_key('transcript_id', 'gene_name')}, {_key('gene_id', 'locus')} FROM p",
    "gtf_with_exon": f"""WITH {_R}, e AS (SELECT transcript_id, gene_id FROM r WHERE feature = 'exon' AND transcript_id IS NOT NULL)
        SELECT line_no, feature, gene_id, transcript_id FROM r WHERE feature IS DISTINCT FROM 'gene' AND transcript_id IN (SELECT transcript_id FROM e)
        OR feature = 'gene' AND gene_id IN (SELECT gene_id FROM e WHERE gene_id IS NOT NULL)""",
    "gtf_filled_names": f"""WITH {_R}, c AS (SELECT gene_id, gene_name, row_number() OVER (PARTITION BY gene_id ORDER BY count(*) DESC, gene_name) AS k FROM r WHERE gene_name IS NOT NULL AND gene_id IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT line_no, r.gene_id, coalesce(r.gene_name, c.gene_name) AS gene_name FROM r LEFT JOIN c ON r.gene_id = c.gene_id AND c.k = 1)
        SELECT *, 'g-' || regexp_replace(regexp_replace(gene_name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS clean_name FROM f""",
    "gtf_fixed_duplicates": f"""WITH {_R}, q AS (SELECT gene_name, gene_id, min(line_no) AS f FROM r WHERE gene_name IS NOT NULL AND gene_id IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT *, count(*) OVER (PARTITION BY gene_name) AS c, row_number() OVER (PARTITION BY gene_name ORDER BY f, gene_id) AS k FROM q)
        SELECT line_no, r.gene_id, CASE WHEN k.c > 1 THEN r.gene_name || '--' || k.k ELSE r.gene_name END AS gene_name FROM r LEFT JOIN k ON r.gene_name = k.gene_name AND r.gene_id = k.gene_id""",
    "gtf_fixed_ids": f"WITH {_R}, {_FIXED} SELECT line_no, gene_id, gene_name, transcript_id FROM u3",
    "gtf_aggregated_exons": f"""WITH {_R}, x AS (SELECT * FROM r WHERE feature = 'exon' AND transcript_id IS NOT NULL), {', '.join(map(_mode, _MODES))},
        b AS (SELECT transcript_id, min("start") AS "start", max("end") AS "end", string_agg(CAST(line_no AS VARCHAR), '---' ORDER BY line_no) AS "index" FROM x GROUP BY 1)
        SELECT b.*, CAST(1 AS BIGINT) AS exon_number, {', '.join(_MODES)} FROM b {' '.join(f'LEFT JOIN m_{c} USING (transcript_id)' for c in _MODES)}""",
    "gtf_gene_spans": f'WITH {_R}, {_SPANS} SELECT seqname, gene_id, s AS "start", e AS "end" FROM sp',
    "gtf_merged_overlaps": f"""WITH {_R}, x AS (SELECT *, "start" AS s, "end" AS e FROM r WHERE feature = 'exon' AND {_GOOD}), {_ISLANDS}, {_list_of('gene_id')}, {_list_of('transcript_id')},
        b AS (SELECT seqname, island, min(s) AS "start", max(e) AS "end", CASE WHEN count(DISTINCT strand) = 1 THEN max(strand) ELSE '+' END AS strand, count(*) AS n FROM g GROUP BY 1, 2)
        SELECT b.seqname, b."start", b."end", b.strand, coalesce(t_gene_id.gene_id, '') AS gene_id, coalesce(t_transcript_id.transcript_id, '') AS transcript_id, b.n
        FROM b LEFT JOIN t_gene_id USING (seqname, island) LEFT JOIN t_transcript_id USING (seqname, island)""",
    "gtf_introns": f"""WITH {_R}, {_EX}, l AS (SELECT transcript_id, seqname, strand, e + 1 AS "start", lead(s) OVER (PARTITION BY transcript_id, seqname, strand ORDER BY s, e) - 1 AS "end" FROM ex)
        SELECT transcript_id, seqname, strand, CAST(row_number() OVER (PARTITION BY transcript_id, seqname, strand ORDER BY "start", "end") AS BIGINT) AS intron_no, "start", "end" FROM l WHERE "end" >= "start" """,
    "gtf_exon_sums": f"""WITH {_R}, {_EX}, o AS (SELECT *, CASE WHEN strand = '-' THEN -e ELSE s END AS al, e - s + 1 AS nt FROM ex),
        c AS (SELECT transcript_id, seqname, strand, row_number() OVER w AS exon_no, s AS "start", e AS "end", nt, CAST(sum(nt) OVER w AS BIGINT) AS nt_cumsum FROM o WINDOW w AS (PARTITION BY transcript_id, seqname, strand ORDER BY al, s, e ROWS UNBOUNDED PRECEDING))
        SELECT *, round(nt_cumsum / 3, 6) AS codon_cumsum, CAST(nt_cumsum % 3 AS VARCHAR) AS intron_phase FROM c""",
    "gtf_best_cuts": f"""WITH {_R}, {_SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
        b AS (SELECT seqname, min(s) AS lo, max(e) AS hi FROM sp GROUP BY 1),
        gaps AS (SELECT seqname, pm + 1 AS gs, s - pm - 1 AS n FROM m WHERE s > pm + 1 UNION ALL SELECT seqname, hi + 1, (hi + lo - 1) - hi + lo - 1 FROM b),
        k AS (SELECT *, row_number() OVER (PARTITION BY seqname ORDER BY n DESC, gs) AS k FROM gaps)
        SELECT k.seqname, gs AS gap_start, n AS gap_size, (((gs + gs + n - 1) // 2 - 1) % (hi + lo - 1)) + 1 AS cut FROM k JOIN b USING (seqname) WHERE k = 1""",
    "gtf_wrapped_genes": f"""WITH {_R}, e AS (SELECT *, TRY_CAST(exon_number AS BIGINT) AS en FROM r WHERE feature IN ('CDS', 'exon') AND gene_id IS NOT NULL AND TRY_CAST(exon_number AS BIGINT) IS NOT NULL AND "start" IS NOT NULL),
        c AS (SELECT gene_id, bool_or(feature = 'CDS') AS cds FROM e GROUP BY 1),
        s AS (SELECT e.gene_id, e.strand, e."start" - lag(e."start") OVER (PARTITION BY e.gene_id, e.transcript_id ORDER BY e.en, e.line_no) AS step FROM e JOIN c USING (gene_id) WHERE e.feature = CASE WHEN c.cds THEN 'CDS' ELSE 'exon' END)
        SELECT DISTINCT gene_id FROM s WHERE CASE WHEN strand = '-' THEN step > 0 ELSE step < 0 END""",
    "gtf_rotated": """WITH f AS (SELECT line_no, seqname, "start" AS a, "end" AS b, greatest(100000000, max("end") OVER (PARTITION BY seqname)) AS n FROM gtf WHERE "start" IS NOT NULL AND "end" IS NOT NULL AND "start" <= "end"),
        g AS (SELECT line_no, seqname, n, ((a - 1000001) % n + n) % n + 1 AS s, ((b - 1000001) % n + n) % n + 1 AS e FROM f)
        SELECT line_no, seqname, s AS "start", CASE WHEN s <= e THEN e ELSE n END AS "end", 1 AS part FROM g UNION ALL SELECT line_no, seqname, 1, e, 2 FROM g WHERE s > e""",
    "gtf_key_values": f"""WITH {_R} SELECT line_no, 'gene_id "' || coalesce(gene_id, 'NA') || '"; gene_name "' || coalesce(gene_name, 'NA') || '"; transcript_id "' || coalesce(transcript_id, 'NA') || '"; ' AS attribute FROM r""",
    "gtf_coverage_runs": f"""WITH x AS (SELECT seqname, "start" AS p, 1 AS d FROM gtf WHERE feature = 'exon' AND {_GOOD} UNION ALL SELECT seqname, "end" + 1, -1 FROM gtf WHERE feature = 'exon' AND {_GOOD}),
        s AS (SELECT seqname, p, sum(d) AS d FROM x GROUP BY 1, 2 HAVING sum(d) <> 0),
        c AS (SELECT seqname, p AS first, lead(p) OVER w - 1 AS last, CAST(sum(d) OVER w AS BIGINT) AS depth FROM s WINDOW w AS (PARTITION BY seqname ORDER BY p))
        SELECT * FROM c WHERE depth > 0""",
    "gtf_rebased": f"""WITH {_R}, {_SPANS} SELECT line_no, r.gene_id, greatest(s - 10, 1) AS cut_start, e + 10 AS cut_end, "start" - greatest(s - 10, 1) + 1 AS new_start, "end" - greatest(s - 10, 1) + 1 AS new_end
        FROM r JOIN sp ON r.seqname = sp.seqname AND r.gene_id = sp.gene_id""",
}
