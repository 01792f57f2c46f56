"""Queries on text forms, regions and transcripts. Documents stand for long sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.positions import rotate_sequence
from strandloom.functions.seqexpr import aa_property, parse_region, random_dna
from strandloom.operators import transcripts
from strandloom.operators.annotation import with_attributes
from strandloom.operators.positions import chunk_sequences, parse_ranges, regions_from_chunks, subsequences
from strandloom.sources.fasta import fasta_text, parse_records
from strandloom.sources.files import flatten_json
from strandloom.sources.gtf import gtf_line, harmonised_name
from strandloom.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("length(text) >= 1").select(F.col("doc_id").cast("string").alias("seqname"), F.col("text").alias("seq"))


def fasta_lines(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").where("seq is not null")
    return r.select("read_ind", "mate", fasta_text(F.concat_ws("_", F.col("read_ind").cast("string"), "mate"), F.col("seq")).alias("text"))


def gtf_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gtf").select("line_no", gtf_line().alias("text"))


def seqname_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gtf").where("seqname is not null").select("seqname").distinct().withColumn("name", harmonised_name(F.col("seqname")))


def region_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Regions written with thousands separators and read back."""
    g = table(spark, d, "gtf").where("seqname is not null and start is not null and end is not null")
    query = F.concat(F.col("seqname"), F.lit(":"), F.format_number("start", 0), F.lit("-"), F.format_number("end", 0))
    return g.select("line_no", parse_region(query).alias("r")).select("line_no", F.col("r.seqname").alias("seqname"), F.col("r.first").alias("first"), F.col("r.last").alias("last"))


def region_from_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    regions = docs.where("length(seq) >= 500").select("seqname", F.lit(100).cast("bigint").alias("start"), (F.length("seq") - 50).cast("bigint").alias("end"))
    return regions_from_chunks(regions, chunk_sequences(docs, 256), ["seqname"], 256).select(F.col("seqname").cast("bigint").alias("doc_id"), F.md5("seq").alias("seq_md5"))


def region_joined(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of each document, put together."""
    docs = _docs(spark, d)
    parts = docs.where("length(seq) >= 100").select("seqname", F.explode(F.array(F.struct(F.lit(11).alias("start"), F.lit(30).alias("end")), F.struct(F.lit(51).alias("start"), F.lit(90).alias("end")))).alias("x")).select("seqname", "x.*")
    return subsequences(parts.withColumn("doc_id", F.col("seqname").cast("bigint")), docs, ["doc_id"])


def circle_rotated(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reads").where("length(seq) >= 20")
    return r.select("read_ind", "mate", rotate_sequence(F.col("seq"), 8).alias("seq"))


def fasta_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as FASTA records and read back."""
    text = fasta_lines(spark, d).select(F.col("read_ind").alias("ord"), F.lit("reads").alias("file"), F.col("text").alias("value"))
    return parse_records(text).select("name", "seqname", "seq")


def feature_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Places of features as text, with open ends, cut from each document and put together."""
    docs = _docs(spark, d)
    ranges = F.concat(F.lit("<5..20, 41..60,"), F.floor(F.length("seq") / 2 + 61).cast("string"), F.lit("..>"), (F.length("seq") + 60).cast("string"))
    parts = docs.select("seqname", F.inline(parse_ranges(ranges)))
    return subsequences(parts.withColumn("doc_id", F.col("seqname").cast("bigint")), docs, ["doc_id"]).select("doc_id", F.md5("seq").alias("seq_md5"))


def transcripts_built(spark: SparkSession, d: str) -> DataFrame:
    """First mates as chromosomes with a transcript of two exons each, every other one on the minus strand."""
    genome = table(spark, d, "reads").where("mate = 'r1' and read_ind is not null and length(seq) >= 1").groupBy("read_ind").agg(F.max("seq").alias("seq"))
    n = F.length("seq").cast("bigint")
    parts = [F.struct(F.lit(f).alias("feature"), a.alias("start"), b.alias("end")) for f, a, b in (
        ("exon", F.lit(1).cast("bigint"), F.floor(n / 3) + 1), ("exon", F.floor(n / 2) + 1, n), ("CDS", F.lit(1).cast("bigint"), F.floor(n / 4) + 1))]
    rows = genome.select(F.col("read_ind").cast("string").alias("seqname"), F.col("read_ind").cast("string").alias("transcript_id"), F.when(F.col("read_ind") % 2 == 0, "+").otherwise("-").alias("strand"), F.inline(F.array(*parts)))
    return transcripts.transcript_sequences(rows, genome.select(F.col("read_ind").cast("string").alias("seqname"), "seq"))


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return flatten_json(table(spark, d, "events"), ["event_id"], "props")


def aa_classes(spark: SparkSession, d: str) -> DataFrame:
    letters = spark.createDataFrame([(c,) for c in "ACDEFGHIKLMNPQRSTVWYX*"], "letter string")
    return letters.select("letter", aa_property(F.col("letter")).alias("property"))


def random_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Random sequences: their lengths, whether they hold other letters than bases, and whether another has the same letters."""
    made = spark.range(200).select("id", random_dna(30, 7).alias("seq"))
    again = F.count("*").over(Window.partitionBy("seq")) > 1
    return made.select("id", F.length("seq").alias("n"), F.col("seq").rlike("[^ACGT]").alias("other"), again.alias("again"))


def transcript_places(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.transcript_positions(with_attributes(table(spark, d, "gtf").drop("exon_number"), ["transcript_id"]))


QUERIES = {f.__name__: f for f in (fasta_lines, gtf_lines, seqname_forms, region_parsed, region_from_chunks, region_joined, circle_rotated, fasta_parsed, feature_sequences, transcripts_built, json_leaves, aa_classes, random_sequences, transcript_places)}

_CELLS = ", ".join(f"""coalesce(CAST("{c}" AS VARCHAR), '.')""" for c in ("seqname", "source", "feature", "start", "end", "score", "strand", "frame"))
_FIRST = "CASE WHEN regexp_replace(seqname, '^chr', '') = 'M' THEN 'MT' ELSE regexp_replace(seqname, '^chr', '') END"
_ITEMS = "list_filter(string_split(regexp_replace(trim(attribute), ';$', ''), '; '), lambda s: starts_with(trim(s), 'transcript_id '))"

_RC = "reverse(translate(regexp_replace(upper({x}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"

ORACLES = {
    "fasta_parsed": "SELECT concat_ws('_', read_ind, mate) AS name, concat_ws('_', read_ind, mate) AS seqname, seq FROM reads WHERE seq IS NOT NULL",
    "feature_sequences": "SELECT doc_id, md5(substr(text, 5, 16) || substr(text, 41, 20) || substr(text, length(text) // 2 + 61)) AS seq_md5 FROM documents WHERE length(text) >= 1",
    "transcripts_built": f"""WITH g AS (SELECT read_ind, max(seq) AS s, length(max(seq)) AS n FROM reads WHERE mate = 'r1' AND read_ind IS NOT NULL AND length(seq) >= 1 GROUP BY 1),
        t AS (SELECT read_ind, 'pre_mRNA' AS kind, s FROM g UNION ALL SELECT read_ind, 'mRNA', CASE WHEN n // 2 + 1 = 1 AND n = 1 THEN s ELSE substr(s, 1, n // 3 + 1) || substr(s, n // 2 + 1) END FROM g UNION ALL SELECT read_ind, 'CDS', substr(s, 1, n // 4 + 1) FROM g)
        SELECT CAST(read_ind AS VARCHAR) AS transcript_id, kind, CASE WHEN read_ind % 2 = 0 THEN s ELSE {_RC.format(x="s")} END AS seq FROM t""",
    "fasta_lines": "SELECT read_ind, mate, '>' || concat_ws('_', read_ind, mate) || chr(10) || rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS text FROM reads WHERE seq <> '' UNION ALL SELECT read_ind, mate, '>' || concat_ws('_', read_ind, mate) || chr(10) FROM reads WHERE seq = ''",
    "gtf_lines": f"SELECT line_no, concat_ws(chr(9), {_CELLS}, coalesce(attribute, '')) AS text FROM gtf",
    "seqname_forms": f"SELECT DISTINCT seqname, CASE WHEN s = 'MT' THEN 'chrM' WHEN regexp_full_match(s, '[0-9]+|[XY]') THEN 'chr' || s ELSE s END || ' ' || s AS name FROM (SELECT seqname, {_FIRST} AS s FROM gtf WHERE seqname IS NOT NULL)",
    "region_parsed": 'SELECT line_no, seqname, "start" AS first, "end" AS last FROM gtf WHERE seqname IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL',
    "region_from_chunks": "SELECT doc_id, md5(substr(text, 100, length(text) - 50 - 100 + 1)) AS seq_md5 FROM documents WHERE length(text) >= 500",
    "region_joined": "SELECT doc_id, substr(text, 11, 20) || substr(text, 51, 40) AS seq FROM documents WHERE length(text) >= 100",
    "circle_rotated": "SELECT read_ind, mate, substr(seq, 8) || substr(seq, 1, 7) AS seq FROM reads WHERE length(seq) >= 20",
    "json_leaves": "SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)",
    "aa_classes": """SELECT letter, CASE WHEN letter IN ('S', 'T', 'N', 'Q', 'C') THEN 'polar' WHEN letter IN ('K', 'R', 'H') THEN 'basic pos charge' WHEN letter = '*' THEN 'stop'
        WHEN letter IN ('A', 'V', 'L', 'I', 'M', 'G', 'P') THEN 'non polar' WHEN letter IN ('D', 'E') THEN 'acidic neg charge' WHEN letter IN ('W', 'F', 'Y') THEN 'non polar aromtic' END AS property
        FROM (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWYX*', '')) AS letter)""",
    "random_sequences": "SELECT CAST(unnest(range(0, 200)) AS BIGINT) AS id, 30 AS n, false AS other, false AS again",
    "transcript_places": f"""WITH r AS (SELECT *, CASE WHEN len({_ITEMS}) > 0 THEN array_to_string(list_transform({_ITEMS}, lambda s: replace(substr(trim(s), 15), '"', '')), '__') END AS t FROM gtf WHERE feature = 'exon'),
        e AS (SELECT DISTINCT t AS transcript_id, seqname, strand, "start" AS s, "end" AS e FROM r WHERE t IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND "start" <= "end"),
        c AS (SELECT *, row_number() OVER w AS exon_no, CAST(sum(e - s + 1) OVER w AS BIGINT) AS last FROM e WINDOW w AS (PARTITION BY transcript_id, seqname, strand ORDER BY CASE WHEN strand = '-' THEN -e ELSE s END, s, e ROWS UNBOUNDED PRECEDING))
        SELECT transcript_id, exon_no, s AS "start", e AS "end", last - (e - s + 1) + 1 AS first, last FROM c""",
}
