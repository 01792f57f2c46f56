"""GTF files and the genomes that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.seqexpr import revcomp
from strandloom.operators.annotation import attribute_of, fix_duplicates, key_value_column, parse_attributes

SCHEMA = "seqname string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attribute string"


def read_gtf(spark: SparkSession, path: str | list[str], seqnames: list[str] | None = None, features: list[str] | None = None) -> DataFrame:
    """The nine columns and line_no, the order of the lines; comments are left out. ``.`` stays as it is; broken numbers are null."""
    rows = spark.read.schema(SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    rows = rows.withColumn("line_no", F.monotonically_increasing_id())
    if seqnames:
        rows = rows.where(F.col("seqname").isin(seqnames))
    return rows.where(F.col("feature").isin(features)) if features else rows


def gtf_line(attribute: Column | str = "attribute") -> Column:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("seqname", "source", "feature", "start", "end", "score", "strand", "frame")]
    return F.concat_ws("\t", *cells, F.coalesce(F.col(attribute) if isinstance(attribute, str) else attribute, F.lit("")))


def write_gtf(df: DataFrame, path: str, header: list[str] | None = None, keys: list[str] | None = None, unique: bool = True, gzip: bool = False, one_file: bool = False) -> None:
    """GTF text in the order of line_no, below header lines. With ``keys`` the attribute is made of those columns, names and ids that stand for several things first made unique. ``one_file`` is for results of a size a single task can write."""
    rows = df
    if keys and unique and {"gene_id", "gene_name"} <= set(df.columns):
        rows = fix_duplicates(rows)
    line = gtf_line(key_value_column(rows, keys)) if keys else gtf_line()
    text = rows.select(F.col("line_no").alias("o"), line.alias("value"))
    if header:
        head = df.sparkSession.createDataFrame([(i - len(header) - 1, f"#{h}") for i, h in enumerate(header)], "o bigint, value string")
        text = head.unionByName(text)
    lines = text.orderBy("o").select("value")  # parts follow each other, the header stands in the first
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def store_gtf(rows: DataFrame, folder: str) -> None:
    """Rows as Parquet by seqname, and the names of the genes on each; a later filter on seqname reads only its part."""
    rows.write.mode("overwrite").partitionBy("seqname").parquet(f"{folder}/rows")
    parsed = parse_attributes(F.col("attribute"))
    genes = rows.select("seqname", attribute_of(parsed, "gene_name").alias("gene_name"), attribute_of(parsed, "gene_id").alias("gene_id")).where("gene_name is not null or gene_id is not null").distinct()
    genes.write.mode("overwrite").parquet(f"{folder}/genes")


def harmonised_name(name: Column) -> Column:
    """``1`` and ``chr1`` become ``chr1 1``, ``MT`` and ``chrM`` become ``chrM MT``, other names ``x x``."""
    first = F.regexp_replace(F.split(name, r"\s")[0], "^chr", "")
    short = F.when(first == "M", "MT").otherwise(first)
    long = F.when(short == "MT", "chrM").when(short.rlike(r"\A([0-9]+|[XY])\z"), F.concat(F.lit("chr"), short)).otherwise(short)
    return F.concat(long, F.lit(" "), short)


def combine_references(genomes: list[DataFrame], annotations: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, annotation rows, report) of several genomes with their annotations: names are harmonised and only names in both are kept.

    The report lists each name with where it was found. A sequence name that occurs twice fails.
    """
    seqs = lines = report = None
    for i, (g, a) in enumerate(zip(genomes, annotations)):
        g2 = g.withColumn("name", harmonised_name(F.col("seqname"))).withColumn("seqname", F.split(F.col("name"), " ")[0])
        a2 = a.withColumn("seqname", F.split(harmonised_name(F.col("seqname")), " ")[0])
        names = g2.select("seqname", F.lit(True).alias("in_fasta")).join(a2.select("seqname").distinct().withColumn("in_gtf", F.lit(True)), "seqname", "full")
        own = names.select(F.lit(i).alias("reference"), "seqname", F.coalesce("in_fasta", F.lit(False)).alias("in_fasta"), F.coalesce("in_gtf", F.lit(False)).alias("in_gtf"))
        both = own.where("in_fasta and in_gtf").select("seqname")
        g3, a3 = g2.join(both, "seqname", "left_semi").select("name", "seqname", "seq"), a2.join(both, "seqname", "left_semi").withColumn("reference", F.lit(i))
        seqs = g3 if seqs is None else seqs.unionByName(g3)
        lines = a3 if lines is None else lines.unionByName(a3)
        report = own if report is None else report.unionByName(own)
    twice = seqs.groupBy("seqname").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sequence name {twice[0]['seqname']} occurs twice")
    return seqs, lines, report


def features_to_reference(features: DataFrame, origin: DataFrame, to_exon: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sequences, annotation rows) from feature tables (id, feature, ranges, complement, value) and their sequences (id, seq): names are cleaned and made unique."""
    from strandloom.operators.aggregates import make_unique

    starts = F.transform(F.regexp_extract_all("ranges", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))
    rows = features.where(F.col("feature").isin(to_exon)).withColumn("line_no", F.monotonically_increasing_id())
    rows = rows.withColumn("clean", F.regexp_replace(F.coalesce("value", "feature"), "[^A-Za-z0-9_]", ""))
    rows = make_unique(rows, "clean", "line_no", "gene_id")
    attr = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), "gene_id", F.lit('"; gene_name "'), "gene_id", F.lit('"; '))
    gtf = rows.select(
        "line_no", F.col("id").alias("seqname"), F.lit("genbank").alias("source"), F.lit("exon").alias("feature"), F.array_min(starts).alias("start"), F.array_max(starts).alias("end"),
        F.lit(".").alias("score"), F.when(F.col("complement"), "-").otherwise("+").alias("strand"), F.lit(".").alias("frame"), attr.alias("attribute"),
    )
    return origin.select(F.col("id").alias("name"), F.col("id").alias("seqname"), F.upper("seq").alias("seq")), gtf


def rotate_genome(sequences: DataFrame, cut: int, reverse: bool = False) -> DataFrame:
    """Circular sequences opened so that base ``cut`` comes first."""
    from strandloom.functions.positions import rotate_sequence

    s = rotate_sequence(F.col("seq"), cut)
    return sequences.withColumn("seq", revcomp(s) if reverse else s)


def prepare_reference(spark: SparkSession, fasta_path: str, gtf_path: str, folder: str) -> None:
    """A genome and its annotation stored for random access: sequence chunks and lengths, rows by sequence, names of genes."""
    from strandloom.sources.fasta import read_fasta, store_genome

    store_genome(read_fasta(spark, fasta_path).select("seqname", "seq"), f"{folder}/genome")
    store_gtf(read_gtf(spark, gtf_path), f"{folder}/genes")
