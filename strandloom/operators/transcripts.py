"""Transcripts put together from annotation rows and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.annotation import introns
from strandloom.operators.positions import subsequences


def labelled_features(rows: DataFrame) -> DataFrame:
    """Rows of transcripts with their introns and a label: feature and two-digit number; UTR as 5UTR or 3UTR by its side of the start codon, codons without number.

    Missing numbers: 5' UTR 1, 3' UTR the transcript's highest.
    """
    parts = rows.where("transcript_id is not null and start <= end")
    numbers = parts.groupBy("transcript_id").agg(F.max("exon_number").alias("_top"), F.min(F.when(F.col("feature") == "start_codon", F.col("start"))).alias("_codon"))
    gaps = introns(rows).select("transcript_id", "seqname", "strand", F.lit("intron").alias("feature"), "start", "end", F.col("intron_no").alias("exon_number"))
    every = parts.select("transcript_id", "seqname", "strand", "feature", "start", "end", "exon_number").unionByName(gaps)
    j = every.join(numbers, "transcript_id", "left")
    left = F.col("start") < F.col("_codon")
    five = F.when(F.col("strand") == "-", ~left).otherwise(left)
    name = F.when(F.col("feature") == "UTR", F.when(five, "5UTR").otherwise("3UTR")).otherwise(F.col("feature"))
    number = F.coalesce("exon_number", F.when(name == "5UTR", 1).when(name == "3UTR", F.col("_top")))
    label = F.when(name.isin("start_codon", "stop_codon", "transcript"), name).otherwise(F.concat(name, F.lpad(F.coalesce(number, F.lit(0)).cast("string"), 2, "0")))
    return j.select("transcript_id", "seqname", "strand", "feature", "start", "end", number.alias("exon_number"), label.alias("label"))


def transcript_sequences(rows: DataFrame, sequences: DataFrame, stop_codon_in_cds: bool = False) -> DataFrame:
    """Rows (transcript_id, kind, seq): pre_mRNA (first to last base), mRNA (exons) and CDS, minus-strand ones reverse-complemented."""
    good = rows.where("transcript_id is not null and start is not null and end is not null and start <= end")
    span = good.where("feature = 'exon'").groupBy("transcript_id", "seqname", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("kind", F.lit("pre_mRNA"))
    coding = ["CDS", "stop_codon"] if stop_codon_in_cds else ["CDS"]
    cut = good.select("transcript_id", "seqname", "strand", "start", "end", F.when(F.col("feature") == "exon", "mRNA").when(F.col("feature").isin(coding), "CDS").alias("kind")).where("kind is not null").distinct()
    parts = span.select("transcript_id", "seqname", "strand", "start", "end", "kind").unionByName(cut)
    return subsequences(parts, sequences, ["transcript_id", "kind"], F.col("strand") == "-")


def transcript_positions(rows: DataFrame) -> DataFrame:
    """Rows (transcript_id, exon_no, start, end, first, last): where each exon lies in the mRNA, in its direction."""
    from strandloom.operators.annotation import exon_sums

    s = exon_sums(rows)
    return s.select("transcript_id", "exon_no", "start", "end", (F.col("nt_cumsum") - F.col("nt") + 1).alias("first"), F.col("nt_cumsum").alias("last"))


def checked_transcripts(seqs: DataFrame) -> DataFrame:
    """Coding sequences with whether they begin with ATG, end with a stop codon and have whole codons."""
    c = seqs.where("kind = 'CDS'")
    return c.select("transcript_id", F.col("seq").startswith("ATG").alias("starts"), F.right("seq", F.lit(3)).isin("TGA", "TAG", "TAA").alias("stops"), (F.length("seq") % 3 == 0).alias("whole"))


def gene_sequences(rows: DataFrame, sequences: DataFrame, gene: str) -> DataFrame:
    """The transcript sequences of one gene, by its name regardless of case."""
    return transcript_sequences(rows.where(F.lower("gene_name") == gene.lower()), sequences)


def segment_reference(records: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Reference segments from records (name, seq) with headers ``accession|allele|species|functionality|...``: gene and allele number, translation, and the place of
    amino-acid ``regions`` (allele, region, aa) in it, in amino acids and bases; a region that doesn't occur has null places."""
    from strandloom.functions.seqexpr import translate_dna

    h = F.split("name", r"\|")
    allele = F.get(h, F.lit(1))
    rows = records.select(
        F.get(h, F.lit(0)).alias("accession"), allele.alias("allele"), F.split(allele, r"\*")[0].alias("gene"), F.get(F.split(allele, r"\*"), F.lit(1)).alias("allele_number"), F.get(h, F.lit(3)).alias("functionality"),
        F.upper(F.regexp_replace("seq", r"[.\s]", "")).alias("seq_nt"), F.col("name").alias("meta"),
    )
    rows = rows.withColumn("seq_aa", F.when(F.col("functionality").contains("F"), translate_dna("seq_nt")))
    if regions is None:
        return rows
    placed = rows.join(regions, "allele").withColumn("_at", F.when(F.length("aa") > 0, F.instr("seq_aa", F.col("aa"))))
    place = F.when(F.col("_at") > 0, F.col("_at"))
    end = place + F.length("aa") - 1
    return placed.select("allele", "gene", "region", place.alias("aa_start"), end.alias("aa_end"), ((place - 1) * 3 + 1).alias("nt_start"), (end * 3).alias("nt_end"))
