"""Folders of V(D)J output, one per sample: contig and consensus tables and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.aggregates import coalesce_join
from strandloom.operators.clonotypes import consensus_table, shared_consensus
from strandloom.sources.fasta import read_fasta


def _csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(f"{folder}/*/{name}")
    return rows.withColumn("sample", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def _fasta(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    rows = read_fasta(spark, f"{folder}/*/{name}")
    return rows.select(F.element_at(F.split("file", "/"), -2).alias("sample"), F.col("seqname").alias(key), "seq")


def _plain_barcode(df: DataFrame) -> DataFrame:
    return df.withColumn("barcode", F.regexp_replace("barcode", "-1$", "")) if "barcode" in df.columns else df


def _contigs(spark: SparkSession, folder: str, table: str, fasta: str) -> DataFrame:
    rows = _plain_barcode(_csv(spark, folder, table)).withColumnsRenamed({"raw_clonotype_id": "clonotype_id", "raw_consensus_id": "consensus_id"})
    seqs = _fasta(spark, folder, fasta, "contig_id").withColumnRenamed("seq", "contig_seq")
    return rows.join(seqs, ["sample", "contig_id"], "left")


def read_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered contigs with their own sequence and their consensus' sequence and annotation; every contig stays."""
    contigs = _contigs(spark, folder, "filtered_contig_annotations.csv", "filtered_contig.fasta")
    seqs = _fasta(spark, folder, "consensus.fasta", "consensus_id").withColumnRenamed("seq", "consensus_seq")
    own = _csv(spark, folder, "consensus_annotations.csv").select("sample", "clonotype_id", "consensus_id", "chain", F.col("cdr3").alias("consensus_cdr3"), F.col("cdr3_nt").alias("consensus_cdr3_nt"))
    joined = coalesce_join(contigs, seqs, ["sample", "consensus_id"])
    return coalesce_join(joined, own, ["sample", "clonotype_id", "consensus_id", "chain"])


def read_clonotype_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """The older form: consensus rows with their and the reference's sequence, given to every contig of the clonotype."""
    table = consensus_table(_csv(spark, folder, "consensus_annotations.csv"), _fasta(spark, folder, "consensus.fasta", "consensus_id"), _fasta(spark, folder, "concat_ref.fasta", "consensus_id"))
    contigs = _contigs(spark, folder, "filtered_contig_annotations.csv", "filtered_contig.fasta").select("sample", "barcode", "contig_id", "clonotype_id", "contig_seq")
    return shared_consensus(contigs, table)
