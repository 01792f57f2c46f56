"""FASTA files: records, index, writing, and random access by chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.seqexpr import leading, parse_region, trailing, wrap
from strandloom.operators.positions import chunk_sequences, regions_from_chunks


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    return rows.where(F.trim("value") != "")


def read_fasta(spark: SparkSession, path: str | list[str], comment: str | None = None, seqnames: list[str] | None = None, headerless: bool = False, make_names: bool = False) -> DataFrame:
    """Rows (ord, file, name, seqname, seq): a record's header, its first word, and its lines put together without blanks.

    Files are split at records, so plain files are read in parallel and .gz files whole. Lines that begin with ``comment`` are left out. A ``headerless`` file is one
    record named like the file. ``make_names`` turns other signs than letters, digits, dot and underscore in the first word to dots. An empty file has no rows.
    """
    return parse_records(_records(spark, path), comment, seqnames, headerless, make_names)


def parse_records(rows: DataFrame, comment: str | None = None, seqnames: list[str] | None = None, headerless: bool = False, make_names: bool = False) -> DataFrame:
    """The records of rows (ord, file, value), each the text of one record: see ``read_fasta``."""
    if headerless:
        stem = F.regexp_extract("file", r"([^/]+?)(\.[A-Za-z]+)*$", 1)
        rows = rows.select("ord", "file", stem.alias("name"), F.col("value").alias("rest"))
    else:
        clean = F.regexp_replace("value", r"\A>", "")
        parts = F.split(clean, r"\r?\n", 2)
        rows = rows.select("ord", "file", F.trim(parts[0]).alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest"))
    if comment:
        rows = rows.withColumn("rest", F.regexp_replace("rest", rf"(?m)^\Q{comment}\E.*$", ""))
    first = F.split("name", r"\s")[0]
    if make_names:
        first = F.regexp_replace(first, r"[^A-Za-z0-9._]", ".")
    out = rows.select("ord", "file", "name", first.alias("seqname"), F.regexp_replace("rest", r"\s", "").alias("seq"))
    return out.where(F.col("seqname").isin(seqnames)) if seqnames else out


def fasta_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, name, seqname, start_line, end_line, n_seq_lines, bp_approx, place): records by line; place orders chr1, chr2, ... before other names."""
    rows = _records(spark, path)
    lines = F.filter(F.split(F.regexp_replace("value", r"\A>|\r?\n\z", ""), r"\r?\n"), lambda x: F.lit(True))
    rows = rows.select("ord", "file", lines.alias("l")).select("ord", "file", F.trim(F.col("l")[0]).alias("name"), F.size("l").alias("n"), F.length(F.get("l", F.lit(1))).alias("width"))
    w = Window.partitionBy("file").orderBy("ord")
    rows = rows.withColumn("end_line", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start_line", F.col("end_line") - F.col("n") + 1)
    seqname = F.split("name", r"\s")[0]
    number = F.regexp_replace(seqname, "^chr", "").try_cast("int")
    place = F.row_number().over(Window.partitionBy("file").orderBy(number.asc_nulls_last(), "ord"))
    return rows.select("file", "name", seqname.alias("seqname"), "start_line", "end_line", (F.col("n") - 1).alias("n_seq_lines"), (F.coalesce("width", F.lit(0)) * (F.col("n") - 1)).alias("bp_approx"), place.alias("place"))


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrap(seq, width))


def write_fasta(df: DataFrame, path: str, width: int = 60, order: str | None = None, gzip: bool = False, one_file: bool = False) -> None:
    """Records (name, seq) as FASTA; null names become ``seq_<n>``, null sequences are empty. Parts follow each other in the order; ``one_file`` is for results of a size a single task can write."""
    rows = df.orderBy(order) if order else df
    rows = rows.withColumn("name", F.coalesce("name", F.concat(F.lit("seq_"), (F.monotonically_increasing_id() + 1).cast("string"))))
    text = rows.select(fasta_text(F.col("name"), F.coalesce("seq", F.lit("")), width).alias("value"))
    (text.coalesce(1) if one_file else text).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def store_genome(sequences: DataFrame, folder: str, size: int = 1 << 16) -> None:
    """Sequences as Parquet chunks by name, and a table of their lengths and of the N at either end."""
    chunk_sequences(sequences, size).write.mode("overwrite").partitionBy("seqname").parquet(f"{folder}/chunks")
    sequences.select("seqname", F.length("seq").cast("bigint").alias("bp"), leading("seq").alias("leading_n"), trailing("seq").alias("trailing_n")).write.mode("overwrite").parquet(f"{folder}/lengths")


#: Distinct names without a sequence that a call may hold.
MOST_MISSING = 1000


def nearest_sequence_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (wanted, nearest): of all names of ``known`` (seqname) the one at the least edit distance from each name of ``asked`` (wanted), of equals the first in order.

    The asked names are a query set of at most ``MOST_MISSING`` names (more fail), fetched when this is called: each stands as a constant in one pass over the known
    names, whose best are brought together by a partial aggregation.
    """
    names = sorted(r["wanted"] for r in asked.select("wanted").where("wanted is not null").distinct().limit(MOST_MISSING + 1).collect())
    if len(names) > MOST_MISSING:
        raise ValueError(f"more than {MOST_MISSING} names that no sequence has")
    if not names:
        return asked.sparkSession.createDataFrame([], "wanted string, nearest string")
    rows = known.select("seqname", F.explode(F.array(*map(F.lit, names))).alias("wanted"))
    return rows.groupBy("wanted").agg(F.min(F.struct(F.levenshtein("wanted", "seqname").alias("lv"), "seqname"))["seqname"].alias("nearest"))


def genome_region(spark: SparkSession, folder: str, queries: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Rows (query, seqname, start, end, seq): stretches like ``chr2:100-200`` of a stored genome. A name that isn't there gives way to the nearest by edit distance of all names,
    of equals the first; only the chunks of the regions are read. A query that can't be read, or without a base in its stretch, keeps its row with nulls."""
    known = spark.read.parquet(f"{folder}/lengths").select("seqname").distinct()
    asked = queries.select("query", parse_region(F.col("query")).alias("r")).select("query", F.col("r.seqname").alias("wanted"), F.col("r.first").alias("start"), F.col("r.last").alias("end"))
    exact = asked.join(known.select(F.col("seqname").alias("k")), F.col("wanted") == F.col("k"), "left")
    best = nearest_sequence_names(exact.where("k is null"), known).withColumnRenamed("wanted", "w")
    named = exact.join(best, F.col("wanted") == F.col("w"), "left").select("query", F.coalesce("k", "nearest").alias("seqname"), "start", "end")
    seqs = regions_from_chunks(named.where("seqname is not null and start >= 1 and start <= end").distinct(), spark.read.parquet(f"{folder}/chunks"), ["query"], size)
    return named.join(seqs, "query", "left")
