"""Queries over the read and document tables for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.encode import decode_ids, encode_texts
from strandloom.llm.heavy import heavy_candidates, heavy_hitters
from strandloom.llm.kinds import describe_texts, learn_kinds, text_kinds
from strandloom.llm.packing import pack_items
from strandloom.llm.textstats import COMMON_WORDS, text_stats
from strandloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters(table(spark, sf_dir, "reads"), "seq").select(F.col("value").alias("seq"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent sequences with their exact counts."""
    return heavy_hitters(table(spark, sf_dir, "reads"), "seq").select(F.col("value").alias("seq"), "n_rows")


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences that may be frequent with the bounds the sketch gives, from one scan."""
    return heavy_candidates(table(spark, sf_dir, "reads"), "seq").withColumnRenamed("value", "seq")


def p4_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent sequences, their exact counts, and whether these lie within the bounds of the sketch."""
    reads = table(spark, sf_dir, "reads")
    both = heavy_hitters(reads, "seq").select("value", "n_rows").join(heavy_candidates(reads, "seq"), "value", "left")
    return both.select(F.col("value").alias("seq"), "n_rows", F.coalesce(F.col("n_rows").between(F.col("at_least"), F.col("at_most")), F.lit(False)).alias("within"), "n_all")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, whether its ids decode to its text; null texts have no ids and give ''."""
    docs = table(spark, sf_dir, "documents")
    decoded = decode_ids(encode_texts(docs, ["doc_id", "text"]).withColumnRenamed("text", "original"), ["doc_id", "original"])
    return decoded.select("doc_id", (F.coalesce("original", F.lit("")) == F.col("text")).alias("same"))


def _packed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    row = table(spark, sf_dir, "containers").where(F.col("container_kind") == kind).first()
    sizes = encode_texts(table(spark, sf_dir, "documents"), ["doc_id"], path=f"/opt/tokenizers/{row['tokenizer']}.tiktoken", out="count")
    return pack_items(sizes, "doc_id", "n_tokens", row["capacity"]).withColumn("capacity", F.lit(row["capacity"]))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in containers of the kind ``medium``."""
    return _packed(spark, sf_dir, "medium")


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of every kind, with what they hold."""
    kinds = [r["container_kind"] for r in table(spark, sf_dir, "containers").select("container_kind").orderBy("container_kind").collect()]  # the table is fixed: three rows
    out = None
    for kind in kinds:
        bins = _packed(spark, sf_dir, kind).groupBy("capacity", "bin_id").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens")).withColumn("container_kind", F.lit(kind))
        out = bins if out is None else out.unionByName(bins)
    return out


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by their characters into containers of 2,000: of each its parts and characters, and whether all its containers hold no more than that."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    packed = pack_items(sizes, "doc_id", "n", 2000)
    bins = packed.groupBy("bin_id").agg(F.sum("n").alias("held"))
    return packed.join(bins, "bin_id").groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_chars"), F.max("size_start").alias("last_start"), (F.max("held") <= 2000).alias("fits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn_kinds(docs, table(spark, sf_dir, "doc_labels"))
    return text_kinds(docs, rules).where("kind <> 'code'")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each document's whole text."""
    return text_stats(table(spark, sf_dir, "documents"), ["doc_id"])


def p8_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each document's text below its header and, from 200 characters, its kind, from one pass after the rules are learned."""
    docs = table(spark, sf_dir, "documents")
    rules = learn_kinds(docs, table(spark, sf_dir, "doc_labels"))
    return describe_texts(docs, rules)


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p4_bounds, p4_within, p6_ids, p6_round_trip, p7_packed, p7_bins, p7_checked, p8_found, p8_stats, p8_described)}

_HEAVY = "SELECT seq, count(*) AS n FROM reads WHERE seq <> '' GROUP BY seq HAVING count(*) * 200 >= (SELECT count(*) FROM reads WHERE seq <> '')"

_COMMON = ", ".join(f"'{w}'" for w in COMMON_WORDS)
_STATS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w,
             list_filter(list_transform(string_split(t, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0.0 END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN round((length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g'))) / length(t), 6) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?', ':', ';'))) / len(l), 6) ELSE 0.0 END AS end_punct_share,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: lower(trim(x, '.,;:!?()"''`*')) IN ({_COMMON}))) / len(w), 6) ELSE 0.0 END AS common_share
FROM w"""

ORACLES = {
    "p8_stats": _STATS,
    "p4_found": f"SELECT seq FROM ({_HEAVY})",
    "p4_counts": f"SELECT seq, n AS n_rows FROM ({_HEAVY})",
    "p4_within": f"SELECT seq, n AS n_rows, true AS within, (SELECT count(*) FROM reads WHERE seq <> '') AS n_all FROM ({_HEAVY})",
    "p7_checked": """SELECT doc_id, CAST(greatest(1, (length(text) + 1999) // 2000) AS BIGINT) AS n_parts, CAST(length(text) AS BIGINT) AS n_chars, CAST(greatest(0, (length(text) - 1) // 2000) * 2000 AS BIGINT) AS last_start, true AS fits
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
}
