"""Clonotypes: contig tables joined, named and collapsed.

Long rows have sample, barcode, chain (TRA or TRB), cdr3; wide rows sample, barcode, cdr3_TRA, cdr3_TRB (comma-joined) and cl_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seqexpr import paste
from strandloom.operators.aggregates import coalesce_join
from strandloom.session import cut_lineage


def contigs_with_consensus(contigs: DataFrame, consensus: DataFrame) -> DataFrame:
    """Each contig with its consensus' columns, joined by clonotype and consensus id; contigs without one stay. Null keys match null keys."""
    return coalesce_join(contigs, consensus, ["sample", "clonotype_id", "consensus_id"], "left")


def consensus_table(annotations: DataFrame, sequences: DataFrame, references: DataFrame) -> DataFrame:
    """Consensus annotations, sequences and reference sequences, all kept: full joins by sample and consensus id."""
    by = ["sample", "consensus_id"]
    out = annotations.join(sequences.select(*by, F.col("seq").alias("consensus_seq")), by, "full")
    return out.join(references.select(*by, F.col("seq").alias("reference_seq")), by, "full")


def shared_consensus(contigs: DataFrame, consensus: DataFrame) -> DataFrame:
    """The older form: every contig of a clonotype gets all its consensus rows."""
    return contigs.join(consensus, ["sample", "clonotype_id"], "left")


def wide_cells(long: DataFrame) -> DataFrame:
    """One row per cell: the sorted sequences of each chain, joined by commas; null where there is none."""
    cells = long.where("sample is not null and barcode is not null and cdr3 is not null").groupBy("sample", "barcode")
    cols = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("chain") == c, F.col("cdr3")))), ",") for c in ("TRA", "TRB")]
    wide = cells.agg(*[F.when(x != "", x).alias(f"cdr3_{c}") for c, x in zip(("TRA", "TRB"), cols)])
    return wide.where("cdr3_TRA is not null or cdr3_TRB is not null")


def nested_cells(long: DataFrame) -> DataFrame:
    """One row per cell with its rows as an array of structs, by chain and sequence."""
    return long.groupBy("sample", "barcode").agg(F.array_sort(F.collect_list(F.struct("chain", "cdr3"))).alias("data"))


def plausible_cells(wide: DataFrame) -> DataFrame:
    """Cells with at most one TRB and two TRA sequences; a missing chain is allowed."""
    n = lambda c: F.coalesce(F.size(F.split(F.col(c), ",")), F.lit(0))
    return wide.where((n("cdr3_TRB") <= 1) & (n("cdr3_TRA") <= 2))


def _key(cols: list[str]) -> Column:
    return paste(*[F.col(c) for c in cols])


def collapse_clonotypes(wide: DataFrame, split: list[str], chains: tuple[str, str] = ("cdr3_TRB", "cdr3_TRA"), name: str = "cl_name") -> DataFrame:
    """The rows, with one name in each group of ``split`` whose names may be one: the first in order.

    Groups whose key has ``NA_NA`` stay. Whether others collapse is decided on the distinct values of the chain that isn't in ``split``, the first rule that holds counts:
    one value: yes; null and one: yes; several and none with a comma: no; several and no null: no; null and two, one with a comma, of two different parts: yes; parts of
    more than two kinds: no; null and three, one of them the pair of the others: yes; anything else: no. Without another chain they collapse.

    A group may hold a share of all rows: it is decided from counts of its distinct values, and values are listed only where there are at most three.
    """
    other = [c for c in chains if c not in split]
    rows = wide.withColumn("_key", _key(split))
    names = rows.where(~F.col("_key").contains("NA_NA")).select("_key", name).distinct().groupBy("_key").agg(F.min(name).alias("_first"), F.count("*").alias("_n"))
    groups = names.where("_n > 1")
    if other:
        o = other[0]
        values = rows.select("_key", F.col(o).alias("v")).distinct()
        counts = values.groupBy("_key").agg(F.count("v").alias("n"), F.max(F.col("v").isNull()).alias("has_na"), F.count_if(F.col("v").contains(",")).alias("multi"))
        few = counts.where("has_na and n in (2, 3) and multi = 1").select("_key")
        parts = F.array_distinct(F.split(F.array_join(F.collect_set("v"), ","), ","))
        listed = values.join(few, "_key", "left_semi").groupBy("_key").agg(F.size(parts).alias("parts"))
        c = groups.join(counts, "_key").join(listed, "_key", "left")
        groups = c.where((F.col("n") <= 1) | (F.col("has_na") & F.col("n").isin(2, 3) & (F.col("multi") == 1) & (F.col("parts") == 2)))
    new = groups.select(F.col("_key").alias("_k"), "_first")
    joined = rows.join(new, F.col("_key") == F.col("_k"), "left")
    return joined.withColumn(name, F.coalesce("_first", name)).drop("_key", "_k", "_first")


#: The order in which names are collapsed.
PASSES = [
    ["cdr3_TRB", "sample"], ["cdr3_TRA", "sample"], ["cdr3_TRB", "sample"], ["cdr3_TRA", "sample"], ["cdr3_TRA", "cdr3_TRB", "patient"],
    ["cdr3_TRB", "sample"], ["cdr3_TRA", "sample"], ["cdr3_TRA", "cdr3_TRB", "patient"], ["cdr3_TRA", "cdr3_TRB", "sample"],
]


def name_clonotypes(long: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (sample, patient, replicate, body_fluid, barcode, cdr3_TRA, cdr3_TRB, cl_name): cells with the name of their clonotype.

    Each pair of chains begins with a name of its own (a digest of it); the nine passes of ``PASSES`` collapse them. A name found in several patients is kept as
    one only if all its cells have both chains, else each patient has its own; shared names are renamed. ``strict`` leaves out cells that ``plausible_cells`` does.
    """
    wide = wide_cells(long)
    if strict:
        wide = plausible_cells(wide)
    rows = wide.withColumn("cl_name", F.md5(paste(F.col("cdr3_TRA"), F.col("cdr3_TRB"), sep="|")))
    parts = F.split("sample", "_")
    rows = rows.select("*", F.get(parts, F.lit(0)).alias("patient"), F.get(parts, F.lit(1)).alias("replicate"), F.get(parts, F.lit(2)).alias("body_fluid"))
    for split in PASSES:  # each pass reads its rows several times: without a cut the plan would grow threefold with each
        rows = cut_lineage(collapse_clonotypes(rows, split))
    shared = rows.groupBy("cl_name").agg(F.count_distinct("patient").alias("_p"), F.bool_or(F.col("cdr3_TRA").isNull() | F.col("cdr3_TRB").isNull()).alias("_open")).where("_p > 1")
    joined = rows.join(shared.withColumnRenamed("cl_name", "_name"), F.col("cl_name") == F.col("_name"), "left")
    renamed = F.when(F.col("_open"), F.md5(F.concat_ws("|", F.lit("patient"), "cl_name", "patient"))).when(F.col("_p") > 1, F.md5(F.concat_ws("|", F.lit("shared"), "cl_name"))).otherwise(F.col("cl_name"))
    return joined.select("sample", "patient", "replicate", "body_fluid", "barcode", "cdr3_TRA", "cdr3_TRB", renamed.alias("cl_name"))


def clonotype_levels(wide: DataFrame) -> DataFrame:
    """Of each name the cells, samples, patients and distinct chains and pairs, a missing chain being one kind."""
    null_one = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    return wide.groupBy("cl_name").agg(
        F.count("*").alias("n_cells"), F.count_distinct("sample").alias("n_samples"), F.count_distinct("patient").alias("n_patients"), null_one("cdr3_TRA").alias("n_tra"), null_one("cdr3_TRB").alias("n_trb"),
        F.count_distinct(paste(F.col("cdr3_TRA"), F.col("cdr3_TRB"), sep="|")).alias("n_pairs"),
    )


def name_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (old_name, new_name, n_cells): how cells moved from names to names."""
    b = before.select("sample", "barcode", F.col("cl_name").alias("old_name"))
    return b.join(after.select("sample", "barcode", F.col("cl_name").alias("new_name")), ["sample", "barcode"]).groupBy("old_name", "new_name").agg(F.count("*").alias("n_cells"))


def pick_names(n: int, spark, avoid: list[str] | None = None, least: int = 4, forbidden: str = "", most_tries: int = 10_000) -> DataFrame:
    """n different pronounceable names that keep to the rules, the same each time; fails if there are too few within ``most_tries`` x n tries."""
    onset, vowel, coda = list("bdfgklmnprstvz"), list("aeiou"), ["l", "n", "r", "s", ""]
    tries = min(most_tries * n, len(onset) ** 2 * len(vowel) ** 2 * len(coda) * 8)
    ids = spark.range(tries)
    h = lambda k: F.xxhash64(F.col("id"), F.lit(k))
    part = lambda letters, k: F.element_at(F.array(*map(F.lit, letters)), (F.pmod(h(k), F.lit(len(letters))) + 1).cast("int"))
    name = F.initcap(F.concat(part(onset, 1), part(vowel, 2), part(onset, 3), part(vowel, 4), part(coda, 5)))
    good = ids.select("id", name.alias("name")).where(F.length("name") >= least)
    for ch in forbidden:
        good = good.where(~F.lower("name").contains(ch.lower()))
    if avoid:
        good = good.where(~F.col("name").isin(avoid))
    found = good.groupBy("name").agg(F.min("id").alias("id")).orderBy("id").limit(n)
    if found.count() < n:
        raise ValueError(f"fewer than {n} names keep to the rules")
    return found.select("name")
