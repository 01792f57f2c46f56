"""Sequences by position: exploding, putting together, comparing with a reference, alignments from CIGAR strings.

A long alignment has the columns of ``by`` (which alignment), seq_name, position (from 1) and seq (one letter, ``-`` for a gap, null where
the sequence doesn't reach).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_positions(df: DataFrame, by: list[str], seq: str, terminal_gaps_null: bool = True) -> DataFrame:
    """One row per letter; gaps before the first and behind the last letter become null, inner ones stay. Null and '' give no rows."""
    s = F.col(seq)
    first = F.length(s) - F.length(F.ltrim(s, F.lit("-"))) + 1
    last = F.length(F.rtrim(s, F.lit("-")))
    rows = df.where(F.length(s) > 0).select(*by, first.alias("_f"), last.alias("_l"), F.posexplode(F.split(s, "")).alias("_p", "_c"))
    rows = rows.where("_c <> ''").withColumn("position", F.col("_p") + 1)
    letter = F.when(F.col("position").between(F.col("_f"), F.col("_l")), F.col("_c")) if terminal_gaps_null else F.col("_c")
    return rows.select(*by, "position", letter.alias("seq"))


def join_positions(long: DataFrame, by: list[str], inner: str = "-", outer: str = "-") -> DataFrame:
    """The sequences again: missing or null letters between the first and last are ``inner``, before and behind them, up to ``by[:-1]``'s last position, ``outer``."""
    own = long.where("seq is not null").groupBy(*by).agg(F.collect_list(F.struct("position", "seq")).alias("_l"), F.min("position").alias("_a"), F.max("position").alias("_b"))
    group = by[:-1]
    width = long.groupBy(*group).agg(F.max("position").alias("_w")) if group else long.agg(F.max("position").alias("_w"))
    joined = own.join(width, group) if group else own.join(F.broadcast(width), F.lit(True))  # one row
    letters = F.array_sort("_l")
    before = F.concat(F.array(F.col("_a") - 1), F.transform(letters, lambda x: x["position"]))  # one longer than the letters
    filled = F.zip_with(letters, before, lambda x, b: F.concat(F.repeat(F.lit(inner), x["position"] - b - 1), x["seq"]))
    return joined.select(*by, F.concat(F.repeat(F.lit(outer), F.col("_a") - 1), F.array_join(filled, ""), F.repeat(F.lit(outer), F.col("_w") - F.col("_b"))).alias("seq"))


def longest_as_reference(long: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows (*by, ref): the sequence with most letters; an alignment in which several have as many fails."""
    n = long.where("seq is not null").groupBy(*by, name).agg(F.count("*").alias("_n"))
    top = n.groupBy(*by).agg(F.max("_n").alias("_m"))
    best = n.join(top, by).where("_n = _m").groupBy(*by).agg(F.min(name).alias("_ref"), F.count("*").alias("_ties"))
    return best.select(*by, F.when(F.col("_ties") > 1, F.raise_error(F.lit("no single longest sequence"))).otherwise(F.col("_ref")).alias("ref"))


def _with_reference(long: DataFrame, by: list[str], name: str, ref: Column) -> DataFrame:
    refs = long.where(F.col(name) == ref).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("position").alias("_p"), F.col("seq").alias("ref_seq"), F.lit(True).alias("in_ref"))
    cond = F.col("position") == F.col("_p")
    for c in by:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    return long.join(refs, cond, "left").drop("_p", *[f"_{c}" for c in by])


def compare_to_reference(long: DataFrame, by: list[str], name: str, ref: Column, match: str = ".", mismatch: str | None = None, keep_gaps: bool = True, change_ref: bool = False, ref_mismatch: str | None = None, insertion: str | None = None) -> DataFrame:
    """Letters of other sequences that equal the reference's become ``match`` (gaps stay if asked), others stay or become ``mismatch``.

    Positions the reference doesn't have stay. With ``insertion``, letters where the reference has a gap become that. With ``change_ref`` the
    reference shows ``match`` too, except where some other sequence differs there; those letters stay or become ``ref_mismatch``.
    """
    rows = _with_reference(long, by, name, ref)
    is_ref = F.col(name) == ref
    equal = F.col("seq").eqNullSafe(F.col("ref_seq")) & F.col("seq").isNotNull()
    gap = (F.col("seq") == "-") if keep_gaps else F.lit(False)
    other = F.when(F.col("in_ref").isNull() | F.col("seq").isNull() | F.col("ref_seq").isNull(), F.col("seq")).when(equal & gap, F.col("seq")).when(equal, match)
    if insertion is not None:
        other = other.when((F.col("ref_seq") == "-") & (F.col("seq") != "-"), insertion)
    other = other.when(gap, F.col("seq")).otherwise(F.lit(mismatch) if mismatch else F.col("seq"))
    rows = rows.withColumn("changed", F.when(is_ref, F.col("seq")).otherwise(other))
    if change_ref:
        shown = rows.where(~is_ref).groupBy(*by, "position").agg(F.count_if(F.col("changed").isNotNull() & (F.col("changed") != match)).alias("_shown"))
        rows = rows.join(shown, [*by, "position"], "left")
        letter = F.lit(ref_mismatch) if ref_mismatch else F.col("seq")
        rows = rows.withColumn("changed", F.when(is_ref & F.col("seq").isNotNull(), F.when(F.coalesce("_shown", F.lit(0)) == 0, match).otherwise(letter)).otherwise(F.col("changed")))
    return rows.select(*by, name, "position", F.col("changed").alias("seq"))


def label_matches(long: DataFrame, by: list[str], name: str, ref: Column) -> DataFrame:
    """Each letter of the other sequences as match, mismatch, gap (only it has one) or insertion (only the reference has one)."""
    rows = _with_reference(long, by, name, ref).where((F.col(name) != ref) & F.col("in_ref"))
    s, r = F.col("seq"), F.col("ref_seq")
    label = F.when(s == r, "match").when((s == "-") & (r != "-"), "gap").when((r == "-") & (s != "-"), "insertion").when(s.isNotNull() & r.isNotNull(), "mismatch")
    return rows.select(*by, name, "position", label.alias("label"))


def alignment_summary(long: DataFrame, by: list[str]) -> DataFrame:
    """Of each sequence the number of letters, first, last and middle position."""
    return long.where("seq is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.floor((F.min("position") + F.max("position")) / 2).cast("int").alias("middle")
    )


def focus(long: DataFrame, subject: Column, name: str, margin: int) -> DataFrame:
    """The positions within ``margin`` of the range that the sequences other than the subject cover."""
    limits = long.where((F.col(name) != subject) & F.col("seq").isNotNull()).agg(F.min("position").alias("_a"), F.max("position").alias("_b"))
    return long.join(F.broadcast(limits), F.col("position").between(F.col("_a") - margin, F.col("_b") + margin)).drop("_a", "_b")


def cigar_positions(df: DataFrame, by: list[str], cigar: str, start: str, seq: str, remove_clipped: bool = False, skip_as: str | None = None) -> DataFrame:
    """Rows (*by, position, seq): each base of a read at its place on the reference, by its CIGAR string.

    M, = and X place bases; S places bases (or ``skip_as``), before the start if it leads; D gives ``-``; N ``skip_as``; I uses up bases and gives none;
    H and P do nothing; a missing count is 1. Other operations, or no CIGAR, give no rows for the read.
    """
    full = F.regexp_replace(F.regexp_replace(F.col(cigar), r"(?<=[A-Z=])(?=[A-Z=])", "1"), r"\A(?=[A-Z=])", "1")
    ops = F.transform(F.regexp_extract_all(full, F.lit(r"\d+[MIDNSHPX=]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    good = full.rlike(r"\A(\d+[MIDNSHPX=])+\z")
    uses = lambda o: o["op"].isin("M", "=", "X", "S", "I")
    moves = lambda o: o["op"].isin("M", "=", "X", "S", "D", "N")
    zero = F.struct(F.lit(1).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<n:int,op:string,q:int,r:int>>").alias("done"))
    walked = F.aggregate(
        ops,
        zero,
        lambda a, o: F.struct(
            (a["q"] + F.when(uses(o), o["n"]).otherwise(0)).alias("q"),
            (a["r"] + F.when(moves(o), o["n"]).otherwise(0)).alias("r"),
            F.concat(a["done"], F.array(F.struct(o["n"].alias("n"), o["op"].alias("op"), a["q"].alias("q"), a["r"].alias("r")))).alias("done"),
        ),
        lambda a: a["done"],
    )
    first = F.filter(ops, lambda o: o["op"] != "H")[0]
    shift = F.when(first["op"] == "S", first["n"]).otherwise(0)
    rows = df.where(good & F.col(start).isNotNull() & F.col(seq).isNotNull()).select(*by, F.col(seq).alias("_s"), (F.col(start) - shift).alias("_b"), F.explode(walked).alias("_o"))
    rows = rows.where(F.col("_o.op").isin("M", "=", "X", "S", "D", "N") & (F.col("_o.n") > 0)).select("*", F.explode(F.sequence(F.lit(0), F.col("_o.n") - 1)).alias("_i"))
    base = F.substr(F.col("_s"), F.col("_o.q") + F.col("_i"), F.lit(1))
    skip = F.lit(skip_as).cast("string")
    letter = F.when(F.col("_o.op") == "D", "-").when(F.col("_o.op") == "N", skip).when((F.col("_o.op") == "S") & F.lit(remove_clipped), skip).otherwise(base)
    return rows.select(*by, (F.col("_b") + F.col("_o.r") + F.col("_i")).alias("position"), letter.alias("seq"))


def subsequences(features: DataFrame, sequences: DataFrame, by: list[str], reverse: Column | None = None) -> DataFrame:
    """Rows (*by, seq): parts start..end of the sequence ``seqname``, in order, put together; reverse-complemented where asked."""
    from strandloom.functions.seqexpr import revcomp

    parts = features.join(sequences.select("seqname", F.col("seq").alias("_s")), "seqname")
    cut = parts.select(*by, "start", (reverse if reverse is not None else F.lit(False)).alias("_r"), F.substr(F.col("_s"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")).alias("_part"))
    joined = cut.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "_part"))), lambda x: x["_part"]), "").alias("_j"), F.bool_or("_r").alias("_r"))
    return joined.select(*by, F.when(F.col("_r"), revcomp("_j")).otherwise(F.col("_j")).alias("seq"))


def parse_ranges(ranges: Column) -> Column:
    """Array of (start, end) of ``a..b,c..d``, a place alone being both; ``<`` and ``>`` for open ends are left out, what is no range is too."""
    plain = F.regexp_replace(ranges, r"[<>\s]", "")
    items = F.filter(F.split(plain, ","), lambda x: x.rlike(r"\A\d+(\.\.\d+)?\z"))
    return F.transform(items, lambda x: F.struct(F.split(x, r"\.\.")[0].cast("bigint").alias("start"), F.element_at(F.split(x, r"\.\."), -1).cast("bigint").alias("end")))


def chunk_sequences(sequences: DataFrame, size: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """Rows (seqname, chunk_no, seq): long sequences in pieces of a fixed size, and ``overlap`` letters more of the next, so that none is shuffled whole.

    A sequence is cut in one walk over its letters, however long it is; the overlap is at most the size.
    """
    if overlap > size:
        raise ValueError("the overlap is longer than a piece")
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = sequences.where(F.length("seq") > 0).select("seqname", parts.alias("_p"))
    if overlap:
        more = F.transform("_p", lambda x, i: F.concat(x, F.coalesce(F.substr(F.get("_p", i + 1), F.lit(1), F.lit(overlap)), F.lit(""))))
        rows = rows.select("seqname", more.alias("_p"))
    return rows.select("seqname", F.posexplode("_p").alias("_i", "seq")).select("seqname", F.col("_i").cast("bigint").alias("chunk_no"), "seq")


def regions_from_chunks(regions: DataFrame, chunks: DataFrame, by: list[str], size: int = 1 << 16) -> DataFrame:
    """Rows (*by, seq): start..end of ``seqname`` from chunked sequences; each region meets only the chunks it touches."""
    wanted = regions.select(*by, "seqname", "start", "end", F.explode(F.expr(f"sequence((start - 1) div {size}, (end - 1) div {size})")).alias("chunk_no"))
    parts = wanted.join(chunks, ["seqname", "chunk_no"])
    a = F.greatest(F.col("start") - F.col("chunk_no") * size, F.lit(1))
    b = F.least(F.col("end") - F.col("chunk_no") * size, F.lit(size))
    cut = parts.select(*by, "chunk_no", F.substr(F.col("seq"), a.cast("int"), (b - a + 1).cast("int")).alias("_p"))
    return cut.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "_p"))), lambda x: x["_p"]), "").alias("seq"))


def consensus(long: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, seq): the most frequent letter of each position, of equals the first in order; positions without a letter are left out."""
    letters = long.where("seq is not null").groupBy(*by, "position").agg(F.mode("seq", True).alias("_c"))
    return letters.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_c"))), lambda x: x["_c"]), "").alias("seq"))


def covered_positions(long: DataFrame, by: list[str], name: str, ref: Column) -> DataFrame:
    """The alignment without positions at which only the reference has a letter, the rest numbered anew from 1."""
    from pyspark.sql import Window

    used = long.where((F.col(name) != ref) & F.col("seq").isNotNull()).select(*by, "position").distinct()
    w = Window.partitionBy(*by).orderBy("position") if by else Window.orderBy("position")
    used = used.withColumn("_new", F.row_number().over(w))
    return long.join(used, [*by, "position"]).select(*by, name, F.col("_new").alias("position"), "seq")
