"""Paired reads: filters, quality figures, matching to reference sequences with mismatches, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seqexpr import hamming, revcomp, share_below
from strandloom.operators.positions import chunk_sequences
from strandloom.operators.spread import spread_join
from strandloom.session import cut_lineage


def pair_reads(reads: DataFrame, columns: tuple[str, ...] = ("seq", "qual")) -> DataFrame:
    """One row per read_ind: the first delivered row of each mate, of equals that with the least seq and qual. With ``columns`` seq alone, qualities are neither read nor shuffled; the sequences are the same."""
    cols = [F.min_by(F.struct(*columns), F.when(F.col("mate") == m, F.struct("arrived_at", *columns))).alias(m) for m in ("r1", "r2")]
    wide = reads.where("read_ind is not null").groupBy("read_ind").agg(*cols)
    return wide.select("read_ind", *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in ("r1", "r2") for c in columns])


def filter_pairs(pairs: DataFrame, keep: dict[str, Column], paired: bool = True) -> DataFrame:
    """``keep`` has a condition for each mate. Paired: both must hold. Unpaired: a failing mate becomes null, a row without mates goes."""
    if paired:
        return pairs.where(keep["r1"] & keep["r2"])
    cells = [F.when(keep[m], F.col(f"{m}_{c}")).alias(f"{m}_{c}") for m in ("r1", "r2") for c in ("seq", "qual")]
    return pairs.select("read_ind", *cells).where("r1_seq is not null or r2_seq is not null")


def long_enough(least: int) -> dict[str, Column]:
    return {m: F.length(f"{m}_seq") >= least for m in ("r1", "r2")}


def only_acgt() -> dict[str, Column]:
    return {m: ~F.col(f"{m}_seq").rlike("[^ACGT]") for m in ("r1", "r2")}


def good_quality(most: float = 0.1) -> dict[str, Column]:
    """The share of bases with a quality below 30 is at most ``most`` (at most 1)."""
    return {m: share_below(f"{m}_qual", 30) <= min(most, 1.0) for m in ("r1", "r2")}


def qc_counts(pairs: DataFrame, steps: dict[str, dict[str, Column]]) -> DataFrame:
    """Rows (step, r1, r2, both): how many mates hold each condition, in one pass."""
    aggs = []
    for name, keep in steps.items():
        aggs.append(F.struct(F.lit(name).alias("step"), F.count_if(keep["r1"]).alias("r1"), F.count_if(keep["r2"]).alias("r2"), F.count_if(keep["r1"] & keep["r2"]).alias("both")))
    return pairs.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


#: Lengths of single words that reads and references are joined by, from the least.
SEEDS = (1, 4, 8, 12, 16)

#: Parts shorter than this give way to pairs of words, of at most so many letters each, for reads with at most so many mismatches.
SHORT, PAIR, PAIR_MOST = 12, 5, 3

#: Letters of a reference that stand together in one row.
CHUNK = 4096

#: Rows, and letters in them, up to which places and matches are broadcast; they are counted before.
FEW_ROWS, FEW_LETTERS = 200_000, 16_000_000


def _small(df: DataFrame, text: str | None = None) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    size = df.agg(F.count("*").alias("n"), (F.sum(F.length(text)) if text else F.lit(0)).alias("letters")).first()
    return F.broadcast(df) if size["n"] <= FEW_ROWS and (size["letters"] or 0) <= FEW_LETTERS else df


def _matches(reads: DataFrame, refs: DataFrame, most: float) -> DataFrame:
    """Rows (_in, _q, _ref_id), distinct: reads (_in, _q) that occur in references (_in, _ref_id, _text) of the same _in, as ``match_sequences`` has it. It is written, and broadcast if small."""
    q = reads.where(F.length("_q") > 0).distinct().withColumn("_qid", F.monotonically_increasing_id())
    q = cut_lineage(q)  # read several times, and often dear to make; the ids stay
    n = F.length("_q")
    k = F.least((F.floor(n * F.lit(most)) if most < 1 else F.lit(int(most))).cast("int"), n - 1)
    q = q.withColumn("_k", k).withColumn("_part", F.floor(n / (F.col("_k") + 1)).cast("int"))
    q = q.withColumn("_two", (F.col("_part") < SHORT) & (F.col("_k") <= PAIR_MOST) & (n >= F.col("_k") + 2))
    width = F.lit(SEEDS[0])
    for w in SEEDS[1:]:
        width = F.when(F.col("_part") >= w, w).otherwise(width)
    q = q.withColumn("_w", F.when(F.col("_two"), F.least(F.lit(PAIR), F.floor(n / (F.col("_k") + 2)).cast("int"))).otherwise(width).cast("int"))
    need = q.agg(F.collect_set(F.struct("_w", F.when(F.col("_two"), F.col("_k")).otherwise(-1).alias("k"))).alias("shapes"), F.max(n).alias("longest")).first()
    shapes = sorted({(x["_w"], gap) for x in need["shapes"] for gap in ([0] if x["k"] < 0 else [x["_w"] * i for i in range(1, x["k"] + 2)])})
    longest = need["longest"] or 1
    size = max(CHUNK, longest)

    texts = refs.where(F.length("_text") > 0).distinct().withColumn("_id", F.monotonically_increasing_id())
    chunks = chunk_sequences(texts.select(F.struct("_in", "_ref_id", "_id").alias("seqname"), F.col("_text").alias("seq")), size, longest).select("seqname.*", F.col("chunk_no").alias("_chunk"), F.col("seq").alias("_text"))
    chunks = cut_lineage(chunks)  # read for each shape of words and for the candidates
    key = lambda text, at, w, gap: F.xxhash64(F.col("_in"), w, gap, F.substr(text, at, w), F.substr(text, at + gap, w))
    words = None
    for w, gap in shapes:
        last = F.least(F.lit(size), F.length("_text") - (w + gap) + 1)
        spots = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: F.struct(p.alias("p"), key(F.col("_text"), p, F.lit(w), F.lit(gap)).alias("h")))
        own = chunks.select("_id", "_chunk", F.explode(F.when(last >= 1, spots)).alias("_s")).select(F.col("_s.h").alias("_h"), "_id", (F.col("_chunk") * size + F.col("_s.p")).alias("_pos"))
        words = own if words is None else words.unionByName(own)
    if words is None:  # no read at all
        return q.select("_in", "_q", F.lit("").alias("_ref_id"))
    steps = lambda f: F.transform(F.sequence(F.lit(0), F.col("_k")), f)
    spot = lambda off, gap: F.struct(off.cast("int").alias("off"), gap.cast("int").alias("gap"))
    pairs = F.flatten(steps(lambda i: F.transform(F.sequence(i + 1, F.col("_k") + 1), lambda j: spot(i * F.col("_w"), (j - i) * F.col("_w")))))
    seeds = q.select("_in", "_q", "_qid", "_w", F.explode(F.when(F.col("_two"), pairs).otherwise(steps(lambda i: spot(i * F.col("_part"), F.lit(0))))).alias("_s"))
    seeds = seeds.select(key(F.col("_q"), F.col("_s.off") + 1, F.col("_w"), F.col("_s.gap")).alias("_h"), "_qid", F.col("_s.off").alias("_off"))
    places = spread_join(seeds, words, ["_h"], few=True).select("_qid", "_id", (F.col("_pos") - F.col("_off")).alias("_at")).where("_at >= 1").distinct()
    places = _small(cut_lineage(places))
    met = q.select("_qid", F.col("_in").alias("_of"), "_q", "_k").join(places, "_qid").withColumn("_chunk", F.floor((F.col("_at") - 1) / size).cast("bigint")).join(chunks, ["_id", "_chunk"])
    there = F.substr(F.col("_text"), (F.col("_at") - F.col("_chunk") * size).cast("int"), F.length("_q"))
    met = met.where(F.col("_of").eqNullSafe(F.col("_in"))).select("_in", "_q", "_k", "_ref_id", there.alias("_there"))
    found = met.where((F.length("_there") == F.length("_q")) & ((F.col("_there") == F.col("_q")) | (hamming(F.col("_there"), F.col("_q")) <= F.col("_k")))).select("_in", "_q", "_ref_id").distinct()
    return _small(cut_lineage(found), "_q")


def match_sequences(reads: DataFrame, refs: DataFrame, most: float, read: str = "seq", ref: str = "ref_seq") -> DataFrame:
    """Rows (*reads' columns, *refs' columns), distinct: each read that occurs in a reference with at most ``most`` substitutions.

    Below 1, ``most`` is a share of the read's length; a read never mismatches whole. With k mismatches one of k + 1 parts of the read must occur exactly:
    the beginning of each part, of the greatest length of ``SEEDS`` that fits, is joined with the words of that length in the references. Words of less than ``SHORT`` letters
    would meet by chance in nearly every reference; there two of k + 2 words must occur exactly, each at its place, and pairs of words are joined. The
    candidates' places are verified. So no link is lost and no pair without common words is looked at. Null and empty sequences match nothing.

    References are cut into chunks that overlap by the longest read; a word is a hash with the place it has, and only a candidate's place meets its chunk and its read, so neither
    is carried along. A chunk is one row, so a chunk that very many candidates fall into is a skewed partition that AQE splits. Distinct reads, chunks, candidates and
    matches are written once when this is called; the lengths of words, the overlap, and whether candidates and matches are few enough to be broadcast are asked of these.
    """
    d = refs.where(F.length(ref) > 0).distinct().withColumn("_ref_id", F.md5(ref))
    found = _matches(reads.select(F.lit("").alias("_in"), F.col(read).alias("_q")), d.select(F.lit("").alias("_in"), "_ref_id", F.col(ref).alias("_text")), most)
    out = reads.distinct().join(found, F.col(read) == F.col("_q")).join(d.withColumnRenamed("_ref_id", "_own_id"), F.col("_ref_id") == F.col("_own_id"))
    return out.select(*reads.columns, *refs.columns)


def match_pairs(pairs: DataFrame, refs: DataFrame, most: float, rows: DataFrame | None = None) -> DataFrame:
    """Rows (ref_name, ref_ind, read_ind, in_r1, in_r2): references that a read's first mate, or the reverse complement of its second, occurs in.

    Distinct sequences are matched once, those of both mates together, and joined back to their reads. refs: ref_name, ref_ind, ref_seq.
    ``rows`` (mate, seq) are those that the pairs were made of: with them distinct sequences are found without making the pairs a second time; sequences that no pair has give no row.
    """
    mates = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"{m}_seq").alias("seq")) for m in ("r1", "r2")])
    own = pairs.select("read_ind", F.inline(mates)).where(F.length("seq") > 0)
    seqs = own.select(F.col("m").alias("_in"), F.col("seq").alias("_q")) if rows is None else rows.where(F.col("mate").isin("r1", "r2")).select(F.col("mate").alias("_in"), F.col("seq").alias("_q"))
    sides = F.array(F.struct(F.lit("r1").alias("_in"), F.col("ref_seq").alias("_text")), F.struct(F.lit("r2").alias("_in"), revcomp("ref_seq").alias("_text")))
    d = refs.where(F.length("ref_seq") > 0).distinct().withColumn("_ref_id", F.md5("ref_seq"))
    found = _matches(seqs, d.select("_ref_id", F.inline(sides)), most)
    hits = own.join(found, (F.col("m") == F.col("_in")) & (F.col("seq") == F.col("_q"))).select("read_ind", "m", "_ref_id")
    both = hits.join(d, "_ref_id").groupBy("ref_name", "ref_ind", "read_ind")
    return both.agg(F.bool_or(F.col("m") == "r1").alias("in_r1"), F.bool_or(F.col("m") == "r2").alias("in_r2"))


def match_statistics(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (ref_name, side, matches_n, matches_freq, unique_n, unique_freq, ref_targets_n) for the sides r1, r2 and paired; none where nothing matches.

    Frequencies are of all reads of the side, and of the distinct reads.
    """
    seqs = pairs.select("read_ind", F.col("r1_seq").alias("a"), F.col("r2_seq").alias("b"))
    m = matches.join(seqs, "read_ind")
    out = None
    totals = pairs.agg(
        F.count("*").alias("n"), F.count_distinct("r1_seq").alias("u_r1"), F.count_distinct("r2_seq").alias("u_r2"),
        F.count_if(F.col("r1_seq").isNotNull() & F.col("r2_seq").isNotNull()).alias("n_both"), F.count_distinct(F.when(F.col("r1_seq").isNotNull() & F.col("r2_seq").isNotNull(), F.struct("r1_seq", "r2_seq"))).alias("u_both"),
    )
    for side, cond, key, all_, unique in (("r1", F.col("in_r1"), F.col("a"), "n", "u_r1"), ("r2", F.col("in_r2"), F.col("b"), "n", "u_r2"), ("paired", F.col("in_r1") & F.col("in_r2"), F.struct("a", "b"), "n_both", "u_both")):
        own = m.where(cond).groupBy("ref_name").agg(F.count("*").alias("matches_n"), F.count_distinct(key).alias("_u"), F.count_distinct("ref_ind").alias("ref_targets_n"))
        own = own.join(F.broadcast(totals), F.lit(True))  # one row
        own = own.select("ref_name", F.lit(side).alias("side"), "matches_n", (F.col("matches_n") / F.col(all_)).alias("matches_freq"), F.col("_u").alias("unique_n"), (F.col("_u") / F.col(unique)).alias("unique_freq"), "ref_targets_n")
        out = own if out is None else out.unionByName(own)
    return out


def read_statistics(pairs: DataFrame) -> DataFrame:
    """Rows (read, total_n, unique_n, unique_freq) for r1, r2 and paired: all reads of the side (of pairs those with both mates), the distinct ones, and their share."""
    both = F.col("r1_seq").isNotNull() & F.col("r2_seq").isNotNull()
    sides = (("r1", F.count("*"), F.col("r1_seq")), ("r2", F.count("*"), F.col("r2_seq")), ("paired", F.count_if(both), F.when(both, F.struct("r1_seq", "r2_seq"))))
    rows = [F.struct(F.lit(n).alias("read"), total.alias("total_n"), F.count_distinct(key).alias("unique_n")) for n, total, key in sides]
    return pairs.agg(F.array(*rows).alias("a")).select(F.inline("a")).withColumn("unique_freq", F.when(F.col("total_n") > 0, F.col("unique_n") / F.col("total_n")))


def statistics_long(stats: DataFrame, by: list[str], side: str) -> DataFrame:
    """Statistics as rows (*by, stat, value), the stat named ``side__name`` as in the wide form."""
    names = [c for c in stats.columns if c not in (*by, side)]
    return stats.select(*by, side, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([*by, side], names, "_name", "value").select(*by, F.concat_ws("__", side, "_name").alias("stat"), "value")


def statistics_wide(stats: DataFrame, by: list[str], side: str, sides: tuple[str, ...] = ("r1", "r2", "paired")) -> DataFrame:
    """One row per ``by`` with a column ``side__name`` for each side and figure; null where there is none."""
    names = [c for c in stats.columns if c not in (*by, side)]
    cells = [F.max(F.when(F.col(side) == s, F.col(c).cast("double"))).alias(f"{s}__{c}") for s in sides for c in names]
    return stats.groupBy(*by).agg(*cells)


def index_sets(matches: DataFrame) -> DataFrame:
    """Rows (read_ind, kind): reads matched with both mates to one reference (paired), else with the first or second only."""
    per = matches.groupBy("read_ind").agg(F.bool_or(F.col("in_r1") & F.col("in_r2")).alias("p"), F.bool_or("in_r1").alias("a"), F.bool_or("in_r2").alias("b"))
    return per.select("read_ind", F.when(F.col("p"), "paired").when(F.col("a") & ~F.col("b"), "r1_unpaired").when(F.col("b") & ~F.col("a"), "r2_unpaired").otherwise("apart").alias("kind"))


def matches_report(matches: DataFrame) -> DataFrame:
    """Per read the number of matches, of reference sets and their names; then how often each combination occurs."""
    per = matches.groupBy("read_ind").agg(F.count("*").alias("n"), F.count_distinct("ref_name").alias("n_names"), F.array_join(F.array_sort(F.collect_set("ref_name")), ",").alias("names"))
    return per.groupBy("n_names", "names").agg(F.count("*").alias("n_reads"), F.sum("n").alias("n_matches"))
