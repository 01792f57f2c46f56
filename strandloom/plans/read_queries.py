"""Queries over the sequencing reads: sequence functions, quality, pairs, matching, comparison by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seqexpr as S
from strandloom.operators import aggregates as G
from strandloom.operators import fuzzy, positions, reads
from strandloom.session import cut_lineage, table


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return reads.pair_reads(_reads(spark, d))


def _seq_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs without their qualities."""
    return reads.pair_reads(_reads(spark, d), ("seq",))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """The longest reads as reference sequences."""
    r = _reads(spark, d).where("length(seq) >= 150 and read_ind is not null").groupBy("seq").agg(F.min("read_ind").alias("ref_ind"))
    return r.select(F.concat(F.lit("set"), (F.col("ref_ind") % 3).cast("string")).alias("ref_name"), "ref_ind", F.col("seq").alias("ref_seq"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("read_ind", F.explode(F.array(F.struct(F.lit("r1").alias("seq_name"), F.col("r1_seq").alias("s")), F.struct(F.lit("r2").alias("seq_name"), F.col("r2_seq").alias("s")))).alias("x"))
    return positions.explode_positions(p.select("read_ind", "x.*"), ["read_ind", "seq_name"], "s")


def seq_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ind", "mate", S.revcomp("seq").alias("rc"), S.revcomp("seq", complement=False).alias("reversed"), S.revcomp("seq", reverse=False).alias("complement"))


def seq_translated(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ind", "mate", S.translate_dna("seq").alias("aa"))


def seq_quality(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ind", "mate", *S.quality_stats("qual")).withColumn("mean_qual", F.round("mean_qual", 6))


def seq_ends(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ind", "mate", F.length("seq").alias("n"), S.leading("seq").alias("leading_n"), S.trailing("seq").alias("trailing_n"))


def seq_wrapped(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ind", "mate", S.wrap("seq", 60).alias("lines"))


def seq_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).where("seq is not null").select("read_ind", "mate", S.longest_plain_run("seq").alias("x")).select("read_ind", "mate", "x.*")


def seq_types(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).where("sample is not null").groupBy("sample").agg(S.guess_type("seq").alias("type"))


def seq_valid(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("read_ind", "mate", S.valid_letters("seq", "DNA").alias("dna"), S.valid_letters("seq", "RNA").alias("rna"), S.valid_letters("seq", "AA").alias("aa"))


def seq_rulers(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("r1_seq is not null and r2_seq is not null").select("read_ind", S.match_symbols("r1_seq").alias("ruler"), S.dots_for_matches(F.col("r2_seq"), F.col("r1_seq")).alias("dotted"))


def seq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sequences named by first appearance; the order is the read and its mate."""
    r = _reads(spark, d).where("seq <> ''").groupBy("seq").agg(F.count("*").alias("n"), F.min(F.struct("read_ind", "mate")).alias("first"))
    return r.select("seq", "n", F.col("first.read_ind").alias("first_read"))


def seq_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the same text as one, named by the place of the first."""
    return G.collapse_duplicates(table(spark, d, "documents").where("text is not null"), "text", "doc_id").select("name", F.md5("seq").alias("text_md5"), "n")


def reads_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def reads_long(spark: SparkSession, d: str) -> DataFrame:
    return reads.filter_pairs(_pairs(spark, d), reads.long_enough(60)).select("read_ind", "r1_seq", "r2_seq")


def reads_acgt(spark: SparkSession, d: str) -> DataFrame:
    return reads.filter_pairs(_pairs(spark, d), reads.only_acgt(), paired=False).select("read_ind", "r1_seq", "r2_seq")


def reads_good_quality(spark: SparkSession, d: str) -> DataFrame:
    return reads.filter_pairs(_pairs(spark, d), reads.good_quality(0.1)).select("read_ind", "r1_qual", "r2_qual")


def reads_qc(spark: SparkSession, d: str) -> DataFrame:
    return reads.qc_counts(_pairs(spark, d), {"length": reads.long_enough(60), "acgt": reads.only_acgt(), "quality": reads.good_quality(0.1)})


def reads_sampled(spark: SparkSession, d: str) -> DataFrame:
    """An exact tenth of the read pairs: how many, how many different reads, and how many are pairs of the table with all they hold."""
    pairs = _pairs(spark, d)
    found = G.exact_sample(pairs, 0.1, "read_ind")
    known = found.alias("f").join(pairs.select([F.col(c).alias(f"_{c}") for c in pairs.columns]), F.col("read_ind") == F.col("_read_ind"))
    same = F.lit(True)
    for c in pairs.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return known.agg(F.count("*").alias("n"), F.count_distinct("read_ind").alias("n_reads"), F.count_if(same).alias("n_known"))


def reads_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """The sampled pairs themselves."""
    return G.exact_sample(_pairs(spark, d), 0.1, "read_ind")


def reads_matched(spark: SparkSession, d: str) -> DataFrame:
    return reads.match_pairs(_pairs(spark, d), _refs(spark, d), 0)


def reads_matched_two_off(spark: SparkSession, d: str) -> DataFrame:
    return reads.match_pairs(_seq_pairs(spark, d), _refs(spark, d), 2, _reads(spark, d))


def reads_matched_mutated(spark: SparkSession, d: str) -> DataFrame:
    """References with one base changed, and every other one with two: reads match them with one or two substitutions."""
    other = lambda at: F.concat(F.substr(F.col("ref_seq"), F.lit(1), F.lit(at - 1)), F.translate(F.substr(F.col("ref_seq"), F.lit(at), F.lit(1)), "ACGT", "CGTA"), F.substr(F.col("ref_seq"), F.lit(at + 1)))
    refs = _refs(spark, d).withColumn("ref_seq", other(40)).withColumn("ref_seq", F.when(F.col("ref_ind") % 2 == 1, other(90)).otherwise(F.col("ref_seq")))
    return reads.match_pairs(_seq_pairs(spark, d), refs, 2, _reads(spark, d))


def reads_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reads.read_statistics(_pairs(spark, d)).withColumn("unique_freq", F.round("unique_freq", 6))


def reads_match_stats(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    stats = reads.match_statistics(reads.match_pairs(p, _refs(spark, d), 0), p)
    return stats.withColumn("matches_freq", F.round("matches_freq", 6)).withColumn("unique_freq", F.round("unique_freq", 6))


def reads_index_sets(spark: SparkSession, d: str) -> DataFrame:
    return reads.index_sets(reads.match_pairs(_pairs(spark, d), _refs(spark, d), 0))


def reads_report(spark: SparkSession, d: str) -> DataFrame:
    return reads.matches_report(reads.match_pairs(_pairs(spark, d), _refs(spark, d), 0))


def pos_exploded(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d)


def pos_joined(spark: SparkSession, d: str) -> DataFrame:
    return positions.join_positions(_long(spark, d), ["read_ind", "seq_name"])


def pos_compared(spark: SparkSession, d: str) -> DataFrame:
    return positions.compare_to_reference(_long(spark, d), ["read_ind"], "seq_name", F.lit("r1"), mismatch="x")


def pos_compared_both(spark: SparkSession, d: str) -> DataFrame:
    return positions.compare_to_reference(_long(spark, d), ["read_ind"], "seq_name", F.lit("r1"), change_ref=True)


def pos_labels(spark: SparkSession, d: str) -> DataFrame:
    return positions.label_matches(_long(spark, d), ["read_ind"], "seq_name", F.lit("r1"))


def pos_summary(spark: SparkSession, d: str) -> DataFrame:
    return positions.alignment_summary(_long(spark, d), ["read_ind", "seq_name"])


def pos_cigar(spark: SparkSession, d: str) -> DataFrame:
    """Reads placed by a CIGAR string made from their length: two bases clipped, a deletion and an insertion inside."""
    r = _pairs(spark, d).where("length(r1_seq) >= 20").select("read_ind", "r1_seq", F.concat(F.lit("2S8M2D3I"), (F.length("r1_seq") - 13).cast("string"), F.lit("M")).alias("cigar"), F.lit(100).alias("start"))
    return positions.cigar_positions(r, ["read_ind"], "cigar", "start", "r1_seq")


def pos_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent base of each position over all first and over all second mates."""
    return positions.consensus(_long(spark, d).drop("read_ind"), ["seq_name"])


def pos_covered(spark: SparkSession, d: str) -> DataFrame:
    return positions.covered_positions(_long(spark, d), ["read_ind"], "seq_name", F.lit("r1"))


def near_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_name", "p_type").distinct()
    return fuzzy.edit_join(p, p.select(F.col("p_name").alias("q_name"), F.col("p_type").alias("q_type")), "p_name", "q_name", 3, F.col("p_type"), F.col("q_type"))


def near_cdr3(spark: SparkSession, d: str) -> DataFrame:
    """Translated reads within three edits of each other: first mates as TRA, second as TRB, all of them also as the known ones."""
    dna = _reads(spark, d).where("length(seq) >= 3").select(F.when(F.col("mate") == "r1", "TRA").otherwise("TRB").alias("chain"), "seq").distinct()
    t = cut_lineage(dna.select("chain", S.translate_dna("seq").alias("cdr3")).distinct())
    return fuzzy.cdr3_hits(t, t, 3, (False, True))


QUERIES = {
    f.__name__: f
    for f in (
        seq_revcomp, seq_translated, seq_quality, seq_ends, seq_wrapped, seq_longest_run, seq_types, seq_valid, seq_rulers, seq_duplicates, seq_collapsed, reads_pairs, reads_long, reads_acgt, reads_good_quality, reads_qc,
        reads_sampled, reads_sample_rows, reads_matched, reads_matched_two_off, reads_matched_mutated, reads_statistics, reads_match_stats, reads_index_sets, reads_report, pos_exploded, pos_joined, pos_compared, pos_compared_both, pos_labels, pos_summary, pos_cigar, pos_consensus, pos_covered,
        near_parts, near_cdr3,
    )
}

_RC = "reverse(translate(regexp_replace(upper({x}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
_AA = """CASE WHEN length({x}) >= 3 THEN array_to_string(list_transform(range(1, length({x}) - 1, 3), lambda i:
 CASE WHEN regexp_full_match(upper({x}[i:i+2]), '[ACGT]{{3}}') THEN substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',
  CAST(16 * (strpos('TCAG', upper({x}[i])) - 1) + 4 * (strpos('TCAG', upper({x}[i+1])) - 1) + strpos('TCAG', upper({x}[i+2])) AS BIGINT), 1) ELSE 'X' END), '') WHEN {x} IS NOT NULL THEN '' END"""
_PAIRS = """
d AS (SELECT read_ind, mate, seq, qual, row_number() OVER (PARTITION BY read_ind, mate ORDER BY arrived_at, seq NULLS FIRST, qual NULLS FIRST) AS k FROM reads WHERE read_ind IS NOT NULL),
p AS (SELECT read_ind, max(seq) FILTER (mate = 'r1') AS r1_seq, max(qual) FILTER (mate = 'r1') AS r1_qual, max(seq) FILTER (mate = 'r2') AS r2_seq, max(qual) FILTER (mate = 'r2') AS r2_qual FROM d WHERE k = 1 GROUP BY 1)"""
_REFS = "f AS (SELECT 'set' || min(read_ind) % 3 AS ref_name, min(read_ind) AS ref_ind, seq AS ref_seq FROM reads WHERE length(seq) >= 150 AND read_ind IS NOT NULL GROUP BY seq)"
_RCF = _RC.format(x="ref_seq")
_MATCH = f"""{_PAIRS}, {_REFS},
m1 AS (SELECT ref_name, ref_ind, read_ind FROM p JOIN f ON contains(ref_seq, r1_seq) WHERE r1_seq <> ''),
m2 AS (SELECT ref_name, ref_ind, read_ind FROM p JOIN (SELECT ref_name, ref_ind, {_RCF} AS rc FROM f) ON contains(rc, r2_seq) WHERE r2_seq <> ''),
m AS (SELECT ref_name, ref_ind, read_ind, bool_or(s = 1) AS in_r1, bool_or(s = 2) AS in_r2 FROM (SELECT *, 1 AS s FROM m1 UNION ALL SELECT *, 2 FROM m2) GROUP BY 1, 2, 3)"""
_LONG = f"""{_PAIRS}, s AS (SELECT read_ind, 'r1' AS seq_name, r1_seq AS s FROM p UNION ALL SELECT read_ind, 'r2', r2_seq FROM p),
l AS (SELECT read_ind, seq_name, i AS position, s[i] AS seq FROM (SELECT read_ind, seq_name, s, CAST(unnest(range(1, length(s) + 1)) AS INTEGER) AS i FROM s WHERE s <> '')),
r AS (SELECT read_ind, position, seq AS ref_seq FROM l WHERE seq_name = 'r1'),
j AS (SELECT l.*, ref_seq FROM l LEFT JOIN r USING (read_ind, position))"""
_LOW = "1 - length(regexp_replace({q}, '[^?-~]', '', 'g')) / length({q})"
_SAME = "r1_seq IS NOT NULL AND r2_seq IS NOT NULL"


def _two_off(refs: str) -> str:
    return f"""WITH {_PAIRS}, {_REFS}, e AS ({refs}), h AS (SELECT ref_name, ref_ind, t, 1 AS side FROM e UNION ALL SELECT ref_name, ref_ind, {_RC.format(x="t")}, 2 FROM e),
        u AS (SELECT DISTINCT r1_seq AS q, 1 AS side FROM p WHERE r1_seq <> '' UNION ALL SELECT DISTINCT r2_seq, 2 FROM p WHERE r2_seq <> ''),
        z AS (SELECT q, u.side, ref_name, ref_ind FROM u JOIN h ON u.side = h.side AND length(q) <= length(t)
              AND len(list_filter(range(1, length(t) - length(q) + 2), lambda i: hamming(t[i:i + length(q) - 1], q) <= least(2, length(q) - 1))) > 0)
        SELECT ref_name, ref_ind, read_ind, bool_or(side = 1) AS in_r1, bool_or(side = 2) AS in_r2 FROM (
          SELECT ref_name, ref_ind, read_ind, side FROM p JOIN z ON side = 1 AND q = r1_seq UNION ALL SELECT ref_name, ref_ind, read_ind, side FROM p JOIN z ON side = 2 AND q = r2_seq) GROUP BY 1, 2, 3"""


ORACLES = {
    "seq_revcomp": f"SELECT read_ind, mate, {_RC.format(x='seq')} AS rc, reverse(seq) AS reversed, reverse({_RC.format(x='seq')}) AS complement FROM reads",
    "seq_translated": f"SELECT read_ind, mate, {_AA.format(x='seq')} AS aa FROM reads",
    "seq_quality": """SELECT read_ind, mate, list_min(q) AS min_qual, round(list_sum(q) / len(q), 6) AS mean_qual, CASE WHEN len(q) > 0 THEN CAST(len(list_filter(q, lambda x: x < 30)) AS INTEGER) END AS n_below
        FROM (SELECT read_ind, mate, list_transform(string_split(nullif(qual, ''), ''), lambda c: ascii(c) - 33) AS q FROM reads)""",
    "seq_ends": "SELECT read_ind, mate, CAST(length(seq) AS INTEGER) AS n, CAST(length(seq) - length(ltrim(seq, 'N')) AS INTEGER) AS leading_n, CAST(length(seq) - length(rtrim(seq, 'N')) AS INTEGER) AS trailing_n FROM reads",
    "seq_wrapped": "SELECT read_ind, mate, rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM reads",
    "seq_longest_run": """WITH a AS (SELECT read_ind, mate, regexp_split_to_array(seq, '[MRWSYKVHDBN]') AS p FROM reads WHERE seq IS NOT NULL),
        b AS (SELECT *, list_transform(p, lambda x: length(x)) AS n FROM a), c AS (SELECT *, list_max(n) AS m, list_position(n, list_max(n)) AS k FROM b)
        SELECT read_ind, mate, p[k] AS run, CAST(coalesce(list_sum(n[1:k-1]), 0) + k AS INTEGER) AS first, CAST(coalesce(list_sum(n[1:k-1]), 0) + k - 1 + m AS INTEGER) AS last FROM c""",
    "seq_types": """SELECT sample, CASE WHEN bool_and(regexp_full_match(upper(seq), '[ACGTMRWSYKVHDBN+.-]*')) THEN 'DNA' WHEN bool_and(regexp_full_match(upper(seq), '[ACGUMRWSYKVHDBN+.-]*')) THEN 'RNA'
        WHEN bool_and(regexp_full_match(upper(seq), '[A-Z*+.-]*')) THEN 'AA' END AS type FROM reads WHERE sample IS NOT NULL GROUP BY 1""",
    "seq_valid": """SELECT read_ind, mate, regexp_full_match(upper(seq), '[ACGTMRWSYKVHDBN+.-]*') AS dna, regexp_full_match(upper(seq), '[ACGUMRWSYKVHDBN+.-]*') AS rna,
        regexp_full_match(upper(seq), '[ARNDCQEGHILKMFPSTWYVUOBJZX*+.-]*') AS aa FROM reads""",
    "seq_rulers": f"""WITH {_PAIRS} SELECT read_ind, array_to_string(list_transform(range(1, length(r1_seq) + 1), lambda i: CASE WHEN r1_seq[i] = '-' THEN ' ' WHEN length(replace(r1_seq[1:i], '-', '')) % 5 = 0 THEN '|' ELSE '.' END), '') AS ruler,
        array_to_string(list_transform(range(1, length(r2_seq) + 1), lambda i: CASE WHEN r1_seq[i] = r2_seq[i] THEN '.' ELSE r2_seq[i] END), '') AS dotted FROM p WHERE {_SAME}""",
    "seq_duplicates": "SELECT seq, count(*) AS n, min(read_ind) AS first_read FROM reads WHERE seq <> '' GROUP BY 1",
    "seq_collapsed": """WITH c AS (SELECT text, count(*) AS n, min(doc_id) AS f FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT 'unique seq ' || row_number() OVER (ORDER BY f) || ' (' || n || ')' AS name, md5(text) AS text_md5, n FROM c""",
    "reads_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "reads_long": f"WITH {_PAIRS} SELECT read_ind, r1_seq, r2_seq FROM p WHERE length(r1_seq) >= 60 AND length(r2_seq) >= 60",
    "reads_acgt": f"""WITH {_PAIRS}, q AS (SELECT read_ind, CASE WHEN NOT regexp_matches(r1_seq, '[^ACGT]') THEN r1_seq END AS r1_seq, CASE WHEN NOT regexp_matches(r2_seq, '[^ACGT]') THEN r2_seq END AS r2_seq FROM p)
        SELECT * FROM q WHERE r1_seq IS NOT NULL OR r2_seq IS NOT NULL""",
    "reads_good_quality": f"WITH {_PAIRS} SELECT read_ind, r1_qual, r2_qual FROM p WHERE r1_qual <> '' AND r2_qual <> '' AND {_LOW.format(q='r1_qual')} <= 0.1 AND {_LOW.format(q='r2_qual')} <= 0.1",
    "reads_qc": f"""WITH {_PAIRS}, c AS (SELECT length(r1_seq) >= 60 AS a1, length(r2_seq) >= 60 AS a2, NOT regexp_matches(r1_seq, '[^ACGT]') AS b1, NOT regexp_matches(r2_seq, '[^ACGT]') AS b2,
        CASE WHEN r1_qual <> '' THEN {_LOW.format(q='r1_qual')} <= 0.1 END AS c1, CASE WHEN r2_qual <> '' THEN {_LOW.format(q='r2_qual')} <= 0.1 END AS c2 FROM p)
        {' UNION ALL '.join(f"SELECT '{n}' AS step, count(*) FILTER ({x}1) AS r1, count(*) FILTER ({x}2) AS r2, count(*) FILTER ({x}1 AND {x}2) AS both FROM c" for n, x in (('length', 'a'), ('acgt', 'b'), ('quality', 'c')))}""",
    "reads_sampled": "SELECT n, n AS n_reads, n AS n_known FROM (SELECT CAST(round_even(count(DISTINCT read_ind) * 0.1, 0) AS BIGINT) AS n FROM reads)",
    "reads_matched": f"WITH {_MATCH} SELECT * FROM m",
    "reads_matched_two_off": _two_off("SELECT ref_name, ref_ind, ref_seq AS t FROM f"),
    "reads_matched_mutated": _two_off("""SELECT ref_name, ref_ind, CASE WHEN ref_ind % 2 = 1 THEN t[1:89] || translate(t[90], 'ACGT', 'CGTA') || t[91:] ELSE t END AS t
        FROM (SELECT ref_name, ref_ind, ref_seq[1:39] || translate(ref_seq[40], 'ACGT', 'CGTA') || ref_seq[41:] AS t FROM f)"""),
    "reads_statistics": f"""WITH {_PAIRS}, t AS (SELECT 'r1' AS read, count(*) AS total_n, count(DISTINCT r1_seq) AS unique_n FROM p UNION ALL SELECT 'r2', count(*), count(DISTINCT r2_seq) FROM p
        UNION ALL SELECT 'paired', count(*), count(DISTINCT r1_seq || '|' || r2_seq) FROM p WHERE {_SAME}) SELECT *, round(unique_n / total_n, 6) AS unique_freq FROM t""",
    "reads_match_stats": f"""WITH {_MATCH}, q AS (SELECT m.*, r1_seq AS a, r2_seq AS b FROM m JOIN p USING (read_ind)),
        t AS (SELECT count(*) AS n, count(DISTINCT r1_seq) AS u1, count(DISTINCT r2_seq) AS u2, count(*) FILTER ({_SAME}) AS nb, count(DISTINCT r1_seq || '|' || r2_seq) AS ub FROM p)
        SELECT ref_name, 'r1' AS side, count(*) AS matches_n, round(count(*) / any_value(n), 6) AS matches_freq, count(DISTINCT a) AS unique_n, round(count(DISTINCT a) / any_value(u1), 6) AS unique_freq, count(DISTINCT ref_ind) AS ref_targets_n FROM q, t WHERE in_r1 GROUP BY 1
        UNION ALL SELECT ref_name, 'r2', count(*), round(count(*) / any_value(n), 6), count(DISTINCT b), round(count(DISTINCT b) / any_value(u2), 6), count(DISTINCT ref_ind) FROM q, t WHERE in_r2 GROUP BY 1
        UNION ALL SELECT ref_name, 'paired', count(*), round(count(*) / any_value(nb), 6), count(DISTINCT a || '|' || b), round(count(DISTINCT a || '|' || b) / any_value(ub), 6), count(DISTINCT ref_ind) FROM q, t WHERE in_r1 AND in_r2 GROUP BY 1""",
    "reads_index_sets": f"""WITH {_MATCH}, k AS (SELECT read_ind, bool_or(in_r1 AND in_r2) AS b, bool_or(in_r1) AS x, bool_or(in_r2) AS y FROM m GROUP BY 1)
        SELECT read_ind, CASE WHEN b THEN 'paired' WHEN x AND NOT y THEN 'r1_unpaired' WHEN y AND NOT x THEN 'r2_unpaired' ELSE 'apart' END AS kind FROM k""",
    "reads_report": f"""WITH {_MATCH}, k AS (SELECT read_ind, count(*) AS n, count(DISTINCT ref_name) AS n_names, string_agg(DISTINCT ref_name, ',' ORDER BY ref_name) AS names FROM m GROUP BY 1)
        SELECT n_names, names, count(*) AS n_reads, CAST(sum(n) AS BIGINT) AS n_matches FROM k GROUP BY 1, 2""",
    "pos_exploded": f"WITH {_LONG} SELECT * FROM l",
    "pos_joined": f"""WITH {_LONG}, w AS (SELECT read_ind, max(length(s)) AS w FROM s WHERE s <> '' GROUP BY 1)
        SELECT read_ind, seq_name, rpad(s, CAST(w AS INTEGER), '-') AS seq FROM s JOIN w USING (read_ind) WHERE s <> ''""",
    "pos_compared": f"WITH {_LONG} SELECT read_ind, seq_name, position, CASE WHEN seq_name = 'r1' OR ref_seq IS NULL THEN seq WHEN seq = ref_seq AND seq = '-' THEN seq WHEN seq = ref_seq THEN '.' WHEN seq = '-' THEN seq ELSE 'x' END AS seq FROM j",
    "pos_compared_both": f"""WITH {_LONG}, c AS (SELECT read_ind, seq_name, position, seq AS own, CASE WHEN seq_name = 'r1' OR ref_seq IS NULL OR seq <> ref_seq OR seq = '-' THEN seq ELSE '.' END AS seq FROM j),
        o AS (SELECT read_ind, position, count(*) FILTER (seq <> '.') AS n FROM c WHERE seq_name <> 'r1' GROUP BY 1, 2)
        SELECT c.read_ind, seq_name, c.position, CASE WHEN seq_name = 'r1' THEN CASE WHEN coalesce(n, 0) = 0 THEN '.' ELSE own END ELSE seq END AS seq FROM c LEFT JOIN o USING (read_ind, position)""",
    "pos_labels": f"""WITH {_LONG} SELECT read_ind, seq_name, position, CASE WHEN seq = ref_seq THEN 'match' WHEN seq = '-' THEN 'gap' WHEN ref_seq = '-' THEN 'insertion' ELSE 'mismatch' END AS label FROM j WHERE seq_name = 'r2' AND ref_seq IS NOT NULL""",
    "pos_summary": f"WITH {_LONG} SELECT read_ind, seq_name, count(*) AS n, min(position) AS first, max(position) AS last, CAST((min(position) + max(position)) // 2 AS INTEGER) AS middle FROM l GROUP BY 1, 2",
    "pos_cigar": f"""WITH {_PAIRS}, q AS (SELECT read_ind, r1_seq AS s, length(r1_seq) AS n FROM p WHERE length(r1_seq) >= 20),
        i AS (SELECT read_ind, s, n, CAST(unnest(range(1, n + 1)) AS INTEGER) AS i FROM q)
        SELECT read_ind, CAST(CASE WHEN i <= 10 THEN 97 + i ELSE 96 + i END AS INTEGER) AS position, s[i] AS seq FROM i WHERE i <= 10 OR i > 13
        UNION ALL SELECT read_ind, unnest([108, 109]), '-' FROM q""",
    "pos_consensus": f"""WITH {_LONG}, k AS (SELECT seq_name, position, seq, row_number() OVER (PARTITION BY seq_name, position ORDER BY count(*) DESC, seq) AS k FROM l WHERE seq IS NOT NULL GROUP BY 1, 2, 3)
        SELECT seq_name, string_agg(seq, '' ORDER BY position) AS seq FROM k WHERE k = 1 GROUP BY 1""",
    "pos_covered": f"""WITH {_LONG}, u AS (SELECT read_ind, position, CAST(row_number() OVER (PARTITION BY read_ind ORDER BY position) AS INTEGER) AS n FROM (SELECT DISTINCT read_ind, position FROM l WHERE seq_name <> 'r1' AND seq IS NOT NULL))
        SELECT read_ind, seq_name, n AS position, seq FROM l JOIN u USING (read_ind, position)""",
    "near_parts": """WITH p AS (SELECT DISTINCT p_name, p_type FROM part) SELECT a.p_name, a.p_type, b.p_name AS q_name, b.p_type AS q_type, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS lv
        FROM p a JOIN p b ON a.p_type = b.p_type AND levenshtein(a.p_name, b.p_name) <= 3""",
    "near_cdr3": f"""WITH t AS MATERIALIZED (SELECT chain, cdr3, length(cdr3) AS n FROM (SELECT DISTINCT CASE WHEN mate = 'r1' THEN 'TRA' ELSE 'TRB' END AS chain, {_AA.format(x="seq")} AS cdr3 FROM reads WHERE length(seq) >= 3))
        SELECT a.chain AS tcr_chain, a.cdr3 AS tcr_cdr3, b.chain AS vdj_chain, b.cdr3 AS vdj_cdr3, CAST(levenshtein(a.cdr3, b.cdr3) AS INTEGER) AS lv
        FROM t a JOIN (SELECT t.*, n + unnest(range(-3, 4)) AS near FROM t) b ON a.n = b.near WHERE levenshtein(a.cdr3, b.cdr3) <= 3""",
}
