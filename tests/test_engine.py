"""Golden cases, round trips and brute force for the sequence, annotation, read and cell operators."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seqexpr as S
from strandloom.functions.positions import rotate_position, rotate_sequence
from strandloom.operators import aggregates as G
from strandloom.operators import annotation as A
from strandloom.operators import clonotypes as C
from strandloom.operators import fuzzy, positions, reads, transcripts
from strandloom.operators.align import align_columns, align_pairs, best_alleles, multi_alignment, read_matrix, segment_span
from strandloom.plans import cell_queries, plotdata, read_queries
from strandloom.plans.annotation_queries import gtf_rotated
from strandloom.plans.read_queries import near_cdr3
from strandloom.sources import fasta, files
from strandloom.sources import gtf as gtf_files
from strandloom.sources.cellranger import read_clonotype_contigs, read_contigs


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("seq,want", [("aCGTN", "NACGT"), ("aCGTR-", "NNACGT"), ("", "")])
def test_revcomp(spark, seq, want):
    assert one(spark, S.revcomp("s"), s=seq) == want
    assert one(spark, S.revcomp(S.revcomp("s")), s="ACGTN") == "ACGTN"


def test_scalars(spark):
    assert one(spark, S.translate_dna("s"), s="ATGGCNtaaC") == "MX*"
    assert one(spark, S.translate_dna("s"), s="AT") == ""
    row = spark.createDataFrame([("II#",), ("",)], "q string").select("q", *S.quality_stats("q")).collect()
    assert (row[0].min_qual, round(row[0].mean_qual, 2), row[0].n_below) == (2, 27.33, 1) and row[1][1:] == (None, None, None)
    assert one(spark, S.phred("q"), q="II#") == [40, 40, 2]
    assert one(spark, S.wrap("s", 4), s="ACGTACGTA") == "ACGT\nACGT\nA"
    run = one(spark, S.longest_plain_run("s"), s="ACNGGTRA")
    assert (run.run, run.first, run.last) == ("GGT", 4, 6)
    assert one(spark, S.match_symbols("s"), s="AC-GTAC") == ".. ..|."[:2] + " " + "..|" [0:2] + "|" + "."
    for q in ("chr2:86,784,610-86,808,396", "chr2 86784610 86808396", "chr2,86784610,86808396"):
        assert tuple(one(spark, S.parse_region(F.lit(q)))) == ("chr2", 86784610, 86808396)
    assert tuple(one(spark, S.parse_region(F.lit("chr2:abc")))) == (None, None, None)
    assert one(spark, S.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert spark.createDataFrame([(None,)], "b boolean").select(S.any_false(F.col("b")).alias("x")).first().x is True
    types = spark.createDataFrame([("a", "ACGT"), ("a", "ACN"), ("b", "ACGU"), ("c", "MKLV")], "k string, s string").groupBy("k").agg(S.guess_type("s").alias("t")).collect()
    assert {r.k: r.t for r in types} == {"a": "DNA", "b": "RNA", "c": "AA"}


def test_amino_acid_classes(spark):
    assert [one(spark, S.aa_property(F.lit(c))) for c in "WYGCk*X"] == ["non polar aromtic", "non polar aromtic", "non polar", "polar", "basic pos charge", "stop", None]


def test_rotation(spark):
    xs = [one(spark, rotate_position(F.lit(x), 66, 100)) for x in (1, 65, 66, 91, 100)]
    assert xs == [36, 100, 1, 26, 35]
    assert one(spark, rotate_sequence(F.lit("ABCDE"), 3)) == "CDEAB"
    rows = spark.createDataFrame([(1, 60, 70), (2, 10, 20)], "line_no long, start long, end long")
    got = sorted((r.line_no, r.start, r.end, r.part) for r in A.rotate_rows(rows, 66, 100).collect())
    assert got == [(1, 1, 5, 2), (1, 95, 100, 1), (2, 45, 55, 1)]


def gtf_rows(spark, rows):
    cols = "line_no long, seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attribute string"
    return spark.createDataFrame([(i, s, "x", f, a, b, ".", st, ".", at) for i, (s, f, a, b, st, at) in enumerate(rows, 1)], cols)


def test_rotated_rows_beyond_the_given_length(spark, tmp_path):
    rows = [(1, "a", 100_000_001, 150_000_000), (2, "a", 1_000_000, 1_000_001), (3, "b", 1_000_000, 1_000_001), (4, None, 1, 120_000_000)]
    spark.createDataFrame(rows, "line_no long, seqname string, start long, end long").withColumn("exon_number", F.lit(1)).write.parquet(f"{tmp_path}/gtf.parquet")
    got = sorted((r.line_no, r.start, r.end, r.part) for r in gtf_rotated(spark, str(tmp_path)).collect())
    assert got == [(1, 99_000_001, 149_000_000, 1), (2, 1, 1, 2), (2, 150_000_000, 150_000_000, 1), (3, 1, 1, 2), (3, 100_000_000, 100_000_000, 1), (4, 1, 119_000_000, 2), (4, 119_000_001, 120_000_000, 1)]


def test_attributes(spark):
    parsed = spark.createDataFrame([('gene_id "A b; c"; gene_name "B";',), ('tag "x"; tag "y";',)], "a string").select(A.parse_attributes(F.col("a")).alias("p")).collect()
    assert [tuple(x) for x in parsed[1].p] == [("tag", "x"), ("tag", "y")]
    wide = A.with_attributes(gtf_rows(spark, [("1", "exon", 1, 2, "+", 'tag "x"; tag "y";')]), ["tag", "none"]).first()
    assert (wide.tag, wide.none) == ("x__y", None)
    again = spark.createDataFrame([("g 1", None)], "gene_id string, gene_name string").select(A.key_value_column(None, ["gene_id", "gene_name"]).alias("x")).first().x
    assert again == 'gene_id "g 1"; gene_name "NA"; '


def test_merge_and_names(spark):
    rows = gtf_rows(spark, [("1", "exon", 1, 10, "+", ""), ("1", "exon", 5, 12, "+", ""), ("1", "exon", 13, 14, "+", ""), ("1", "exon", 2, 3, "-", "")]).withColumn("g", F.concat(F.lit("g"), F.col("line_no")))
    got = sorted(tuple(r) for r in A.merge_overlapping(rows, ["g"], tile=4).collect())
    assert got == [("1", 1, 12, "+", "g1---g2---g4", 3), ("1", 13, 14, "+", "g3", 1)]
    names = spark.createDataFrame([(1, "g1", "X"), (2, "g2", "X"), (3, "g3", "Y"), (4, "g1", "X"), (5, None, "X")], "line_no long, gene_id string, gene_name string")
    assert [r.gene_name for r in A.fix_duplicate_names(names).orderBy("line_no").collect()] == ["X--1", "X--2", "Y", "X--1", "X"]
    ids = spark.createDataFrame([(1, "g", "X", "t"), (2, "g", "Y", "t"), (3, "h", "X", "t"), (4, "g", None, "t"), (5, None, "X", None)], "line_no long, gene_id string, gene_name string, transcript_id string")
    fixed = [tuple(r)[1:] for r in A.fix_duplicates(ids).orderBy("line_no").select("line_no", "gene_id", "gene_name", "transcript_id").collect()]
    assert fixed == [("g--1", "X--1", "t--1"), ("g--2", "Y", "t--2"), ("h", "X--2", "t--3"), ("g", None, "t--4"), (None, "X", None)]
    with pytest.raises(Exception, match="several gene names"):
        A.fill_gene_names(spark.createDataFrame([("g", "A"), ("g", "B")], "gene_id string, gene_name string"), strict=True).collect()


def test_best_cut(spark):
    def cut(spans):
        rows = spark.createDataFrame([("c", f"g{i}", a, b) for i, (a, b) in enumerate(spans)], "seqname string, gene_id string, start long, end long")
        r = A.best_cuts(rows, F.lit(100)).first()
        return r.cut, r.gap_size

    assert cut([(1, 20), (31, 40), (91, 95)]) == (65, 50)
    assert cut([(41, 50), (52, 60)]) == (100, 80)


def test_coverage_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "c", a, a + rng.randint(0, 9)) for i, a in enumerate(rng.randint(1, 60) for _ in range(40))]
    df = spark.createDataFrame(rows, "line_no long, seqname string, start long, end long")
    depth = {}
    for _, _, a, b in rows:
        for p in range(a, b + 1):
            depth[p] = depth.get(p, 0) + 1
    got = {}
    for r in A.coverage_runs(df).collect():
        for p in range(r.first, r.last + 1):
            assert p not in got
            got[p] = r.depth
    assert got == depth


def test_transcript(spark):
    genome = spark.createDataFrame([("c", "GGATGCCCGTAAGTTTTAGGG")], "seqname string, seq string")
    rows = [("c", "exon", 3, 8, "t"), ("c", "exon", 13, 18, "t"), ("c", "CDS", 3, 8, "t"), ("c", "CDS", 13, 15, "t")]
    df = spark.createDataFrame([(i, s, f, a, b, "+", t, None) for i, (s, f, a, b, t) in enumerate(rows)], "line_no long, seqname string, feature string, start long, end long, strand string, transcript_id string, exon_number long")
    seqs = {r.kind: r.seq for r in transcripts.transcript_sequences(df, genome).collect()}
    assert seqs == {"pre_mRNA": "ATGCCCGTAAGTTTTA", "mRNA": "ATGCCCGTTTTA", "CDS": "ATGCCCGTT"}
    minus = {r.kind: r.seq for r in transcripts.transcript_sequences(df.withColumn("strand", F.lit("-")), genome).collect()}
    assert minus["mRNA"] == "TAAAACGGGCAT"
    labels = {r.label for r in transcripts.labelled_features(df).collect()}
    assert "intron01" in labels
    checks = transcripts.checked_transcripts(transcripts.transcript_sequences(df, genome)).first()
    assert (checks.starts, checks.stops, checks.whole) == (True, False, True)


def test_positions(spark):
    long = positions.explode_positions(spark.createDataFrame([("a", "--AC-G-"), ("b", ""), ("c", None)], "name string, s string"), ["name"], "s")
    assert [r.seq for r in long.orderBy("position").collect()] == [None, None, "A", "C", "-", "G", None]
    back = positions.join_positions(long, ["name"]).collect()
    assert [r.seq for r in back] == ["--AC-G-"]
    two = positions.explode_positions(spark.createDataFrame([("r", "ACG-"), ("p", "ATG-"), ("q", "ATGC")], "name string, s string"), ["name"], "s", terminal_gaps_null=False)
    text = lambda df, n, c="seq": "".join(r[c] or "?" for r in df.where(F.col("name") == n).orderBy("position").collect())
    assert text(positions.compare_to_reference(two, [], "name", F.lit("r")), "p") == ".T.-"
    assert text(positions.compare_to_reference(two, [], "name", F.lit("r"), mismatch="x"), "p") == ".x.-"
    assert text(positions.compare_to_reference(two, [], "name", F.lit("r"), change_ref=True), "r") == ".C.-"
    aln = positions.explode_positions(spark.createDataFrame([("r", "AC-G"), ("p", "ATG-")], "name string, s string"), ["name"], "s", terminal_gaps_null=False)
    labels = positions.label_matches(aln, [], "name", F.lit("r")).orderBy("position").collect()
    assert [r.label for r in labels] == ["match", "mismatch", "insertion", "gap"]
    with pytest.raises(Exception, match="no single longest"):
        positions.longest_as_reference(two.withColumn("k", F.lit(1)), ["k"], "name").collect()


def test_cigar(spark):
    df = spark.createDataFrame([("a", "2S3M1I2M2D1M", 10, "AACCCGTTA"), ("b", "3Q", 1, "AAA"), ("c", "2H2MN1M", 5, "ACG")], "name string, cigar string, start int, s string")
    rows = positions.cigar_positions(df, ["name"], "cigar", "start", "s").orderBy("name", "position").collect()
    assert [(r.position, r.seq) for r in rows if r.name == "a"] == [(8, "A"), (9, "A"), (10, "C"), (11, "C"), (12, "C"), (13, "T"), (14, "T"), (15, "-"), (16, "-"), (17, "A")]
    assert [(r.position, r.seq) for r in rows if r.name == "c"] == [(5, "A"), (6, "C"), (7, None), (8, "G")]
    assert not [r for r in rows if r.name == "b"]


def test_alignment_golden():
    cases = [("ACGT", "CG", 2, "ACGT", "-CG-"), ("AAACCCGGG", "CCCGGGTTT", 6, "AAACCCGGG---", "---CCCGGGTTT"), ("ACGTACGT", "ACGACGT", 6, "ACGTACGT", "ACG-ACGT")]
    got = align_pairs([c[0] for c in cases], [c[1] for c in cases])
    assert [(r[0], r[1], r[2]) for r in got] == [c[2:] for c in cases]
    assert align_pairs([None, "A", ""], ["A", "", ""])[0] is None
    assert align_pairs(["ACGT"], ["ACG"], mode="global")[0][:3] == (2.0, "ACGT", "ACG-")
    assert align_pairs(["TTACGTT"], ["GGACGGG"], mode="local", mismatch=-2, gap_extend=-2)[0][1:3] == ("ACG", "ACG")
    assert align_pairs(["ACGT"], ["TTTT"], least=3)[0][1] is None
    assert align_pairs(["CGT"], ["AACGTTT"], mode="global-local")[0] == (3.0, "CGT", "CGT", 1, 3, 3, 5)
    assert align_pairs(["AACGTTT"], ["CGT"], mode="local-global")[0] == (3.0, "CGT", "CGT", 3, 5, 1, 3)
    assert align_pairs(["CGGT"], ["AACGTTT"], mode="global-local")[0][:3] == (2.0, "CGGT", "C-GT") or align_pairs(["CGGT"], ["AACGTTT"], mode="global-local")[0][0] == 2.0
    with pytest.raises(ValueError, match="unknown mode"):
        align_pairs(["A"], ["A"], mode="globel")


def test_alignment_brute_force():
    rng = random.Random(4)

    def best(a, b, gap, ext):
        low = -(10**9)
        m = [[[low] * 3 for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
        m[0][0][0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i and j:
                    m[i][j][0] = max(m[i - 1][j - 1]) + (1 if a[i - 1] == b[j - 1] else -1)
                if i:
                    m[i][j][1] = max(max(m[i - 1][j][0], m[i - 1][j][2]) + gap + ext, m[i - 1][j][1] + ext)
                if j:
                    m[i][j][2] = max(max(m[i][j - 1][0], m[i][j - 1][1]) + gap + ext, m[i][j - 1][2] + ext)
        return max(m[-1][-1])

    pairs = [("".join(rng.choice("ACG") for _ in range(rng.randint(1, 9))), "".join(rng.choice("ACG") for _ in range(rng.randint(1, 9)))) for _ in range(60)]
    for gap, ext in ((0, -1), (-3, -1)):
        for (a, b), r in zip(pairs, align_pairs([p[0] for p in pairs], [p[1] for p in pairs], mode="global", gap_open=gap, gap_extend=ext)):
            assert r[0] == best(a, b, gap, ext)
            assert r[1].replace("-", "") == a and r[2].replace("-", "") == b and len(r[1]) == len(r[2])


def test_multi_alignment(spark):
    df = spark.createDataFrame([("p1", "ACGGT", "ACGT"), ("p2", "CGT", "ACGT")], "name string, p string, s string")
    done = align_columns(df, ["name"], "p", "s").withColumn("g", F.lit(1))
    rows = multi_alignment(done, spark.createDataFrame([(1, "ACGT")], "g int, subject_seq string"), ["g"], "name").collect()
    line = {n: "".join(r.seq for r in sorted((r for r in rows if r.name == n), key=lambda r: r.position)) for n in ("subject", "p1")}
    assert line["p1"] == "ACGGT" and line["subject"].replace("-", "") == "ACGT" and len(line["subject"]) == 5
    refs = spark.createDataFrame([("TRAV1-1", "TRAV1-1*01", "ACGTACGT"), ("TRAV1-1", "TRAV1-1*02", "ACGTTCGT")], "gene string, allele string, ref_seq string")
    best = best_alleles(spark.createDataFrame([(7, "GGACGTTCGTGG", "TRAV1-2")], "id int, seq string, v string"), refs, ["id"], "seq", "v", mismatch=-3, gap_open=-10, gap_extend=-4).first()
    assert (best.allele, best.score) == ("TRAV1-1*02", 8.0)


def test_segment_span(spark):
    refs = spark.createDataFrame([("TRAV1", "TRAV1*01", "ACGTACGTAC"), ("TRAV1", "TRAV1*02", "ACGTTCGTAC"), ("TRAJ2", "TRAJ2*01", "GGCCGGCC")], "gene string, allele string, ref_seq string")
    seqs = spark.createDataFrame([("TTACGTTCGTACAAAGGCCGGCCTT", "TRAV1", "TRAJ2")] * 2 + [("AAAA", "TRAV1", "TRAJ2"), (None, "TRAV1", "TRAJ2")], "seq string, v_gene string, j_gene string")
    r = segment_span(seqs, refs, mismatch=-3, gap_open=-10, gap_extend=-4).collect()
    assert [(x.v_allele, x.v_start, x.v_end, x.j_start, x.j_end, x.v_to_j) for x in r] == [("TRAV1*02", 3, 12, 16, 23, "ACGTTCGTACAAAGGCCGGCC")]


def test_match_with_mismatches_brute_force(spark):
    rng = random.Random(6)
    refs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(8)]
    seqs = []
    for _ in range(80):
        r, n = rng.choice(refs), rng.choice([3, 6, 14, 30])
        at = rng.randint(0, 60 - n)
        s = list(r[at : at + n])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(n)] = rng.choice("ACGT")
        seqs.append("".join(s))
    q = spark.createDataFrame([(s,) for s in seqs] + [("",), (None,)], "seq string")
    d = spark.createDataFrame(list(enumerate(refs)), "ref_ind int, ref_seq string")
    for most in (0, 2, 0.1):
        k = lambda s: min(int(len(s) * most) if most < 1 else most, len(s) - 1)
        want = {(s, i) for s in seqs for i, r in enumerate(refs) if any(sum(a != b for a, b in zip(s, r[j : j + len(s)])) <= k(s) for j in range(len(r) - len(s) + 1))}
        assert {(r.seq, r.ref_ind) for r in reads.match_sequences(q, d, most).collect()} == want


def test_edit_join_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("AB") for _ in range(rng.randint(0, 9))) for _ in range(70)]
    a, b = spark.createDataFrame([(w,) for w in words], "x string"), spark.createDataFrame([(w,) for w in words[::2]] + [(None,)], "y string")

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return row[-1]

    for k in (0, 1, 3):
        want = {(s, t, lev(s, t)) for s in words for t in words[::2] if lev(s, t) <= k}
        assert {(r.x, r.y, r.lv) for r in fuzzy.edit_join(a, b, "x", "y", k).collect()} == want
    tcr = spark.createDataFrame([("tra", "cassf"), ("TRB", "QQQQQQQ")], "chain string, cdr3 string")
    known = spark.createDataFrame([("TRA", "CASTF"), ("TRB", "CASTF")], "chain string, cdr3 string")
    assert [(r.tcr_cdr3, r.lv) for r in fuzzy.cdr3_hits(tcr, known).collect()] == [("CASSF", 1)]
    assert len(fuzzy.cdr3_hits(tcr, known, 3, (False, True)).collect()) == 2
    assert fuzzy.chain_column(tcr, ["cdr3", "chain"]) == "chain"
    near = fuzzy.nearest_names(spark.createDataFrame([("TRAV12-1",)], "q string"), spark.createDataFrame([("TRAV12-2",), ("TRAV12-3",), ("TRAV1-1",)], "n string"), "q", "n").collect()
    assert sorted(r.n for r in near) == ["TRAV12-2", "TRAV12-3"]


def test_a_shared_beginning_is_dealt_out(spark, monkeypatch):
    """Sequences that begin alike meet in one segment: it is cut into parts, and no pair is lost or doubled."""
    from strandloom.operators import spread

    rng = random.Random(14)
    words = sorted({"CASS" + "".join(rng.choice("ACDEF") for _ in range(rng.randint(4, 7))) for _ in range(150)})
    a = spark.createDataFrame([(w,) for w in words], "x string")
    plain = {tuple(r) for r in fuzzy.edit_join(a, a.withColumnRenamed("x", "y"), "x", "y", 3).collect()}
    joined = spread.spread_join(a.selectExpr("x", "'k' as k"), a.selectExpr("x as y", "'k' as k"), ["k"], hot=7)
    pairs = [(r.x, r.y) for r in joined.collect()]
    assert len(pairs) == len(set(pairs)) == len(words) ** 2
    monkeypatch.setattr(spread.spread_join, "__defaults__", (5,))
    assert {tuple(r) for r in fuzzy.edit_join(a, a.withColumnRenamed("x", "y"), "x", "y", 3).collect()} == plain


def test_similarity_by_a_matrix(spark, tmp_path):
    (tmp_path / "m").write_text("# made\n   A  C  D\nA  6 -3 -2\nC -3  9 -9\nD -2 -9  8\n")
    hits = spark.createDataFrame([("ACD", "ACD", 0), ("ACD", "AD", 1), ("AAD", "ADD", 1), (None, "A", 1)], "vdj_cdr3 string, tcr_cdr3 string, lv int")
    got = {(r.vdj_cdr3, r.tcr_cdr3): (r.PAM30, r.PAM30_corr) for r in fuzzy.with_similarity(hits, read_matrix(str(tmp_path / "m"))).collect()}
    assert got == {("ACD", "ACD"): (23.0, 1.0), ("ACD", "AD"): (0.0, 0.0), ("AAD", "ADD"): (12.0, 12 / 21), (None, "A"): (None, None)}


def test_read_statistics_forms(spark):
    pairs = spark.createDataFrame([(1, "A", "C"), (2, "A", None), (3, None, "G"), (4, "A", "C")], "read_ind long, r1_seq string, r2_seq string")
    stats = reads.read_statistics(pairs)
    assert {r.read: tuple(r)[1:] for r in stats.collect()} == {"r1": (4, 1, 0.25), "r2": (4, 2, 0.5), "paired": (2, 1, 0.5)}
    long = {r.stat: r.value for r in reads.statistics_long(stats, [], "read").collect()}
    wide = reads.statistics_wide(stats, [], "read").first().asDict()
    assert long == wide and len(wide) == 9


def test_chunks_of_long_sequences(spark):
    df = spark.createDataFrame([("a", "ACGTACGTA"), ("é", "xé" * 5), ("n", None), ("e", "")], "seqname string, seq string")
    got = sorted((r.seqname, r.chunk_no, r.seq) for r in positions.chunk_sequences(df, 4, 2).collect())
    assert got == [("a", 0, "ACGTAC"), ("a", 1, "ACGTA"), ("a", 2, "A"), ("é", 0, "xéxéxé"), ("é", 1, "xéxéxé"), ("é", 2, "xé")]


def test_near_reads_brute_force(spark, tmp_path):
    rng = random.Random(3)
    amino = {"A": "GCT", "C": "TGT", "D": "GAT", "F": "TTT"}
    words = ["".join(rng.choice("ACDF") for _ in range(n)) for n in (1, 2, 5, 11, 20, 25) for _ in range(3)]
    words += [w[:-1] + "F" for w in words] + [w[:15] + w[16:18] + "A" + w[19:] for w in words]
    rows = [(i, rng.choice(["r1", "r2"]), "".join(amino[c] for c in w)) for i, w in enumerate(words)] + [(99, "r1", "GC"), (98, "r2", None)]
    spark.createDataFrame(rows, "read_ind long, mate string, seq string").write.parquet(f"{tmp_path}/reads.parquet")

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return row[-1]

    own = {("TRA" if m == "r1" else "TRB", w) for (_, m, _), w in zip(rows, words)}
    want = sorted((*a, *b, lev(a[1], b[1])) for a in own for b in own if lev(a[1], b[1]) <= 3)
    assert sorted(map(tuple, near_cdr3(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("values,want", [(["a"], True), ([None, "a"], True), (["a", "b"], False), (["a", "a,b"], False), ([None, "a", "b", "a,b"], True), ([None, "a", "a,b"], True), ([None, "a", "b,c"], False), ([None, "a", "b"], False), ([None], True)])
def test_collapse_rules(spark, values, want):
    rows = [("s", "TRB1", v, f"n{i}") for i, v in enumerate(values)] + [("s", "TRB1", values[0], "n9")]
    df = spark.createDataFrame(rows, "sample string, cdr3_TRB string, cdr3_TRA string, cl_name string")
    got = {r.cl_name for r in C.collapse_clonotypes(df, ["cdr3_TRB", "sample"]).collect()}
    assert (len(got) == 1) is want and (got == {"n0"}) is want


def test_naming_keeps_cells(spark):
    rng = random.Random(9)
    rows = [(f"P0{rng.randint(1, 3)}_{rng.randint(1, 2)}_blood", i // 2, rng.choice(["TRA", "TRB"]), rng.choice("abcdefgh")) for i in range(200)]
    cells = spark.createDataFrame(rows, "sample string, barcode long, chain string, cdr3 string").distinct()
    named = C.name_clonotypes(cells)
    assert sorted((r.sample, r.barcode) for r in named.collect()) == sorted((r.sample, r.barcode) for r in C.wide_cells(cells).collect())
    assert C.name_changes(named, named).where("old_name <> new_name").count() == 0
    names = [r.name for r in C.pick_names(50, spark, avoid=["Baba"], forbidden="z").collect()]
    assert len(set(names)) == 50 and not any("z" in n.lower() or len(n) < 4 for n in names)


def test_cells_of_whole_reads(spark, tmp_path):
    rows = [("p_1_b", 1, "r1", "ATGGCTGATTTT"), ("p_1_b", 1, "r1", "ATGGCTGATTGTTT"), ("p_1_b", 1, "r2", "TTTTTTTTTGCT"), ("p_1_b", 2, "r1", "ATGGCT"), ("p_1_b", 2, "r2", "TTTTTTTTTGAT"), ("p_1_b", 3, "r1", "AT")]
    spark.createDataFrame(rows, "sample string, read_ind long, mate string, seq string").write.parquet(f"{tmp_path}/reads.parquet")
    got = sorted((r.barcode, r.cdr3_TRA, r.cdr3_TRB) for r in cell_queries.cells_wide(spark, str(tmp_path)).collect())
    assert got == [(1, "MADC,MADF", "FFFA"), (2, "MA", "FFFD")]


def test_general_helpers(spark):
    df = spark.createDataFrame([(1, "AC"), (2, "GT"), (3, "AC")], "o long, s string")
    got = sorted(tuple(r) for r in G.collapse_duplicates(df, "s", "o").collect())
    assert got == [("unique seq 1 (2)", "AC", 2), ("unique seq 2 (1)", "GT", 1)]
    unique = G.make_unique(spark.createDataFrame([(1, "x"), (2, "x"), (3, "x.1"), (4, "x")], "o long, n string"), "n", "o", "u")
    names = [r.u for r in unique.orderBy("o").collect()]
    assert len(set(names)) == 4 and names[0] == "x" and names[2] == "x.1"
    s = G.exact_sample(spark.range(103).withColumnRenamed("id", "k"), 0.1, "k")
    assert s.count() == 10 and G.exact_sample(spark.range(5).withColumnRenamed("id", "k"), 50, "k").count() == 5
    far = spark.range(500).selectExpr("if(id = 7, -(1L << 60), id * id) as o")
    assert sorted((r.o, r.k) for r in G.with_rank(far, "o", "k", parts=16).collect()) == [(o, i) for i, o in enumerate(sorted([-(1 << 60), *[i * i for i in range(500) if i != 7]]), 1)]
    ranked = G.with_rank(spark.createDataFrame([(None, "a"), (5, "a"), (2, "a"), (9, None)], "o long, g string"), "o", "r", ["g"], parts=2).collect()
    assert sorted((r.o, r.g, r.r) for r in ranked if r.o is not None) == sorted([(2, "a", 1), (5, "a", 2), (9, None, 1)], key=str) or {(r.o, r.r) for r in ranked if r.o} == {(2, 1), (5, 2), (9, 1)}


def test_plot_tables(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 5, 8), ("a", 12, 20), ("a", 9, 11), ("b", 1, 2)], "g string, s int, e int")
    got = {(r.g, r.s): r.y for r in plotdata.pack_rows(rows, ["g"], "s", "e").collect()}
    assert got == {("a", 1): 1, ("a", 5): 2, ("a", 9): 2, ("a", 12): 1, ("b", 1): 1}
    assert plotdata.integer_breaks(0, 100) == [0, 20, 40, 60, 80, 100]
    text = plotdata.printed_alignment(spark.createDataFrame([(1, "AC-GTA", "ACTGAA")], "i int, p string, s string"), ["i"], "p", "s", 100, dots=True).first().text
    assert text.split("\n")[1:3] == ["pattern ..-.T.", "subject ACTGAA"]


def test_mates_of_unequal_length(spark, tmp_path):
    rows = [(1, "r1", "ACGTACGT"), (1, "r2", "ACGACGT"), (2, "r1", "ACGT"), (2, "r2", None)]
    df = spark.createDataFrame([(*r, "I", 1) for r in rows], "read_ind long, mate string, seq string, qual string, arrived_at long")
    df.write.parquet(f"{tmp_path}/reads.parquet")
    (printed,) = cell_queries.printed_mates(spark, str(tmp_path)).collect()
    assert (printed.read_ind, printed.block) == (1, 0) and printed.text.split("\n")[1:3] == ["pattern ACGTACGT", "subject ACG-ACGT"]
    assert [(r.read_ind, r.ruler, r.dotted) for r in read_queries.seq_rulers(spark, str(tmp_path)).collect()] == [(1, "....|...", "...ACGT")]


def test_dots_of_empty_sequences(spark):
    assert one(spark, S.dots_for_matches(F.col("p"), F.col("s")), p="", s="") == ""
    assert one(spark, S.dots_for_matches(F.col("p"), F.col("s")), p="ACG", s="AT") == ".CG"


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr2 two\nACGT\nAC\n;note\n>chr10\nNNGGN\n>chrX\nA\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z 1\nAC\nGT\n")
    (tmp_path / "plain.txt").write_text("ACGT\nAC\n")
    rows = {r.seqname: r.seq for r in fasta.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")], comment=";").collect()}
    assert rows == {"chr2": "ACGTAC", "chr10": "NNGGN", "chrX": "A", "z": "ACGT"}
    bare = fasta.read_fasta(spark, str(tmp_path / "plain.txt"), headerless=True).first()
    assert (bare.name, bare.seq) == ("plain", "ACGTAC")
    index = fasta.fasta_index(spark, str(tmp_path / "a.fa")).orderBy("start_line").collect()
    assert [(r.seqname, r.start_line, r.end_line, r.n_seq_lines) for r in index] == [("chr2", 1, 4, 3), ("chr10", 5, 6, 1), ("chrX", 7, 8, 1)]
    fasta.write_fasta(spark.createDataFrame([(1, "x", "ACGTA"), (2, None, "")], "o int, name string, seq string"), str(tmp_path / "out"), width=3, order="o")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text.startswith(">x\nACG\nTA\n>seq_")
    seqs = fasta.read_fasta(spark, str(tmp_path / "a.fa"), comment=";").select("seqname", "seq")
    fasta.store_genome(seqs, str(tmp_path / "g"), size=2)
    asked = spark.createDataFrame([("chr2:2-5",), ("chr1O:3-4",), ("qhr2:1-2",), ("nothing",), ("chrX:5-9",)], "query string")
    got = {r.query: (r.seqname, r.seq) for r in fasta.genome_region(spark, str(tmp_path / "g"), asked, size=2).collect()}
    assert got == {"chr2:2-5": ("chr2", "CGTA"), "chr1O:3-4": ("chr10", "GG"), "qhr2:1-2": ("chr2", "AC"), "nothing": (None, None), "chrX:5-9": ("chrX", None)}
    ends = {r.seqname: (r.leading_n, r.trailing_n) for r in spark.read.parquet(str(tmp_path / "g/lengths")).collect()}
    assert ends["chr10"] == (2, 1)


def test_gtf_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#!x\n1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g1"; gene_name "N";\nMT\ts\texon\t2\tz\t.\t-\t.\tgene_id "g2";\n')
    rows = gtf_files.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert [(r.seqname, r.start, r.end) for r in rows.orderBy("line_no").collect()] == [("1", 1, 9), ("MT", 2, None)]
    gtf_files.write_gtf(rows, str(tmp_path / "out"), header=["made"])
    again = gtf_files.read_gtf(spark, str(tmp_path / "out"))
    assert again.count() == 2 and again.orderBy("line_no").first().attribute == 'gene_id "g1"; gene_name "N";'
    gtf_files.store_gtf(rows, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/rows")).where("seqname = '1'").count() == 1
    genome = spark.createDataFrame([("chr1", "ACGT"), ("chrM", "GG"), ("scaf", "T")], "seqname string, seq string")
    seqs, lines, report = gtf_files.combine_references([genome], [rows])
    assert sorted(r.name for r in seqs.collect()) == ["chr1 1", "chrM MT"] and lines.count() == 2
    assert {(r.seqname, r.in_gtf) for r in report.collect()} == {("chr1", True), ("chrM", True), ("scaf", False)}
    with pytest.raises(ValueError, match="twice"):
        gtf_files.combine_references([genome, genome], [rows, rows])


def bam_record(name, ref, pos, flag, cigar, seq, qual, tags):
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def test_read_formats(spark, tmp_path):
    for m in (1, 2):
        (tmp_path / f"r{m}.fastq").write_text("".join(f"@q{i}\nACG{'T' * m}\n+\n@III{'I' * (m - 1)}\n" for i in range(3)))
    pair = files.read_fastq_pair(spark, str(tmp_path / "r1.fastq"), str(tmp_path / "r2.fastq")).orderBy("read_ind").collect()
    assert [(r.read_ind, r.r1_seq, r.r2_seq, r.r1_qual) for r in pair][0] == (0, "ACGT", "ACGTT", "@III") and len(pair) == 3
    header = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    with gzip.open(tmp_path / "x.bam", "wb") as f:
        f.write(header + bam_record("a", 0, 9, 16, [(3, "M")], "ACG", [40, 40, 2], b"CBZAAA\0NHC\1") + bam_record("b", -1, -1, 4, [], "A", [30], b""))
    rows = {r.qname: r for r in files.read_bam(spark, str(tmp_path / "x.bam"), tags=["CB", "NH"]).collect()}
    a = rows["a"]
    assert (a.rname, a.strand, a.pos, a.cigar, a.seq, a.qual, a.CB, a.NH, a.n_below) == ("chr1", "-", 10, "3M", "ACG", "II#", "AAA", "1", 1)
    assert (rows["b"].strand, rows["b"].pos) == (None, None)
    turned = files.read_bam(spark, str(tmp_path / "x.bam"), [("chr1", 1, 20)], revcomp_minus=True).collect()
    assert [(r.seq, r.qual, r.qwidth, r.genomic_range) for r in turned] == [("CGT", "#II", 3, "chr1:1-20")]
    over = lambda *ranges: [r.genomic_range for r in files.read_bam(spark, str(tmp_path / "x.bam"), list(ranges)).collect()]
    # positions 10 to 12: a read that reaches into a range belongs to it, and to each one
    assert over(("chr1", 12, 90)) == ["chr1:12-90"] and over(("chr1", 13, 90), ("chr1", 1, 9), ("chr2", 1, 90)) == [] and over(("chr1", 1, 10), ("chr1", 11, 11)) == ["chr1:1-10", "chr1:11-11"]
    assert one(spark, files.reference_length(F.col("c")), c="2S3M1I2D4N1=1X5H") == 11


def test_genbank_and_json(spark, tmp_path):
    text = (
        "LOCUS       X 20 bp\nVERSION     X1.1\nFEATURES             Location/Qualifiers\n     gene            complement(join(2..5,\n                     8..9))\n                     /gene=\"ab\"\n"
        '                     /note="one\n                     two"\n     CDS             1..3\n                     /product="p"\nORIGIN\n        1 acgtacgtac gtac\n//\n'
    )
    (tmp_path / "x.gb").write_text(text)
    features, seqs = files.read_genbank(spark, str(tmp_path / "x.gb"))
    rows = [tuple(r) for r in features.collect()]
    assert ("X1.1", "gene", "gene", "2..5,8..9", True, "ab") in rows and ("X1.1", "gene", "note", "2..5,8..9", True, "onetwo") in rows
    assert [tuple(r) for r in seqs.collect()] == [("X1.1", "ACGTACGTACGTAC")]
    made, gtf = gtf_files.features_to_reference(features.where("subfeature in ('gene', 'product')"), seqs, ["gene", "CDS"])
    assert sorted((r.start, r.end, r.strand) for r in gtf.collect()) == [(1, 3, "+"), (2, 9, "-")]
    flat = files.flatten_json(spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "c": null}'), (2, "no")], "i int, j string"), ["i"], "j").collect()
    assert sorted((r.i, r.path, r.value) for r in flat if r.value) == [(1, "a.b.0", "1"), (1, "a.b.1", "x"), (2, "!", "no")]


def test_cell_folders(spark, tmp_path):
    folder = tmp_path / "S1"
    folder.mkdir()
    (folder / "filtered_contig_annotations.csv").write_text("barcode,contig_id,chain,cdr3,raw_clonotype_id,raw_consensus_id\nAA-1,c1,TRA,CAV,clonotype1,clonotype1_consensus_1\nBB-1,c2,TRB,CAS,,\n")
    (folder / "filtered_contig.fasta").write_text(">c1\nACGT\n>c2\nGG\n")
    (folder / "consensus_annotations.csv").write_text("clonotype_id,consensus_id,chain,cdr3,cdr3_nt\nclonotype1,clonotype1_consensus_1,TRA,CAV,TGTGCA\n")
    (folder / "consensus.fasta").write_text(">clonotype1_consensus_1\nTTTT\n")
    (folder / "concat_ref.fasta").write_text(">clonotype1_consensus_1\nCCCC\n")
    rows = {r.contig_id: r for r in read_contigs(spark, str(tmp_path)).collect()}
    assert (rows["c1"].barcode, rows["c1"].contig_seq, rows["c1"].consensus_seq, rows["c1"].consensus_cdr3_nt, rows["c1"].sample) == ("AA", "ACGT", "TTTT", "TGTGCA", "S1")
    assert rows["c2"].consensus_seq is None
    old = {r.contig_id: r for r in read_clonotype_contigs(spark, str(tmp_path)).collect()}
    assert old["c1"].reference_seq == "CCCC" and old["c2"].cdr3 is None


def test_segments(spark):
    rec = spark.createDataFrame([("ac1|TRAV1*01|Homo|F|V-REGION", "atg.gccTGT")], "name string, seq string")
    r = transcripts.segment_reference(rec).first()
    assert (r.gene, r.allele_number, r.seq_aa) == ("TRAV1", "01", "MAC")
    placed = transcripts.segment_reference(rec, spark.createDataFrame([("TRAV1*01", "CDR", "AC"), ("TRAV1*01", "no", "WW")], "allele string, region string, aa string")).collect()
    assert {p.region: (p.aa_start, p.nt_start, p.nt_end) for p in placed} == {"CDR": (2, 4, 9), "no": (None, None, None)}


def test_queries_and_oracles_agree_in_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
