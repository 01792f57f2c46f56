"""Operators that once moved or compared far more than they give out: their plans stay narrow and their results whole."""

import random

from pyspark.sql import functions as F

from strandloom.operators import align, fuzzy, reads  # noqa: F401


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_multi_alignment_moves_whole_strings_once(spark, monkeypatch):
    """Letters aren't shuffled: one exchange of aligned strings, also if the subjects are a column; many patterns of one subject go over several batches."""
    monkeypatch.setattr(align, "LETTERS", 40)
    rng = random.Random(21)
    text = lambda low, high: "".join(rng.choice("ACG") for _ in range(rng.randint(low, high)))
    subjects = {g: text(0, 12) for g in range(8)}
    rows = [(g, f"n{i}", text(0, 14) if i % 9 else None, subjects[g]) for i, g in enumerate([rng.randrange(8) for _ in range(60)] + [3] * 60)]
    done = align.align_columns(spark.createDataFrame(rows, "g int, name string, p string, s string"), ["g", "name", "s"], "p", "s")
    want = []
    for g, s in subjects.items():
        own, columns = [], {(k + 1, 0) for k in range(len(s))}
        for _, name, p, _ in (r for r in rows if r[0] == g and r[2] is not None):
            _, a, b, _, _, start, _ = align.align_pairs([p], [s])[0]
            place, insert = start - 1, 0
            for x, y in zip(a, b):
                place, insert = (place, insert + 1) if y == "-" else (place + 1, 0)
                own.append((name, place, insert, x))
                columns.add((place, insert))
        if any(r[0] == g for r in rows) and s:
            own += [("subject", k + 1, 0, c) for k, c in enumerate(s)] + [("subject", *c, "-") for c in columns if c[1]]
        rank = {c: k + 1 for k, c in enumerate(sorted(columns))}
        want += [(g, name, rank[place, insert], None if insert else place, x) for name, place, insert, x in own]
    by_column = align.multi_alignment(done, "s", ["g"], "name")
    assert sorted(map(tuple, by_column.collect()), key=str) == sorted(want, key=str)
    by_table = align.multi_alignment(done, spark.createDataFrame(list(subjects.items()), "g int, subject_seq string"), ["g"], "name")
    assert sorted(map(tuple, by_table.collect()), key=str) == sorted(want, key=str)
    assert _plan(by_table).count("Exchange hashpartitioning") == 1 and "Window" not in _plan(by_table)


def test_pairs_without_qualities(spark):
    rows = [(1, "r1", "ACG", "!!!", 2), (1, "r1", "AAA", "###", 2), (1, "r1", "GGG", None, 3), (1, "r2", None, "##", 1), (2, "r2", "C", "#", None), (None, "r1", "T", "#", 1)]
    r = spark.createDataFrame(rows, "read_ind long, mate string, seq string, qual string, arrived_at int")
    lean = reads.pair_reads(r, ("seq",))
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, reads.pair_reads(r).select("read_ind", "r1_seq", "r2_seq").collect()))
    assert lean.columns == ["read_ind", "r1_seq", "r2_seq"]


def test_nearest_names_brute_force(spark):
    """Near, farther and far names, in a block without a beginning and in others, upper and lower case: all at the least distance."""
    rng = random.Random(22)
    some = lambda n: {rng.choice(["", "ab1", "MT-", "Trav12"]) + "".join(rng.choice("xyZ-") for _ in range(rng.randint(0, 7))) for _ in range(n)}
    asked, known = sorted(some(70)) + ["-" * 15, "ab1" + "q" * 9], sorted(some(50))

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    import re

    block = lambda s: (re.match("[a-z]+[0-9]+", s.lower()) or [""])[0]
    want = set()
    for a in asked:
        of = [(lev(a.lower(), b.lower()), b) for b in known if block(a) == block(b)]
        want |= {(a, b, v) for v, b in of if v == min(of)[0]}
    assert max(v for _, _, v in want) > 3
    a, b = spark.createDataFrame([(x,) for x in asked + asked[:3] + [None]], "a string"), spark.createDataFrame([(x,) for x in known], "b string")
    got = [tuple(r) for r in fuzzy.nearest_names(a, b, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_names_of_a_large_block(spark, monkeypatch):
    """3,000 names without a number at their beginning: those one edit away are met without comparing all with all."""
    names = spark.range(3000).select(F.concat(F.lit("MT-x"), F.sha1(F.col("id").cast("string")).substr(1, 10)).alias("b"))
    asked = names.select(F.concat("b", F.lit("x")).alias("a"))
    compared, join = [], fuzzy.spread_join

    def counted(*args):
        out = join(*args)
        compared.append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "spread_join", counted)
    got = fuzzy.nearest_names(asked, names, "a", "b")
    assert got.where("a = concat(b, 'x') and lv = 1").count() == got.count() == 3000
    assert compared and sum(compared) < 30_000  # all with all would be 9,000,000


def _occurs(s, r, k):
    return any(sum(a != b for a, b in zip(s, r[j : j + len(s)])) <= k for j in range(len(r) - len(s) + 1))


def test_short_reads_meet_few_references(spark, monkeypatch):
    """Reads of 20 letters with two mismatches: words of a few letters would bring together nearly every read and reference; all links are found among far fewer places."""
    rng = random.Random(23)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = [text(150) for _ in range(60)]

    def near(n):
        at, r = rng.randint(0, 150 - n), rng.choice(refs)
        s = list(r[at : at + n])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(n)] = rng.choice("ACGTN")
        return "".join(s)

    seqs = sorted({near(n) for n in (20, 21, 26, 33, 36, 47, 50, 75) for _ in range(15)} | {text(rng.randint(20, 24)) for _ in range(150)})
    joined, join = [], reads.spread_join

    def counted(*args, **options):
        out = join(*args, **options)
        joined.append(out.count())
        return out

    monkeypatch.setattr(reads, "spread_join", counted)
    found = reads.match_sequences(spark.createDataFrame([(s,) for s in seqs], "seq string"), spark.createDataFrame(list(enumerate(refs)), "ref_ind int, ref_seq string"), 2)
    assert {(r.seq, r.ref_ind) for r in found.collect()} == {(s, i) for s in seqs for i, r in enumerate(refs) if _occurs(s, r, 2)}
    assert sum(joined) < 3000  # by words of four letters over 20,000


def test_any_number_of_mismatches(spark, monkeypatch):
    """Every shape of words, references longer than a chunk, odd letters: as by brute force."""
    monkeypatch.setattr(reads, "CHUNK", 40)
    rng = random.Random(24)
    text = lambda n: "".join(rng.choice("ACé") for _ in range(n))
    refs = [text(n) for n in (1, 5, 39, 40, 41, 90, 170)]
    seqs = sorted({text(n) for n in range(1, 8)} | {r[a : a + n] for r in refs for n in (2, 7, 11, 17, 30, 40, 55) for a in (0, 3, 36) if a + n <= len(r)})
    seqs += sorted({"".join(rng.choice("ACé") if rng.random() < 0.06 else c for c in s) for s in seqs} - set(seqs))
    q, d = spark.createDataFrame([(s,) for s in seqs], "seq string"), spark.createDataFrame(list(enumerate(refs)), "ref_ind int, ref_seq string")
    for most in (0, 1, 3, 5, 0.15):
        want = {(s, i) for s in seqs for i, r in enumerate(refs) if _occurs(s, r, min(int(len(s) * most) if most < 1 else most, len(s) - 1))}
        assert {(r.seq, r.ref_ind) for r in reads.match_sequences(q, d, most).collect()} == want


def test_pairs_matched_together(spark, monkeypatch):
    """First mates meet references, second ones their reverse complements, not the other way round; with and without broadcasts, and with the rows the pairs were made of."""
    refs = spark.createDataFrame([("a", 1, "ACCGTTGACCAGTAAC"), ("b", 2, "ACCGTTGACCAGTAAC"), ("b", 3, "TTTTTTTTTTGGGGGG")], "ref_name string, ref_ind long, ref_seq string")
    rows = [(1, "r1", "CCGTTGAC"), (1, "r2", "GTCAACGG"), (2, "r2", "CCGTTGAC"), (3, "r1", "CCCCAAAA"), (3, "r2", "CCCCAAAA"), (4, "r1", None), (4, "r2", "")]
    r = spark.createDataFrame([(*x, x[2], 0) for x in rows], "read_ind long, mate string, seq string, qual string, arrived_at int")
    p = reads.pair_reads(r, ("seq",))
    want = [("a", 1, 1, True, True), ("b", 2, 1, True, True), ("b", 3, 3, False, True)]
    for few in (reads.FEW_ROWS, 0):
        monkeypatch.setattr(reads, "FEW_ROWS", few)
        for more in (None, r):
            assert sorted(map(tuple, reads.match_pairs(p, refs, 0, more).collect())) == want


def test_mutated_references_by_query(spark, tmp_path):
    """The queries with mismatches, by brute force; qualities are not read for them."""
    from strandloom.functions.seqexpr import revcomp
    from strandloom.plans import read_queries

    rng = random.Random(25)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    other = lambda s, *at: "".join(c.translate(str.maketrans("ACGT", "CGTA")) if i + 1 in at else c for i, c in enumerate(s))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    refs = {i: text(150) for i in (1, 2, 4)}
    mates = {i: (s, None) for i, s in refs.items()}
    for i in range(5, 45):
        s, n = refs[rng.choice([1, 2, 4])], rng.choice([20, 30, 40, 75])
        at = rng.randint(0, 150 - n)
        mates[i] = (other(s[at : at + n], rng.randint(1, n)), back(s[at : at + n]))
    rows = [(i, m, s, "I" * len(s or ""), 0) for i, pair in mates.items() for m, s in zip(("r1", "r2"), pair)]
    spark.createDataFrame(rows, "read_ind long, mate string, seq string, qual string, arrived_at int").write.parquet(f"{tmp_path}/reads.parquet")
    assert spark.range(1).select(revcomp(F.lit(refs[1]))).first()[0] == back(refs[1])
    for name, changed in (("reads_matched_two_off", lambda i, s: s), ("reads_matched_mutated", lambda i, s: other(s, 40, *([90] if i % 2 else [])))):
        want = set()
        for i, s in refs.items():
            t = changed(i, s)
            for r, (a, b) in mates.items():
                hit = (bool(a) and _occurs(a, t, 2), bool(b) and _occurs(b, back(t), 2))
                if any(hit):
                    want.add((f"set{i % 3}", i, r, *hit))
        found = read_queries.QUERIES[name](spark, str(tmp_path))
        assert {tuple(r) for r in found.collect()} == want
        assert "qual" not in _plan(found)
