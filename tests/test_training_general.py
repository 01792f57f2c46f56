"""Intervals, packed fields, attribute rows and refused lines: edge cases and brute force."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.intervals import periods_and_gaps
from strandloom.operators.packed import split_items, unpack_fields
from strandloom.operators.refuse import READ_COLUMNS, READ_RULES, loaded_lines, refused_lines
from strandloom.operators.widen import attributes_to_columns


def brute_periods(rows):
    out = []
    for key in sorted({k for k, _, _ in rows}):
        merged = []
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [("period", key, s, e) for s, e in merged]
        out += [("gap", key, a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:]) if b[0] > a[1] + 1]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile", [1, 4, 16, 1 << 18])
def test_periods_match_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = []
    for _ in range(400):
        s = rng.randint(-40, 120)
        rows.append((rng.choice("ab"), s, s + rng.choice([0, 0, 1, 3, 30])))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "seqname string, start long, end long")
    assert found(periods_and_gaps(df, tile=tile)) == brute_periods(rows)


def test_periods_edges(spark):
    schema = "seqname string, start long, end long, tile string, k string"
    rows = [("a", 5, 9, "x", "y"), ("a", 10, 12, None, None), ("a", 12, 12, "", ""), (None, 1, 2, "", ""), ("a", None, 3, "", ""), ("a", 3, None, "", ""), ("a", 9, 5, "", ""), ("b", 1, 10**12, "", "")]
    got = found(periods_and_gaps(spark.createDataFrame(rows, schema)))
    assert got == [("period", "a", 5, 9), ("period", "a", 10, 12), ("period", "b", 1, 10**12)]
    assert found(periods_and_gaps(spark.createDataFrame([], schema))) == []


def test_a_very_long_row_leaves_the_tiles_as_they_are(spark):
    rng = random.Random(12)
    rows = [("a", -5, 1 << 40), ("a", (1 << 40) + 2, (1 << 40) + 9), ("b", 7, 7), ("b", 1 << 20, (1 << 59) + 3), ("b", (1 << 59) + 3, (1 << 59) + 5)]
    rows += [("a", s, s + rng.choice([0, 9, 700, 1 << 19, 1 << 20])) for s in (rng.randint(-(1 << 21), 1 << 21) for _ in range(300))]
    df = spark.createDataFrame(rows, "seqname string, start long, end long")
    assert found(periods_and_gaps(df)) == brute_periods(rows) == found(periods_and_gaps(df, tile=1 << 10))


def test_a_hot_sequence_with_a_long_row(spark):
    df = spark.range(60_000).selectExpr("'chr1' as seqname", "id * 1000 as start", "id * 1000 + 500 as end")
    gaps = periods_and_gaps(df, tile=1 << 12).where("kind = 'gap' and seg_end - seg_start = 498")
    assert gaps.count() == 59_999
    longer = df.unionByName(spark.sql("select 'chr1' as seqname, -9L as start, 1L << 40 as end"))
    assert found(periods_and_gaps(longer, tile=1 << 12)) == [("period", "chr1", -9, 1 << 40)]


def brute_items(text, lone):
    out, i, n = [], 0, len(text)

    def quoted(i):
        q, j, v = text[i], i + 1, ""
        while j < n:
            if text[j] == q:
                if text[j + 1 : j + 2] == q:
                    v, j = v + q, j + 2
                    continue
                return v, j + 1
            v, j = v + text[j], j + 1
        return None, n

    def value(i):
        v, j = quoted(i) if text[i] in "\"'" else (None, i)
        e = j
        while e < n and text[e] not in ";,|\t":
            e += 1
        return (text[i:e].strip(" ") if v is None or text[j:e].strip(" ") else v), e

    while True:
        while i < n and text[i] in ";,|\t ":
            i += 1
        if i >= n:
            return out
        if text[i] in "\"'":
            v, i = value(i)
            out.append((lone, v) if lone else (v, ""))
            continue
        s = i
        while i < n and text[i] not in ";,|\t =":
            i += 1
        key = text[s:i]
        while i < n and text[i] == " ":
            i += 1
        equals = text[i : i + 1] == "="
        if equals:
            i += 1
            while i < n and text[i] == " ":
                i += 1
        if i >= n or text[i] in ";,|\t":
            out.append((lone, key) if lone and not equals else (key, ""))
        else:
            v, i = value(i)
            out.append((key, v))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab =;,|\t\"'é", max_size=24), min_size=1, max_size=8))
def test_items_match_a_scanner(texts):
    for lone in (None, "exon_number"):
        keys, values = split_items(pa.array(texts, pa.string()), lone)
        assert [list(zip(k, v)) for k, v in zip(keys.to_pylist(), values.to_pylist())] == [brute_items(t, lone) for t in texts]


def test_broken_rows_of_any_length_take_few_steps():
    rng = random.Random(5)
    texts = ["k \"open; " + "".join(rng.choice("ab =;,|\t\"'") for _ in range(n)) for n in (10, 1015, 1016, 1017, 5000, 70_000)]
    keys, values = split_items(pa.array(texts, pa.string()), None)
    assert [list(zip(k, v)) for k, v in zip(keys.to_pylist(), values.to_pylist())] == [brute_items(t, None) for t in texts]


def test_packed_fields_edges(spark):
    long = 'note "' + "x;" * 60_000 + '"; k v'
    rows = [(1, 'a "x; y" | b=2,,c', "1;\"2\""), (1, 'a "x; y" | b=2,,c', "1;\"2\""), (2, " . ", None), (None, 'q "say ""hi"""', "."), (3, long, ""), (4, "", " ")]
    df = spark.createDataFrame(rows, "line_no long, attribute string, exon_number string").withColumnRenamed("line_no", "row")
    got = unpack_fields(df, "row", {"attribute": None, "exon_number": "exon_number"}).collect()
    first = sorted((r.field, r.pos, r.attr_key, r.attr_value) for r in got if r.row == 1)
    assert first == sorted([("attribute", 1, "a", "x; y"), ("attribute", 2, "b", "2"), ("attribute", 3, "c", ""), ("exon_number", 1, "exon_number", "1"), ("exon_number", 2, "exon_number", "2")] * 2)
    assert [(r.attr_key, r.attr_value) for r in got if r.row is None] == [("q", 'say "hi"')]
    assert sorted((r.attr_key, len(r.attr_value)) for r in got if r.row == 3) == [("k", 1), ("note", 120_000)]
    assert not [r for r in got if r.row in (2, 4)]
    assert unpack_fields(df.limit(0), "row", {"attribute": None}).count() == 0


def test_attribute_columns_edges(spark):
    rows = [
        (1, "9", "Gene-ID ", ' "G1" '), (2, "9", "gene id", "G2"), (3, "9", "gene_id", "G1"), (4, "9", "level", "x"), (5, "9", "LEVEL", "+1,234.00"), (6, "9", "level", "7"),
        (7, "8", "tag", "NA"), (8, None, "tag", "a"), (9, "7", None, "a"), (10, "6", "other", "z"), (None, "5", "tag", "late"), (11, "5", "tag", "early"), (12, "5", "level", "9" * 30), (13, "5", "tag", '""'),
    ]
    df = spark.createDataFrame(rows, "ord long, index string, attribute string, value string")
    got = {r["index"]: tuple(r)[1:] for r in attributes_to_columns(df, {"gene_id": "string", "level": "bigint", "tag": "string"}).collect()}
    assert got == {"9": ("G1__G2", 1234, ""), "8": ("", -1, ""), "6": ("", -1, ""), "5": ("", -1, "early__late")}
    assert attributes_to_columns(df.limit(0), {"tag": "string"}).count() == 0


def test_attribute_columns_of_one_hot_entity(spark):
    df = spark.range(30_000).selectExpr("id as ord", "'x' as index", "'tag' as attribute", "cast(id % 500 as string) as value").unionByName(spark.range(3).selectExpr("id as ord", "cast(id as string) as index", "'tag' as attribute", "'t' as value"))
    got = {r["index"]: r.tag for r in attributes_to_columns(df, {"tag": "string"}).collect()}
    assert got["x"] == "__".join(map(str, range(500))) and len(got) == 4


def test_ordinals_are_unique_and_place_the_columns(spark):
    df = spark.range(20_000).selectExpr("id as ord", "cast(id % 3000 as string) as index", "if(id % 2 = 0, 'level', 'tag') as attribute", "cast(id % 70 as string) as value")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # entities go on from batch to batch
    try:
        rows = attributes_to_columns(df, {"tag": "string", "level": "bigint"}, ordinal="nr").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(rows) == len({r.nr for r in rows}) == len({r["index"] for r in rows}) == 3000
    for part in {r.nr >> 33 for r in rows}:  # dense in each partition, entities in order
        own = sorted((r.nr, r["index"]) for r in rows if r.nr >> 33 == part)
        assert [n for n, _ in own] == list(range(part << 33, (part << 33) + len(own))) and own == sorted(own, key=lambda x: x[1])
    for r in rows[::50]:
        i = int(r["index"])
        values = [str(x % 70) for x in range(i, 20_000, 3000) if x % 2 == 1]
        assert r.tag == "__".join(dict.fromkeys(values)) and r.level == (i % 70 if i % 2 == 0 else -1)


def test_refused_lines(spark):
    good = "1,S1,r1,ACGT,!!!!,note"
    cases = {
        good: None, good + "\r": None, '"1","S1","r1","ACGT","!,""!","a\nb"': None, good + "\r\r": "quoting", good + "\n": "quoting", 'x"y,S1,r1,A,!,': "quoting", '"1,S1': "quoting", '"1"x,S1,r1,A,!,': "quoting",
        "1,S1,r1,A,!": "columns", "": "columns", None: "columns", "-1,S1,r1,A,!,": "read_ind", "1" * 19 + ",S1,r1,A,!,": "read_ind", " 1,S1,r1,A,!,": "read_ind", "1,S2,r1,A,!,": "sample", "1,,r1,A,!,": "sample",
        "1,S1,R1,A,!,": "mate", "1,S1,r1,,!,": "seq", "1,S1,r1,AX,!!,": "seq", "1,S1,r1,A,,": "qual", "1,S1,r1,A, ,": "qual", "1,S1,r2,ACg,!!,": "length", '"1\n",S1,r1,A,!,': "read_ind", "1,S1,r1," + "A" * 90_000 + "," + "!" * 90_000 + ",": None,
        '1,S1,r1,A,!,"' + '""' * 40_000 + '"': None,
    }
    rows = [(i, line) for i, line in enumerate(cases)] + [(None, "1,S1,R1,A,!,")] * 2 + [(0, good)]
    df = spark.createDataFrame(rows, "raw_no long, line string")
    samples = spark.createDataFrame([("S1",), ("S1",), (None,)], "sample string")
    failed = refused_lines(df, "raw_no", "line", READ_COLUMNS, READ_RULES, {"samples": (samples, "sample")})
    got = {r.raw_no: r.reason for r in failed.where("raw_no is not null").collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}
    assert [r.reason for r in failed.where("raw_no is null").collect()] == ["mate", "mate"]
    loaded = loaded_lines(df, "raw_no", "line", READ_COLUMNS, {"read_ind": "bigint"}, failed).collect()
    assert sorted(r.raw_no for r in loaded) == sorted([i for i, v in enumerate(cases.values()) if not v] + [0])
    assert next(r for r in loaded if r.raw_no == 2)["qual"] == '!,"!'
    empty = refused_lines(df.limit(0), "raw_no", "line", READ_COLUMNS, READ_RULES, {"samples": (samples, "sample")})
    assert empty.count() == 0
