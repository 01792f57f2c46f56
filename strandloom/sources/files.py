"""Formats that are read record by record in Python: FASTQ, BAM, GenBank, nested JSON. A file is one task, as none of them can be split where it is compressed."""

from __future__ import annotations

import glob
import gzip
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BATCH = 20_000


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FileReader(DataSourceReader):
    def __init__(self, options: dict, read):
        self.options, self.read_file = options, read

    def partitions(self):
        return [_FilePartition(p) for pattern in self.options["path"].split(",") for p in sorted(glob.glob(pattern))] or [_FilePartition("")]

    def read(self, partition):
        if partition.path:
            yield from self.read_file(partition.path)


def _open(path: str):
    with open(path, "rb") as f:
        zipped = f.read(2) == b"\x1f\x8b"
    return gzip.open(path, "rb") if zipped else open(path, "rb")


def _fastq(path: str) -> Iterator[pa.RecordBatch]:
    names = ["file", "read_ind", "name", "seq", "qual"]
    rows: list[tuple] = []
    with _open(path) as f:
        for i, head in enumerate(iter(f.readline, b"")):
            seq, _, qual = f.readline(), f.readline(), f.readline()
            rows.append((path, i, *[x.decode().rstrip("\r\n") for x in (head[1:], seq, qual)]))
            if len(rows) == _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


class FastqSource(DataSource):
    """Records of FASTQ files, numbered from 0 in each."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "file string, read_ind bigint, name string, seq string, qual string"

    def reader(self, schema):
        return _FileReader(self.options, _fastq)


_BAM_SEQ = "=ACMGRSVTWYHKDBN"
_BAM_OPS = "MIDNSHP=X"


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    sizes = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[tag], at = raw[at:end].decode(), end + 1
        elif kind == "A":
            out[tag], at = chr(raw[at]), at + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            one = struct.calcsize(sizes[sub])
            out[tag] = ",".join(str(struct.unpack_from(sizes[sub], raw, at + 5 + k * one)[0]) for k in range(n))
            at += 5 + n * one
        else:
            out[tag] = str(struct.unpack_from(sizes[kind], raw, at)[0])
            at += struct.calcsize(sizes[kind])
    return out


_BAM_TYPES = [("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("strand", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mrnm", pa.string()), ("mpos", pa.int32()), ("isize", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]


def _bam(path: str) -> Iterator[pa.RecordBatch]:
    with _open(path) as f:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        refs = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            n = struct.unpack("<i", f.read(4))[0]
            refs.append(f.read(n)[:-1].decode())
            f.read(4)
        rows: list[tuple] = []
        name = lambda k: refs[k] if k >= 0 else None
        while len(size := f.read(4)) == 4:
            b = f.read(struct.unpack("<i", size)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, m_ref, m_pos, isize = struct.unpack_from("<iiBBHHHiiii", b)
            at = 32
            qname, at = b[at : at + l_name - 1].decode(), at + l_name
            ops = struct.unpack_from(f"<{n_cigar}I", b, at)
            at += 4 * n_cigar
            packed, at = b[at : at + (l_seq + 1) // 2], at + (l_seq + 1) // 2
            seq = "".join(_BAM_SEQ[x >> 4] + _BAM_SEQ[x & 15] for x in packed)[:l_seq]
            raw, at = b[at : at + l_seq], at + l_seq
            qual = "".join(chr(q + 33) for q in raw) if raw and raw[0] != 255 else None
            cigar = "".join(f"{o >> 4}{_BAM_OPS[o & 15]}" for o in ops) or None
            rows.append((qname, flag, name(ref), None if flag & 4 else "-" if flag & 16 else "+", pos + 1 if pos >= 0 else None, mapq, cigar, name(m_ref), m_pos + 1 if m_pos >= 0 else None, isize, seq, qual, list(_tags(b[at:]).items())))
            if len(rows) == _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _BAM_TYPES)], [n for n, _ in _BAM_TYPES])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _BAM_TYPES)], [n for n, _ in _BAM_TYPES])


class BamSource(DataSource):
    """Alignments of BAM files with their tags as a map of strings; positions from 1."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return "qname string, flag int, rname string, strand string, pos int, mapq int, cigar string, mrnm string, mpos int, isize int, seq string, qual string, tags map<string,string>"

    def reader(self, schema):
        return _FileReader(self.options, _bam)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("path", path).load()


def read_fastq_pair(spark: SparkSession, r1: str, r2: str) -> DataFrame:
    """Rows (read_ind, r1_seq, r1_qual, r2_seq, r2_qual): records of two files joined by their number."""
    side = lambda p, m: read_fastq(spark, p).select("read_ind", F.col("seq").alias(f"{m}_seq"), F.col("qual").alias(f"{m}_qual"))
    return side(r1, "r1").join(side(r2, "r2"), "read_ind", "full")


def reference_length(cigar: Column) -> Column:
    """The positions of the reference that a CIGAR string spans; 1 without one."""
    spans = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.greatest(F.lit(1), F.coalesce(F.aggregate(spans, F.lit(0), lambda n, x: n + x.cast("int")), F.lit(1)))


def in_ranges(rows: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Alignments (rname, pos, cigar) that share a position with a range (name, first, last), once for each range, which ``genomic_range`` names as ``name:first-last``."""
    end = F.col("pos") + reference_length(F.col("cigar")) - 1
    hits = [F.when((F.col("rname") == n) & (F.col("pos") <= b) & (end >= a), F.lit(f"{n}:{a}-{b}")) for n, a, b in ranges]
    return rows.withColumn("genomic_range", F.explode(F.array_compact(F.array(*hits))))


def oriented(rows: DataFrame, revcomp_minus: bool = False, revcomp_plus: bool = False) -> DataFrame:
    """Reads of the minus or plus strand with their sequence reverse-complemented and their quality reversed."""
    from strandloom.functions.seqexpr import revcomp

    for turned, strand in ((revcomp_minus, "-"), (revcomp_plus, "+")):
        if turned:
            own = F.col("strand") == strand
            rows = rows.withColumn("seq", F.when(own, revcomp("seq")).otherwise(F.col("seq"))).withColumn("qual", F.when(own, F.reverse("qual")).otherwise(F.col("qual")))
    return rows


def read_bam(spark: SparkSession, path: str, ranges: list[tuple[str, int, int]] | None = None, tags: list[str] | None = None, revcomp_minus: bool = False, revcomp_plus: bool = False) -> DataFrame:
    """Alignments, with ``ranges`` those that overlap one (see ``in_ranges``), with qwidth, tags as columns and quality figures; reads of a strand turned if asked."""
    from strandloom.functions.seqexpr import quality_stats

    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").option("path", path).load()
    if ranges:
        rows = in_ranges(rows, ranges)
    rows = oriented(rows, revcomp_minus, revcomp_plus)
    return rows.select("*", F.length("seq").alias("qwidth"), *quality_stats("qual"), *[F.try_element_at("tags", F.lit(t)).alias(t) for t in tags or []])


def parse_genbank(text: str) -> tuple[list[tuple], str]:
    """Feature values (id, feature, subfeature, ranges, complement, value) and the sequence of one flat-file record."""
    found = re.search(r"(?m)^(?:VERSION|ACCESSION)\s+(\S+)", text)
    version = re.search(r"(?m)^VERSION\s+(\S+)", text)
    ident = (version or found).group(1) if found else None
    head, _, tail = text.rpartition("ORIGIN")
    origin = re.sub(r"[^A-Za-z]", "", tail.split("//")[0]).upper() if head else ""
    rows: list[tuple] = []
    place, feature, ranges, key, value = None, None, "", None, ""

    def close() -> None:
        nonlocal key, value
        if feature and key:
            rows.append((ident, feature, key, re.sub(r"complement\(|join\(|order\(|\)", "", ranges), "complement(" in ranges, value.strip('"')))
        key, value = None, ""

    for line in (head or text).split("\n"):
        if line.startswith("FEATURES"):
            place = "features"
        elif place and re.match(r" {5}\S", line):
            close()
            if feature and not any(r[1] == feature and r[3] == re.sub(r"complement\(|join\(|order\(|\)", "", ranges) for r in rows):
                rows.append((ident, feature, None, re.sub(r"complement\(|join\(|order\(|\)", "", ranges), "complement(" in ranges, None))
            feature, _, ranges = line.strip().partition(" ")
            ranges = ranges.strip()
        elif place and line.startswith(" " * 21):
            body = line.strip()
            if body.startswith("/"):
                close()
                key, _, value = body[1:].partition("=")
            elif key:
                value += body
            else:
                ranges += body
        elif place and line and not line.startswith(" "):
            break
    close()
    return rows, origin


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, sequences) of flat files: rows (id, feature, subfeature, ranges, complement, value) and (id, seq)."""
    files = spark.read.text(path, wholetext=True)
    records = files.select(F.explode(F.split("value", r"(?m)^//\s*$")).alias("record")).where(F.trim("record") != "")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() for r in parse_genbank(t)[0]]
            kinds = [pa.string()] * 4 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], ["id", "feature", "subfeature", "ranges", "complement", "value"])

    ident = F.coalesce(F.nullif(F.regexp_extract("record", r"(?m)^VERSION\s+(\S+)", 1), F.lit("")), F.regexp_extract("record", r"(?m)^ACCESSION\s+(\S+)", 1))
    seqs = records.select(ident.alias("id"), F.upper(F.regexp_replace(F.regexp_extract("record", r"(?s).*ORIGIN(.*)", 1), "[^A-Za-z]", "")).alias("seq"))
    return records.mapInArrow(features, "id string, feature string, subfeature string, ranges string, complement boolean, value string"), seqs


def flatten_json(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """Rows (*keep, path, value): the leaves of JSON texts with dotted paths; list places count from 0; texts that aren't JSON give a leaf ``!`` with the text."""
    rows = df.select(*keep, F.col(column).alias("_j")).where("_j is not null")
    n = len(keep)

    def leaves(x, path: str) -> Iterator[tuple[str, str | None]]:
        if isinstance(x, (dict, list)):
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                yield from leaves(v, f"{path}.{k}" if path else str(k))
        else:
            yield path, None if x is None else x if isinstance(x, str) else json.dumps(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, paths, values = [], [], []
            for k, text in enumerate(batch.column(n).to_pylist()):
                try:
                    found = list(leaves(json.loads(text), ""))
                except (ValueError, RecursionError):
                    found = [("!", text)]
                for p, v in found:
                    parent.append(k)
                    paths.append(p)
                    values.append(v)
            at = pa.array(parent, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(n)], pa.array(paths, pa.string()), pa.array(values, pa.string())], [*keep, "path", "value"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields[:n], T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    return rows.mapInArrow(run, schema)
