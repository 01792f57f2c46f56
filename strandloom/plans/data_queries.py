"""Queries over the annotation and delivery tables: intervals, packed fields, attribute rows, refused lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.intervals import periods_and_gaps
from strandloom.operators.packed import unpack_fields
from strandloom.operators.refuse import READ_COLUMNS, READ_RULES, loaded_lines, refused_lines
from strandloom.operators.widen import attributes_to_columns
from strandloom.session import table

ATTRIBUTES = {"gene_id": "string", "gene_name": "string", "transcript_id": "string", "exon_number": "bigint", "level": "bigint", "exon_length": "bigint", "tag": "string"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "gtf").where("feature = 'exon'"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_fields(table(spark, sf_dir, "gtf"), "line_no", {"attribute": None, "exon_number": "exon_number"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes_to_columns(table(spark, sf_dir, "attr_col"), ATTRIBUTES)


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "samples")
    return refused_lines(table(spark, sf_dir, "reads_raw"), "raw_no", "line", READ_COLUMNS, READ_RULES, {"samples": (samples, "sample")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refused(spark, sf_dir).select("raw_no", "reason")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed records of the delivery as rows like those of reads."""
    return loaded_lines(table(spark, sf_dir, "reads_raw"), "raw_no", "line", READ_COLUMNS, {"read_ind": "bigint"}, _refused(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_loaded": p5_loaded}

_ISLANDS = """
WITH r AS (SELECT DISTINCT seqname, "start" AS s, "end" AS e FROM gtf
           WHERE feature = 'exon' AND seqname IS NOT NULL AND "start" IS NOT NULL AND "end" IS NOT NULL AND "start" <= "end"),
m AS (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM r),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT seqname, min(s) AS s, max(e) AS e FROM g GROUP BY seqname, island),
n AS (SELECT *, lead(s) OVER (PARTITION BY seqname ORDER BY s) AS nxt FROM p)
SELECT 'period' AS kind, seqname, s AS seg_start, e AS seg_end FROM p
UNION ALL SELECT 'gap', seqname, e + 1, nxt - 1 FROM n WHERE nxt > e + 1
"""

_ITEM = r""" *((?:[^;,|\t ="''][^;,|\t =]*)|(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*''))(?: *=? *("(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^;,|\t"''= ][^;,|\t]*))? *"""


def _items(field: str, lone: bool) -> str:
    def bare(x: str) -> str:
        return (
            f"CASE WHEN length({x}) >= 2 AND left({x}, 1) = '\"' THEN replace({x}[2:-2], '\"\"', '\"') "
            f"WHEN length({x}) >= 2 AND left({x}, 1) = '''' THEN replace({x}[2:-2], '''''', '''') ELSE {x} END"
        )

    key, value = f"regexp_extract(item, '{_ITEM}', 1)", f"rtrim(regexp_extract(item, '{_ITEM}', 2), ' ')"
    columns = f"k AS attr_key, {bare('v')} AS attr_value"
    if lone:
        columns = f"CASE WHEN trim(item, ' ') = k THEN 'exon_number' ELSE k END AS attr_key, CASE WHEN trim(item, ' ') = k THEN {bare('k')} ELSE {bare('v')} END AS attr_value"
    return f"""
SELECT line_no, '{field}' AS field, pos, {columns} FROM (
  SELECT line_no, pos, item, {key} AS k, {value} AS v FROM (
    SELECT line_no, unnest(items) AS item, CAST(unnest(range(1, len(items) + 1)) AS BIGINT) AS pos FROM (
      SELECT line_no, regexp_extract_all({field}, '{_ITEM}') AS items FROM gtf WHERE trim({field}, ' ') NOT IN ('', '.'))))
"""


def _wide() -> str:
    number = r"'\+?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.0+)?'"
    columns = []
    for name, kind in ATTRIBUTES.items():
        if kind == "bigint":
            whole = f"name = '{name}' AND regexp_full_match(v, {number})"
            columns.append(f"coalesce(arg_min(TRY_CAST(replace(replace(regexp_replace(v, '\\..*', ''), ',', ''), '+', '') AS BIGINT), ord) FILTER ({whole}), -1) AS {name}")
        else:
            columns.append(f"coalesce(string_agg(v, '__' ORDER BY ord) FILTER (name = '{name}' AND v IS NOT NULL AND first), '') AS {name}")
    return f"""
WITH t AS (SELECT "index", ord, translate(lower(trim(attribute)), '- ', '__') AS name, trim(value) AS w FROM attr_col WHERE "index" IS NOT NULL AND attribute IS NOT NULL),
u AS (SELECT "index", ord, name, CASE WHEN length(w) >= 2 AND left(w, 1) = '"' AND right(w, 1) = '"' THEN w[2:-2] ELSE w END AS x FROM t),
c AS (SELECT "index", ord, name, CASE WHEN x NOT IN ('', '.', 'NA') THEN x END AS v FROM u),
d AS (SELECT *, row_number() OVER (PARTITION BY "index", name, v ORDER BY ord) = 1 AS first FROM c)
SELECT "index", {', '.join(columns)} FROM d GROUP BY "index"
"""


_PARSE = r"""
l AS (SELECT raw_no, CASE WHEN right(coalesce(line, ''), 1) = chr(13) THEN left(line, length(line) - 1) ELSE coalesce(line, '') END AS line FROM reads_raw),
c AS (SELECT raw_no, line, regexp_extract_all(line || ',', '("(?:[^"]|"")*"|[^,"\n\r]*),', 1) AS raw FROM l),
p AS (SELECT raw_no, list_sum(list_transform(raw, lambda x: length(x) + 1)) = length(line) + 1 AS good, len(raw) AS n,
             list_transform(raw, lambda x: CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM c),
j AS (SELECT *, CASE WHEN NOT good THEN 'quoting' WHEN n <> 6 THEN 'columns'
                     WHEN NOT regexp_full_match(f[1], '[0-9]{1,18}') THEN 'read_ind'
                     WHEN f[2] NOT IN (SELECT sample FROM samples) THEN 'sample'
                     WHEN f[3] NOT IN ('r1', 'r2') THEN 'mate'
                     WHEN NOT regexp_full_match(f[4], '[ACGTNacgtn]+') THEN 'seq'
                     WHEN NOT regexp_full_match(f[5], '[!-~]+') THEN 'qual'
                     WHEN length(f[4]) <> length(f[5]) THEN 'length' END AS reason FROM p)
"""

ORACLES = {
    "p1_found": _ISLANDS,
    "p2_found": f"{_items('attribute', False)} UNION ALL {_items('exon_number', True)}",
    "p3_found": _wide(),
    "p5_found": f"WITH {_PARSE} SELECT raw_no, reason FROM j WHERE reason IS NOT NULL",
    "p5_loaded": f"WITH {_PARSE} SELECT raw_no, CAST(f[1] AS BIGINT) AS read_ind, f[2] AS sample, f[3] AS mate, f[4] AS seq, f[5] AS qual, f[6] AS note FROM j WHERE reason IS NULL",
}
