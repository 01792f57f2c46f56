"""Text lines parsed into typed rows; lines that fail are set apart with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import pick

#: A field in quotes, each quote in it doubled, or a bare field, with the comma that ends it. Possessive, so that long
#: fields need no stack.
CELL = r'("[^"]*+(?:""[^"]*+)*+"|[^,"\n\r]*+),'


@dataclass(frozen=True)
class Rule:
    """``reason`` applies to a cell of ``column`` whose value fails the ``test``; the first rule in the list counts."""

    reason: str
    column: str
    test: str
    """A pattern the whole value must match; ``@table``: a value of the reference table; ``=column``: as long as that column's value."""


#: The layout of read lines.
READ_COLUMNS = ["read_ind", "sample", "mate", "seq", "qual", "note"]
READ_RULES = [
    Rule("read_ind", "read_ind", r"[0-9]{1,18}"),
    Rule("sample", "sample", "@samples"),
    Rule("mate", "mate", r"r1|r2"),
    Rule("seq", "seq", r"[ACGTNacgtn]+"),
    Rule("qual", "qual", r"[!-~]+"),
    Rule("length", "qual", "=seq"),
]


def _cells(line: Column) -> tuple[Column, Column]:
    """The fields of a line as written, and whether they are all well quoted."""
    line = F.coalesce(line, F.lit(""))
    line = F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1))
    taken = F.aggregate(raw, F.lit(0), lambda n, x: n + F.length(x) + 1)
    return raw, taken == F.length(line) + 1


def _bare(raw: Column) -> Column:
    return F.when(raw.startswith('"'), F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def _parsed(df: DataFrame, row_id: str, line: str) -> DataFrame:
    rows = pick(df, k=row_id, line=line)
    raw, good = _cells(F.col("line"))
    return rows.select("k", F.xxhash64("line").alias("h"), raw.alias("raw"), good.alias("good"))


def refused_lines(df: DataFrame, row_id: str, line: str, columns: list[str], rules: list[Rule], reference: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows (row_id, reason): each line that fails, with the first reason that applies.

    The reasons are ``quoting`` (a field is neither bare nor well quoted), ``columns`` (another number of fields) and those
    of the rules, in their order. One carriage return at the end of a line is no part of it. Values are tested exactly,
    blanks included. A null line counts as an empty one, which has one field. Repeated lines fail each; a null row_id is kept;
    an empty table gives no rows.

    The parsed cells stand as rows (line, column, value), the rules are joined to them as a table, and the failures are
    aggregated by line. All cells of a line leave the same task, so the partial aggregation brings each line to one narrow row
    before the shuffle, which carries no text. The number of rules is fixed by the layout, so their table may be broadcast;
    of the reference tables Catalyst knows the size and broadcasts them only below its threshold.
    """
    spark = df.sparkSession
    parsed = _parsed(df, row_id, line)
    shape = F.when(~F.col("good"), 1).when(F.size("raw") != len(columns), 2)
    cells = parsed.select("k", "h", shape.alias("shape"), F.posexplode(F.when(shape.isNotNull(), F.array(F.lit(""))).otherwise(F.col("raw"))).alias("c", "raw"))
    cells = cells.select("k", "h", "shape", "c", F.when(F.col("shape").isNull(), _bare(F.col("raw"))).alias("value"))
    known = [r for r in rules if r.test.startswith("@")]
    tests = [r for r in rules if not r.test.startswith(("@", "="))]
    lengths = [(i, r) for i, r in enumerate(rules) if r.test.startswith("=")]
    # rule table: place of the column, rank of the rule, whether it is the column's first rule
    placed = [(columns.index(r.column), i + 3) for i, r in enumerate(rules) if not r.test.startswith("=")]
    table = [(c, rank, rank == min(x for d, x in placed if d == c)) for c, rank in placed]
    entries = [F.struct(F.lit(c).alias("rc"), F.lit(rank).alias("rank"), F.lit(leads).alias("leads")) for c, rank, leads in table]
    rule_table = spark.range(0, 1, 1, 1).select(F.inline(F.array(*entries)))
    checked = cells.join(F.broadcast(rule_table), (F.col("c") == F.col("rc")) & F.col("shape").isNull(), "left")
    fails = F.lit(False)
    for i, r in enumerate(rules):
        if r in tests:
            fails = F.when(F.col("rank") == i + 3, ~F.col("value").rlike(rf"\A(?:{r.test})\z")).otherwise(fails)
    for i, r in enumerate(rules):
        if r in known:
            values, name = reference[r.test[1:]]
            values = pick(values, member=name).where("member is not null").distinct().select(F.col("member").cast("string").alias(f"_m{i}"))
            # where the table is too large to be broadcast, cells of other rules are spread instead of meeting in one partition
            needed = F.when(F.col("rank") == i + 3, F.col("value")).otherwise(F.concat(F.lit("\0"), F.col("h").cast("string"), F.col("c").cast("string")))
            checked = checked.withColumn("_key", needed).join(values, F.col("_key") == F.col(f"_m{i}"), "left").drop("_key")
            fails = F.when(F.col("rank") == i + 3, F.col(f"_m{i}").isNull()).otherwise(fails)
    rank = F.coalesce(F.col("shape"), F.when(fails, F.col("rank")))
    sizes = [F.max(F.when(F.col("c") == i, F.length("value"))).alias(f"n{i}") for i in range(len(columns))]
    needed = sorted({columns.index(x) for _, r in lengths for x in (r.column, r.test[1:])})
    verdict = checked.groupBy("k", "h").agg(F.min(rank).alias("rank"), F.sum(F.when((F.col("c") == 0) & F.coalesce("leads", F.lit(True)), 1)).alias("times"), *[sizes[i] for i in needed])
    for i, r in lengths:
        differ = F.col(f"n{columns.index(r.column)}") != F.col(f"n{columns.index(r.test[1:])}")
        verdict = verdict.withColumn("rank", F.least("rank", F.when(differ, i + 3)))
    reasons = F.array(*[F.lit(x) for x in ("quoting", "columns", *[r.reason for r in rules])])
    failed = verdict.where("rank is not null").select("k", "h", F.element_at(reasons, F.col("rank")).alias("reason"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return failed.select(F.col("k").alias(row_id), "reason", F.col("h").alias("_line_hash"))


def loaded_lines(df: DataFrame, row_id: str, line: str, columns: list[str], types: dict[str, str], failed: DataFrame) -> DataFrame:
    """Rows (row_id, *columns): the lines that ``refused_lines`` didn't refuse, each value with the type in ``types`` or as string."""
    parsed = _parsed(df, row_id, line)
    bad = failed.select(F.col(row_id).alias("bk"), F.col("_line_hash").alias("bh")).distinct()
    clean = parsed.join(bad, F.col("k").eqNullSafe(F.col("bk")) & (F.col("h") == F.col("bh")), "left_anti")
    return clean.select(F.col("k").alias(row_id), *[_bare(F.col("raw")[i]).cast(types.get(c, "string")).alias(c) for i, c in enumerate(columns)])
