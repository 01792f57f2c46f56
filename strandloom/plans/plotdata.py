"""Tables behind plots and printed alignments; nothing is drawn here."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.seqexpr import dots_for_matches, match_symbols, pad


def pack_rows(df: DataFrame, by: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """The rows with ``y``, the lowest line (from 1) on which a range begins more than ``gap`` behind the one before.

    Ranges go in order of their starts. A group's rows stream sorted through one task, which holds the end of each line only; rows with null ends get no line.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    schema = T.StructType([*rows.schema.fields, T.StructField("y", T.IntegerType())])
    n_by = [rows.columns.index(c) for c in by]
    i, j = rows.columns.index(start), rows.columns.index(end)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, free, used = None, [], [], 0
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in n_by])) if n_by else [()] * batch.num_rows
            out = []
            for k, s, e in zip(keys, batch.column(i).to_pylist(), batch.column(j).to_pylist()):
                if k != key:
                    key, open_, free, used = k, [], [], 0
                while open_ and open_[0][0] + gap < s:
                    heapq.heappush(free, heapq.heappop(open_)[1])
                if free:
                    y = heapq.heappop(free)
                else:
                    used += 1
                    y = used
                heapq.heappush(open_, (e, y))
                out.append(y)
            yield batch.append_column("y", pa.array(out, pa.int32()))

    spread = rows.repartition(*by) if by else rows.repartition(1)
    return spread.sortWithinPartitions(*by, start, end).mapInArrow(place, schema)


def shift_alignment(long: DataFrame, by: int, length: int) -> DataFrame:
    """Positions of a circular alignment moved on."""
    return long.withColumn("position", F.pmod(F.col("position") - 1 + by, F.lit(length)) + 1)


def range_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Positions between two ranges, 0 where they overlap or adjoin."""
    return F.greatest(F.lit(0), b_start - a_end - 1, a_start - b_end - 1)


def integer_breaks(low: int, high: int, n: int = 5) -> list[int]:
    """Round whole numbers over a range, about n."""
    span = max(1, high - low)
    raw = max(1, span // n)
    base = 10 ** (len(str(raw)) - 1)
    step = next(m * base for m in (1, 2, 5, 10) if m * base >= raw)
    return list(range(-(-low // step) * step, high + 1, step))


def tile_borders(long: DataFrame, by: list[str]) -> DataFrame:
    """Rows (*by, first, last): stretches of a sequence without a break, for outlines."""
    from strandloom.operators.aggregates import consecutive_runs

    return consecutive_runs(long.where("seq is not null"), by, "position")


def reads_per_reference(matches: DataFrame, least: int, most: int) -> DataFrame:
    """References that between ``least`` and ``most`` reads match, with their number."""
    return matches.groupBy("ref_name", "ref_ind").agg(F.count("*").alias("n_reads")).where(F.col("n_reads").between(least, most))


def printed_alignment(df: DataFrame, by: list[str], pattern: str, subject: str, width: int = 100, dots: bool = False) -> DataFrame:
    """Rows (*by, block, text): aligned pairs as blocks of four lines (ruler, pattern, subject, ruler) with padded names."""
    p = dots_for_matches(F.col(pattern), F.col(subject)) if dots else F.col(pattern)
    rows = df.where((F.length(pattern) > 0) & (F.length(pattern) == F.length(subject))).select(
        *by, p.alias("p"), F.col(subject).alias("s"), match_symbols(pattern).alias("pr"), match_symbols(subject).alias("sr")
    )
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.length("p") - 1) / width).cast("int"))).alias("block"))
    cut = lambda c: F.substr(F.col(c), F.col("block") * width + 1, F.lit(width))
    names = {"pr": "", "p": "pattern", "s": "subject", "sr": ""}
    lines = [F.concat(pad(F.lit(n), 8), cut(c)) for c, n in names.items()]
    return blocks.select(*by, "block", F.array_join(F.array(*lines), "\n").alias("text"))
