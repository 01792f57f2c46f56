"""Joins whose keys may be hot on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more rows of a side have is dealt out to several groups of about so many.
HOT = 2000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: int = HOT, *, few: bool = False) -> DataFrame:
    """Inner equi-join of columns that both sides call ``keys``; the other columns' names differ. Null keys match nothing.

    A key that one side has more than ``hot`` times is cut into parts by a hash of that side's rows, and the other side's rows of it go to each part: no group
    holds more than about ``hot`` rows of either side, and each pair meets once. How often keys occur is counted with map-side combination;
    of the counts only the hot keys are kept, so Catalyst can broadcast them while they are few. ``few``: they are broadcast anyway, so that neither side is shuffled for them;
    there are at most as many as the rows of both sides divided by ``hot``, so this is for narrow keys.
    """

    def counted(df: DataFrame, parts: str) -> DataFrame:
        some = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
        return some.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias(parts))

    busy = counted(left, "_lp").join(counted(right, "_rp"), keys, "full")
    busy = F.broadcast(busy) if few else busy
    sides = []
    for df, own, other in ((left, "_l", "_r"), (right, "_r", "_l")):
        rows = df.join(busy, keys, "left")
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(f"{own}p", F.lit(1))).cast("int")
        sides.append(rows.select(*df.columns, part.alias(own), F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}p", F.lit(1)) - 1)).alias(other)))
    return sides[0].join(sides[1], [*keys, "_l", "_r"]).drop("_l", "_r")
