"""Continuous periods and gaps of intervals that overlap, nest or leave room between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import pick

#: Positions per tile. A task of the session stage sees at most this many distinct starts.
TILE = 1 << 18


def _gap(doubled: Column) -> Column:
    """An interval of so many microseconds."""
    return F.make_interval(secs=(doubled.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"))


def periods_and_gaps(df: DataFrame, key: str = "seqname", start: str = "start", end: str = "end", tile: int = TILE) -> DataFrame:
    """Rows (kind, key, seg_start, seg_end): the covered ``period``s of each key and the ``gap``s between them.

    Intervals are closed. Those that share a position belong to one period; those that merely adjoin do not, and there is
    no gap between them. Rows with a null key, start or end, or with start > end, hold no positions and are left out;
    repeated rows change nothing; an empty table gives an empty result. Positions must lie within +-2**60.

    Spark's ``session_window`` with a duration taken from each row merges the intervals. Position p stands at 2p
    microseconds and an interval lasts 2(end - start) + 1, so that windows meet exactly where intervals share a position,
    whether or not the engine joins windows that merely touch.

    A key may hold most of all rows, and a row may be of any length: an interval is cut into its piece in the tile of ``tile`` positions it begins in, its piece in
    the tile it ends in, and one row for all tiles between, which it covers. Windows merge within (key, tile); pieces in covered tiles are left out, as the tile is inside a
    period. Only the first and last period of each tile, which may go on in another, are put in order over a whole key. The table is read once.
    """
    rows = pick(df, k=key, s=start, e=end).select("k", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    rows = rows.where("k is not null and s is not null and e is not null and s <= e")
    rows = rows.selectExpr("k", "s", "e", f"(s - pmod(s, {tile}L)) div {tile}L as t0", f"(e - pmod(e, {tile}L)) div {tile}L as t1")
    # a: where a piece starts in its tile, -1 if it comes from the tile before, -2 for a row of covered tiles; m: twice its end, plus 1 if it goes on, or the last covered tile
    whole = f"struct(t0 as t, s - t0 * {tile}L as a, 2 * (e - t0 * {tile}L) as m)"
    left = f"struct(t0 as t, s - t0 * {tile}L as a, {2 * tile - 1}L as m)"
    right = f"struct(t1 as t, -1L as a, 2 * (e - t1 * {tile}L) as m)"
    between = "struct(t0 + 1 as t, -2L as a, t1 - 1 as m)"
    pieces = rows.selectExpr("k", f"inline(case when t0 = t1 then array({whole}) when t1 = t0 + 1 then array({left}, {right}) else array({left}, {right}, {between}) end)")
    # of the pieces with the same start the longest holds all others: at most `tile` rows a group are left
    pieces = pieces.groupBy("k", "t", "a").agg(F.max("m").alias("m"))
    reach = F.max(F.max(F.when(F.col("a") == -2, F.col("m")))).over(Window.partitionBy("k").orderBy("t"))
    covered = pieces.groupBy("k", "t").agg(reach.alias("reach")).where("reach >= t").select(F.col("k").alias("ck"), F.col("t").alias("ct"), F.lit(True).alias("covered"))
    # one condition on both sides, which isn't pushed into the pieces: these are made once, for both
    free = pieces.join(covered, (F.col("k") == F.col("ck")) & (F.col("t") == F.col("ct")), "left").where(F.when(F.col("covered"), False).otherwise(F.col("a") >= -1))
    begin = F.greatest(F.col("a"), F.lit(0))
    merged = (
        free.select("k", "t", F.timestamp_micros(begin * 2).alias("at"), F.when(F.col("a") >= -1, _gap(F.col("m") - F.col("m") % 2 - begin * 2 + 1)).alias("lasts"), (F.col("a") == -1).alias("from_left"), (F.col("m") % 2 == 1).alias("to_right"))
        .groupBy("k", "t", F.session_window("at", F.col("lasts")).alias("w"))
        .agg(F.max("from_left").alias("from_left"), F.max("to_right").alias("to_right"))
        .selectExpr("k", "t", f"t * {tile}L + unix_micros(w.start) div 2 as s", f"t * {tile}L + (unix_micros(w.end) - 1) div 2 as e", "from_left", "to_right")
    )
    in_tile = Window.partitionBy("k", "t").orderBy("s")
    seen = merged.select("*", F.lead("s").over(in_tile).alias("next_s"), F.lag("s").over(in_tile).alias("prev_s"))
    # the first and last period of each tile, at most two, are put in order over the key; all others stay by tile. A period that goes on is
    # followed by one that comes from the left, in the next tile that isn't covered
    edge = F.col("next_s").isNull() | F.col("prev_s").isNull()
    over_key = Window.partitionBy("k", "apart").orderBy("s")
    seen = seen.withColumn("apart", F.when(~edge, F.col("t"))).select(
        "*",
        F.lead("s").over(over_key).alias("after"),
        F.last(F.when(~F.col("from_left"), F.col("s")), ignorenulls=True).over(over_key.rowsBetween(Window.unboundedPreceding, 0)).alias("began"),
    )
    ends = ~F.col("to_right")
    following = F.coalesce("next_s", F.when(edge & ends, F.col("after")))
    period = F.when(ends, F.struct(F.lit("period").alias("kind"), F.when(F.col("from_left"), F.col("began")).otherwise(F.col("s")).alias("s"), F.col("e").alias("e")))
    gap = F.when(following > F.col("e") + 1, F.struct(F.lit("gap").alias("kind"), (F.col("e") + 1).alias("s"), (following - 1).alias("e")))
    out = seen.select("k", F.inline(F.array_compact(F.array(period, gap))))
    return out.select("kind", F.col("k").alias(key), F.col("s").alias("seg_start"), F.col("e").alias("seg_end"))
