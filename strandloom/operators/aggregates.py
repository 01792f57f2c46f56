"""Aggregations and window operators of general use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(value: Column, order: Column | None = None, unique: bool = False, ordered: bool = False, sep: str = ",") -> Column:
    """Aggregate: values joined to one string, nulls as ``NA``.

    ``ordered`` sorts by value, else they stand by ``order``. ``unique`` gives one value only where all are equal, otherwise all are kept.
    """
    v = F.coalesce(value.cast("string"), F.lit("NA"))
    if ordered or order is None:
        listed = F.array_sort(F.collect_list(v))
    else:
        listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v")))), lambda s: s["v"])
    if unique:
        return F.when(F.count_distinct(v) == 1, F.min(v)).otherwise(F.array_join(listed, sep))
    return F.array_join(listed, sep)


def distinct_with_null(value: Column) -> Column:
    """Aggregate: the number of distinct values, null being one of them."""
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))


def most_frequent(value: Column) -> Column:
    """Aggregate: the most frequent value, of equals the first in sorted order; null for none."""
    return F.mode(value, True)


def first_mode(df: DataFrame, by: list[str], value: str, order: str, out: str) -> DataFrame:
    """Rows (*by, out): the most frequent value of each group, of equals the one that appears first by ``order``; nulls don't count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(out))


def collapse_duplicates(df: DataFrame, seq: str, order: str) -> DataFrame:
    """Rows (name, seq, n): each distinct sequence with ``unique seq i (n)``, i by first appearance. Nulls are left out.

    The numbering runs over groups of the first positions, so that no task sees all sequences: distinct sequences are counted per range
    and the counts of the ranges, one number each, are added up.
    """
    counted = df.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("seq")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    numbered = with_rank(counted, "first", "i")
    return numbered.select(F.concat(F.lit("unique seq "), F.col("i"), F.lit(" ("), F.col("n"), F.lit(")")).alias("name"), "seq", "n")


def _block_of(value: Column, bounds: list[int], first: int = 0) -> Column:
    """How many of the sorted bounds are at most the value, found by halving."""
    if not bounds:
        return F.lit(first).cast("bigint")
    half = len(bounds) // 2
    return F.when(value < bounds[half], _block_of(value, bounds[:half], first)).otherwise(_block_of(value, bounds[half + 1 :], first + half + 1))


def with_rank(df: DataFrame, order: str, out: str, by: list[str] | None = None, parts: int = 256) -> DataFrame:
    """The rows with their place 1..n by the column ``order`` (bigint), of all rows or of each group, without sorting a group in one task.

    Rows are put into at most ``parts`` blocks between quantiles of the order, so that outliers don't fill one block; places are counted inside a block, and the sizes of
    the blocks before it, at most ``parts`` numbers a group, are added. Rows with a null order have no place; rows of equal order are placed in any order; keys
    may be null. The quantiles (approximate; they only balance the work) are computed when this is called.
    """
    by = by or []
    found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    if found is None:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    rows = df.withColumn("_block", F.when(F.col(order).isNotNull(), _block_of(F.col(order), sorted(set(found)))))
    sizes = rows.where("_block is not null").groupBy(*by, "_block").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_block").alias("_b"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)))
    same = F.col("_block") == F.col("_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = placed.join(before if by else F.broadcast(before), same, "left")
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_block", "_in", "_before", "_b", *[f"_k_{c}" for c in by])


def make_unique(df: DataFrame, name: str, order: str, out: str, sep: str = ".") -> DataFrame:
    """Names made unique: the second and further of a name by order get ``.1``, ``.2`` ...; one that clashes with a given name gets one more ``.1``."""
    numbered = with_rank(df, order, "_k", [name])
    taken = df.select(F.col(name).alias("_taken")).distinct()
    tried = numbered.withColumn("_new", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(sep), (F.col("_k") - 1).cast("string"))))
    clash = tried.join(taken, (F.col("_k") > 1) & (F.col("_new") == F.col("_taken")), "left")
    return clash.withColumn(out, F.when(F.col("_taken").isNotNull(), F.concat(F.col("_new"), F.lit(sep + "1"))).otherwise(F.col("_new"))).drop("_k", "_new", "_taken")


def consecutive_runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows (*by, run_start, run_end, n): runs of consecutive whole numbers in each group; repeated numbers count once."""
    rows = df.select(*by, value).where(F.col(value).isNotNull()).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return rows.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(value).alias("run_start"), F.max(value).alias("run_end"), F.count("*").alias("n")).drop("_i")


def unpivot_non_null(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """One row per id and column whose value isn't null."""
    return df.unpivot(ids, values, name, value).where(F.col(value).isNotNull())


def pivot_columns(df: DataFrame, by: list[str], key: str, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per group with a column ``<value>_<key>`` for each value and key; the keys are given, so that columns can be pruned."""
    made = []
    for k in keys:
        for name, agg in values.items():
            made.append((f"{k}_{name}" if len(values) > 1 else k, f"{name}_{k}"))
    wide = df.groupBy(*by).pivot(key, keys).agg(*[a.alias(n) for n, a in values.items()])
    return wide.select(*by, *[F.col(f"`{old}`").alias(new) for old, new in made])


def coalesce_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """A join in which keys that are null on both sides match, and columns of one name are merged: the left value, or the right one."""
    shared = [c for c in left.columns if c in right.columns and c not in by]
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    cond = F.lit(True)
    for c in by:
        cond = cond & left[c].eqNullSafe(r[f"_r_{c}"])
    joined = left.join(r, cond, how)
    kept = [F.coalesce(left[c], r[f"_r_{c}"]).alias(c) if c in by or c in shared else left[c] for c in left.columns]
    return joined.select(*kept, *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns])


def join_many(tables: dict[str, DataFrame], by: list[str], value: str) -> DataFrame:
    """A full join of many tables on the same keys, each giving its value under its name: one union and one aggregation."""
    long = None
    for name, t in tables.items():
        part = t.select(*by, F.lit(name).alias("_name"), F.col(value).alias("_value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in tables])


def constant_columns(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (*by, *columns): the value of each column that is the same in all rows of the group (nulls aside), else null."""
    return df.groupBy(*by).agg(*[F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in columns])


def exact_sample(df: DataFrame, p: float, key: str, seed: int = 42) -> DataFrame:
    """p > 1: that many rows (or all); p < 1: that share, rounded. The sample is exact and the same for the same seed and keys.

    Rows are counted by 2^16 ranges of a hash of the key, the only numbers that come to the driver; whole ranges are taken, and of the last one the first rows by hash.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned(h, 48))
    counts = sorted((r["_b"], r["count"]) for r in rows.groupBy("_b").count().collect())
    total = sum(n for _, n in counts)
    left = min(total, int(p)) if p > 1 else round(total * p)
    for b, n in counts:
        if n > left:
            part = rows.where(F.col("_b") == b).orderBy("_h", key).limit(left)
            return rows.where(F.col("_b") < b).unionByName(part).drop("_h", "_b")
        left -= n
    return df
