"""Joins of strings by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.spread import spread_join
from strandloom.session import cut_lineage


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of a string of that length, cut into ``parts``; longer segments come last."""
    base, more = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    longer_before = F.greatest(F.lit(0), F.lit(i) - (parts - more))
    return F.lit(i) * base + longer_before + 1, base + (F.lit(i) >= (parts - more)).cast("int")


def _pieces(places: Column, i: int, text: Column, length: Column) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(i).alias("i"), F.substr(text, p, length).alias("seg")))


def edit_join(left: DataFrame, right: DataFrame, left_str: str, right_str: str, most: int, left_block: Column | None = None, right_block: Column | None = None) -> DataFrame:
    """Rows (*left, *right, lv): pairs of one block whose edit distance is at most ``most``. Both sides are made distinct; nulls match nothing; no column of one side is named
    like one of the other.

    If the distance is at most k, one of k + 1 segments of the right string occurs unchanged in the left one, shifted by no more than the edits before or
    behind it allow. So segments are joined by equality with the substrings at those places, and only such pairs are verified:
    no pair is lost, and no group of one block is paired with itself. Strings of at most k letters, which have empty segments, are joined by length.
    Segments that very many strings share, such as a common beginning, are dealt out to several groups (``spread_join``).
    """
    k, parts = most, most + 1
    lb = left_block if left_block is not None else F.lit("")
    rb = right_block if right_block is not None else F.lit("")
    # each string makes many keys: even partitions of a fixed number, which aren't coalesced by the few bytes they hold before
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    a = left.where(F.col(left_str).isNotNull()).distinct().repartition(tasks).withColumn("_block", lb.cast("string"))
    b = right.where(F.col(right_str).isNotNull()).distinct().withColumn("_rblock", rb.cast("string"))
    b = b.where("_rblock is not null").withColumn("_len", F.length(right_str))
    kinds = []
    for i in range(parts):
        s, n = _segment(F.col("_len"), i, parts)
        kinds.append(F.when(F.col("_len") > k, F.struct(F.lit(i).alias("i"), F.substr(F.col(right_str), s, n).alias("seg"))))
    kinds.append(F.when(F.col("_len") <= k, F.struct(F.lit(-1).alias("i"), F.lit("").alias("seg"))))
    keys = b.select("*", F.explode(F.array_compact(F.array(*kinds))).alias("_s")).select(*b.columns, F.col("_s.i").alias("_i"), F.col("_s.seg").alias("_seg"))

    n_left = F.length(left_str)
    a = a.where("_block is not null").select("*", F.explode(F.sequence(F.greatest(F.lit(0), n_left - k), n_left + k)).alias("_want"))
    delta = n_left - F.col("_want")
    offers = []
    for i in range(parts):
        s, n = _segment(F.col("_want"), i, parts)
        low = F.greatest(F.lit(1), s - i, s + delta - (k - i))
        high = F.least(n_left - n + 1, s + i, s + delta + (k - i))
        places = F.when((F.col("_want") > k) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        offers.append(_pieces(places, i, F.col(left_str), n))
    short = F.when(F.col("_want") <= k, F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("seg")))).otherwise(F.array().cast("array<struct<i:int,seg:string>>"))
    asked = a.select("*", F.explode(F.array_distinct(F.concat(*offers, short))).alias("_o")).select(*a.columns, F.col("_o.i").alias("_oi"), F.col("_o.seg").alias("_oseg"))
    names = ["_k_block", "_k_len", "_k_i", "_k_seg"]  # a common beginning makes some of these keys hot
    asked = asked.select(*left.columns, *[F.col(c).alias(n) for c, n in zip(("_block", "_want", "_oi", "_oseg"), names)])
    keys = keys.select(*right.columns, *[F.col(c).alias(n) for c, n in zip(("_rblock", "_len", "_i", "_seg"), names)])
    near = spread_join(asked, keys, names)
    lv = F.levenshtein(F.col(left_str), F.col(right_str), k)
    found = near.withColumn("lv", lv).where("lv >= 0").select(*left.columns, *right.columns, "lv")
    return found.distinct()


def _one_edit(left: DataFrame, right: DataFrame, by: list[str], left_str: str, right_str: str) -> DataFrame:
    """Rows (*by, left_str, right_str, lv): pairs with equal ``by`` and an edit distance of at most 1. Such strings are equal, or become so when either loses one letter at most."""

    def keyed(df: DataFrame, c: str) -> DataFrame:
        s = F.col(c)
        less = F.transform(F.sequence(F.lit(0), F.length(s)), lambda i: F.when(i == 0, s).otherwise(F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))))
        return df.select(*by, c, F.explode(F.array_distinct(F.transform(less, lambda x: F.xxhash64(*[F.col(b) for b in by], x)))).alias("_key"))

    near = spread_join(keyed(left, left_str), keyed(right, right_str).select(*[F.col(b).alias(f"_r{b}") for b in by], right_str, "_key"), ["_key"])
    for b in by:
        near = near.where(F.col(b) == F.col(f"_r{b}"))
    return near.withColumn("lv", F.levenshtein(left_str, right_str, 1)).where("lv >= 0").select(*by, left_str, right_str, "lv").distinct()


def nearest_names(queries: DataFrame, names: DataFrame, query: str, name: str) -> DataFrame:
    """Rows (query, name, lv): of the names that begin with the same letters and number, all at the least edit distance.

    What follows that beginning is compared, in lower case, and each distinct rest once. Names at a distance of at most 1 are met by the letters that are left when one is dropped, for what has none of
    these a distance of at most 3 is tried by segments (``edit_join``), and only queries without a name so near are compared with all names of their beginning. Each step is
    written once when this is called, and the next is left out when no query remains.
    """
    prefix = lambda c: F.regexp_extract(F.lower(F.col(c)), "^[a-z]+[0-9]+", 0)
    rest = lambda c, p: F.substr(F.lower(F.col(c)), F.length(p) + 1)
    q = queries.select(query).where(F.col(query).isNotNull()).distinct().withColumn("_p", prefix(query)).withColumn("_q", rest(query, "_p"))
    n = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_np", prefix(name)).withColumn("_n", rest(name, "_np"))
    q, n = cut_lineage(q), cut_lineage(n)  # read for each distance and for the result
    todo, known = q.select("_p", "_q").distinct(), n.select(F.col("_np").alias("_p"), "_n").distinct()
    found = None
    for most in (1, 3):
        if most == 1:
            near = _one_edit(todo, known, ["_p"], "_q", "_n")
        else:
            near = edit_join(todo, known.withColumnRenamed("_p", "_np"), "_q", "_n", most, F.col("_p"), F.col("_np")).select("_p", "_q", "_n", "lv")
        near = cut_lineage(near)
        found = near if found is None else found.unionByName(near)
        todo = cut_lineage(todo.join(near, ["_p", "_q"], "left_anti"))
        if todo.isEmpty():
            break
    else:  # far from every name: the least distance first, without keeping the pairs, then the names at it
        pairs = spread_join(todo, known, ["_p"])
        least = pairs.groupBy("_p", "_q").agg(F.min(F.levenshtein("_q", "_n")).alias("lv"))
        found = found.unionByName(spread_join(least, known, ["_p"]).where(F.levenshtein("_q", "_n") == F.col("lv")).select("_p", "_q", "_n", "lv"))
    least = found.groupBy("_p", "_q").agg(F.min("lv").alias("_least"))
    best = found.join(least, ["_p", "_q"]).where("lv = _least").select("_p", "_q", "_n", "lv")
    return q.join(best, ["_p", "_q"]).join(n.withColumnRenamed("_np", "_p"), ["_p", "_n"]).select(query, name, "lv")


def chain_column(df: DataFrame, columns: list[str], values: tuple[str, ...] = ("TRA", "TRB"), rows: int = 100) -> str:
    """The column in which the first ``rows`` rows, in order of the columns, hold the chain names most often: it tells which column is meant, no row depends on it otherwise."""
    head = df.select(*columns).orderBy(*columns).limit(rows).agg(*[F.avg(F.upper(F.col(c).cast("string")).isin(list(values)).cast("double")).alias(c) for c in columns]).first()
    return max(columns, key=lambda c: head[c] or 0.0)


def cdr3_hits(tcrs: DataFrame, known: DataFrame, most: int = 3, crossed: tuple[bool, ...] = (False,)) -> DataFrame:
    """Rows (tcr_chain, tcr_cdr3, vdj_chain, vdj_cdr3, lv): sequences of the table near known ones of the same chain, or of the other one if ``crossed``.

    Both tables have chain and cdr3; all is compared in upper case; a chain other than TRA and TRB fails.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        c = F.upper("chain")
        chain = F.when(c.isin("TRA", "TRB"), c).when(c.isNotNull(), F.raise_error(F.concat(F.lit("unknown chain "), c)))
        return df.select(chain.alias(f"{p}_chain"), F.upper("cdr3").alias(f"{p}_cdr3")).where(f"{p}_cdr3 is not null and {p}_chain is not null")

    a, b = side(tcrs, "tcr"), side(known, "vdj")
    out = None
    for swap in crossed:
        other = F.when(F.col("vdj_chain") == "TRA", "TRB").otherwise("TRA") if swap else F.col("vdj_chain")
        hits = edit_join(a, b, "tcr_cdr3", "vdj_cdr3", most, F.col("tcr_chain"), other)
        out = hits if out is None else out.unionByName(hits)
    return out


def with_similarity(hits: DataFrame, matrix: dict, first: str = "vdj_cdr3", second: str = "tcr_cdr3", name: str = "PAM30", gap_open: float = -10, gap_extend: float = -4) -> DataFrame:
    """The hits with ``name``, the score of the global alignment by a substitution matrix such as PAM30 (``align.read_matrix``), and ``name``_corr: that score divided by the mean of
    the two sequences' scores with themselves. Distinct pairs are scored once; a null sequence gives nulls."""
    from strandloom.operators.align import align_columns

    pairs = hits.select(F.col(first).alias("_a"), F.col(second).alias("_b")).where("_a is not null and _b is not null").distinct()
    every = pairs.unionByName(pairs.selectExpr("_a", "_a as _b")).unionByName(pairs.selectExpr("_b as _a", "_b")).distinct()
    scored = align_columns(every, ["_a", "_b"], "_a", "_b", mode="global", gap_open=gap_open, gap_extend=gap_extend, matrix=matrix, least=float("inf")).select("_a", "_b", "score")
    own = scored.where("_a = _b").select(F.col("_a").alias("_s"), F.col("score").alias("_own"))
    pairs = scored.join(own, F.col("_a") == F.col("_s")).withColumnRenamed("_own", "_own_a").drop("_s").join(own, F.col("_b") == F.col("_s")).drop("_s")
    pairs = pairs.select("_a", "_b", F.col("score").alias(name), (F.col("score") / ((F.col("_own_a") + F.col("_own")) / 2)).alias(f"{name}_corr"))
    return hits.join(pairs, (F.col(first) == F.col("_a")) & (F.col(second) == F.col("_b")), "left").drop("_a", "_b")
