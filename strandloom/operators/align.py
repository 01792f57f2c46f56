"""Pairwise alignment in Arrow batches: all pairs of a batch fill their matrices together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut_lineage

#: Cells of all matrices that are held at once.
CELLS = 24_000_000

MODES = ("global", "semiglobal", "overlap", "global-local", "local-global", "local")

_DIAGONAL, _UP, _LEFT, _STOP = range(4)


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def align_pairs(first: list[str], second: list[str], mode: str = "semiglobal", match: float = 1, mismatch: float = -1, gap_open: float = 0, gap_extend: float = -1, matrix: dict | None = None, least: float | None = None) -> list[tuple | None]:
    """(score, first aligned, second aligned, first start, first end, second start, second end) of each pair; starts from 1.

    Modes: global; semiglobal (gaps at either end are free, on both) and overlap, the same; global-local (the whole first in a stretch of the second) and local-global (the other way
    round), of which only the stretch is returned; local (the best stretch of both). Another mode fails. A gap of n costs gap_open + n x gap_extend
    (both given as what is added, so negative or 0). At a tie the diagonal comes before a gap in the first sequence, and that before one in the second. ``matrix``
    scores letter pairs instead of match and mismatch. Below the score ``least`` nothing is traced: the aligned strings are None. A null gives None.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
    out: list[tuple | None] = [None] * len(first)
    todo = [i for i in range(len(first)) if first[i] is not None and second[i] is not None]
    todo.sort(key=lambda i: (len(first[i]) // 16, len(second[i])))  # those of about one size together
    at = 0
    while at < len(todo):
        to, wide, high = at, 0, 0
        while to < len(todo):
            w, h = max(wide, len(first[todo[to]])), max(high, len(second[todo[to]]))
            if to > at and (to - at + 1) * (w + 1) * (h + 1) > CELLS:
                break
            wide, high, to = w, h, to + 1
        part = todo[at:to]
        for i, r in zip(part, _block([first[i] for i in part], [second[i] for i in part], mode, match, mismatch, gap_open, gap_extend, matrix, least)):
            out[i] = r
        at = to
    return out


def _whole(*values: float) -> bool:
    return all(float(v).is_integer() for v in values)


def _block(first, second, mode, match, mismatch, gap_open, gap_extend, matrix, least):
    """The pairs lie along the last axis, so that each step over a cell of all matrices reads and writes memory in a row; of the scores only two rows are held."""
    n = len(first)
    lx, ly = np.array([len(s) for s in first]), np.array([len(s) for s in second])
    w, h = int(lx.max()), int(ly.max())
    x, y = np.ascontiguousarray(_codes(first, w, -1).T), np.ascontiguousarray(_codes(second, h, -2).T)
    free_first = mode in ("semiglobal", "overlap", "local-global")  # ends of the first sequence beyond the second cost nothing
    free_second = mode in ("semiglobal", "overlap", "global-local")
    local = mode == "local"
    affine = gap_open != 0
    costs = [match, mismatch, gap_open, gap_extend, gap_open + gap_extend, *(matrix or {}).values()]
    # whole scores are exact in small integers; others are summed as doubles and held as floats
    reach = (w + h + 2) * max(1, *[abs(c) for c in costs])
    held, summed = (np.int16, np.int16) if _whole(*costs) and reach < 8000 else (np.float32, np.float64)
    low = held(-16000) if held is np.int16 else held(-1e9)
    match, mismatch, first_gap, next_gap = (summed(c) for c in (match, mismatch, gap_open + gap_extend, gap_extend))
    none, gain = summed(0), summed(match - mismatch)
    if max(x.max(initial=0), y.max(initial=0)) < 128:
        x, y = x.astype(np.int8), y.astype(np.int8)
    way = np.full((h + 1, w + 1, n), _STOP, np.uint8)
    long_up = np.zeros((h + 1, w + 1, n), bool) if affine else None
    long_left = np.zeros((h + 1, w + 1, n), bool) if affine else None
    up_gap = np.full((w + 1, n), low, held)
    edge = lambda k: (gap_open + gap_extend * np.arange(1, k + 1)).astype(held)
    above = np.zeros((w + 1, n), held)
    side = np.zeros(h + 1, held)
    if not local:
        way[0, 1:], way[1:, 0] = _LEFT, _UP
        if not free_first:
            above[1:] = edge(w)[:, None]
        if not free_second:
            side[1:] = edge(h)
        if affine:
            long_left[0, 2:], long_up[2:, 0] = True, True
    table = None
    if matrix is not None:
        letters = sorted({c for pair in matrix for c in pair})
        place = {ord(c): k for k, c in enumerate(letters)}
        table = np.full((len(letters) + 1, len(letters) + 1), mismatch, held)
        for (a, b), v in matrix.items():
            table[place[ord(a)], place[ord(b)]] = table[place[ord(b)], place[ord(a)]] = v
        lookup = np.vectorize(lambda c: place.get(int(c), len(letters)), otypes=[np.int64])
        xi, yi = lookup(x), lookup(y)
    end_i, end_j, score = ly.copy(), lx.copy(), np.zeros(n, held)
    cols = np.arange(n)
    if local:
        end_i[:], end_j[:] = 0, 0
        inside = np.arange(w + 1)[:, None] <= lx
    ends = [lx == j for j in range(w + 1)] if free_second else None
    at_end = [bool(e.any()) for e in ends] if free_second else [False] * (w + 1)
    if not local and not ly.all():
        score = np.where(ly == 0, above[lx, cols], score)
    same, more, diagonal = np.empty(n, bool), np.empty(n, bool), np.empty(n, held)
    same_bits, more_bits = same.view(np.int8), more.view(np.uint8)
    for i in range(1, h + 1):
        row = np.empty_like(above)
        row[0] = side[i]
        left_gap = np.full(n, low, held)
        last_row = ly == i
        ends_here = bool(last_row.any())
        free_row = free_first and ends_here
        if held is np.int16:
            below = above + mismatch
            over = above if affine else above + next_gap
        for j in range(1, w + 1):
            if table is not None:
                diagonal = above[j - 1] + table[xi[j - 1], yi[i - 1]]
            elif held is np.int16:
                np.equal(x[j - 1], y[i - 1], out=same)
                np.multiply(same_bits, gain, out=diagonal)
                diagonal += below[j - 1]
            else:
                diagonal = above[j - 1] + np.where(x[j - 1] == y[i - 1], match, mismatch)
            free_col = at_end[j]
            if affine:
                opened = above[j] + (np.where(ends[j], none, first_gap) if free_col else first_gap)
                longer = up_gap[j] + (np.where(ends[j], none, next_gap) if free_col else next_gap)
                np.greater(longer, opened, out=long_up[i, j])
                up = np.maximum(opened, longer)
                up_gap[j] = up
                opened = row[j - 1] + (np.where(last_row, none, first_gap) if free_row else first_gap)
                longer = left_gap + (np.where(last_row, none, next_gap) if free_row else next_gap)
                np.greater(longer, opened, out=long_left[i, j])
                left_gap = left = np.maximum(opened, longer)
            else:
                up = above[j] + np.where(ends[j], none, next_gap) if free_col else over[j] if held is np.int16 else above[j] + next_gap
                left = row[j - 1] + (np.where(last_row, none, next_gap) if free_row else next_gap)
            step = way[i, j]
            np.greater(left, up, out=more)
            np.add(more_bits, np.uint8(_UP), out=step)  # _UP, or _LEFT if that is more
            top = np.maximum(up, left)
            np.less(diagonal, top, out=more)
            np.multiply(step, more_bits, out=step)  # _DIAGONAL at a tie
            top = np.maximum(diagonal, top, out=row[j] if held is summed else top)
            if local:
                np.less_equal(top, none, out=more)
                np.maximum(step, more_bits * np.uint8(_STOP), out=step)
                np.maximum(top, none, out=top)
            if held is not summed:
                row[j] = top
        if local:
            own = np.where(inside, row, low)
            top = own.max(axis=0)
            better = (top > score) & (ly >= i)
            if better.any():
                end_i[better], end_j[better] = i, own[:, better].argmax(axis=0)
                score = np.where(better, top, score)
        elif ends_here:
            score = np.where(last_row, row[lx, cols], score)
        above = row
    traced = np.ones(n, bool) if least is None else score >= least
    lines, begun_i, begun_j = _trace(x, y, way, long_up, long_left, np.where(traced, end_i, 0), np.where(traced, end_j, 0))
    out = []
    for k in range(n):
        if not traced[k]:
            out.append((float(score[k]), None, None, None, None, None, None))
            continue
        (a, b), i, j, end1, end2 = lines[k], int(begun_i[k]), int(begun_j[k]), int(end_j[k]), int(end_i[k])
        if mode in ("global-local", "local-global"):  # without the free ends
            inner = a if mode == "global-local" else b
            cut, keep = len(inner) - len(inner.lstrip("-")), len(inner.rstrip("-"))
            behind = len(inner) - keep
            a, b = a[cut:keep], b[cut:keep]
            if mode == "global-local":
                i, end2 = i + cut, end2 - behind
            else:
                j, end1 = j + cut, end1 - behind
        out.append((float(score[k]), a, b, j + 1, end1, i + 1, end2))
    return out


def _trace(x, y, way, long_up, long_left, i, j):
    """The aligned strings of all pairs, traced together from the cells (i, j), and the cells they begin behind."""
    n, i, j = len(i), i.astype(np.int64), j.astype(np.int64)
    size = int((i + j).max()) if n else 0
    kind = np.uint8 if x.dtype == np.int8 else np.uint32
    a, b = np.zeros((n, size), kind), np.zeros((n, size), kind)
    count = np.zeros(n, np.int64)
    steps, wide = way.reshape(-1), way.shape[1] * n
    xs, ys = (np.concatenate([np.zeros((1, n), m.dtype), m]).astype(kind).reshape(-1) for m in (x, y))
    k, r, c = np.arange(n), i.copy(), j.copy()
    forced = np.full(n, -1, np.int64)
    at = size
    while True:
        cell = r * wide + c * n + k
        step = steps[cell]
        if long_up is not None:
            step = np.where(forced >= 0, forced, step)
        on = (step != _STOP) & ((r > 0) | (c > 0))
        if not on.all():
            off = k[~on]
            i[off], j[off], count[off] = r[~on], c[~on], size - at
            k, r, c, step, cell, forced = k[on], r[on], c[on], step[on], cell[on], forced[on]
        if not len(k):
            break
        at -= 1
        up, left = step == _UP, step == _LEFT
        a[k, at] = np.where(up, kind(ord("-")), xs[c * n + k])
        b[k, at] = np.where(left, kind(ord("-")), ys[r * n + k])
        if long_up is not None:
            longer = np.where(up, long_up.reshape(-1)[cell], left & long_left.reshape(-1)[cell])
            forced = np.where(longer, step, -1)
        r = r - ~left
        c = c - ~up
    code = "ascii" if kind is np.uint8 else "utf-32-le"
    text = lambda m, q: m[q, size - count[q] :].tobytes().decode(code)
    return [(text(a, q), text(b, q)) for q in range(n)], i, j


RESULT = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("first_aligned", T.StringType()), T.StructField("second_aligned", T.StringType()),
    T.StructField("first_start", T.IntegerType()), T.StructField("first_end", T.IntegerType()), T.StructField("second_start", T.IntegerType()), T.StructField("second_end", T.IntegerType()),
])


def align_columns(df: DataFrame, keep: list[str], first: str, second: str, **options) -> DataFrame:
    """The columns ``keep`` and the alignment of two columns, row by row: see ``align_pairs``. Null where one is null."""
    spark = df.sparkSession
    # filling matrices takes far longer than moving the rows: a fixed number of even partitions, which isn't coalesced by size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(*keep, F.col(first).alias("_x"), F.col(second).alias("_y")).repartition(tasks)
    schema = T.StructType([*rows.select(*keep).schema.fields, *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = align_pairs(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), **options)
            columns = list(zip(*[r or (None,) * 7 for r in found])) if found else [()] * 7
            kinds = [pa.float64(), pa.string(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(c, k) for c, k in zip(columns, kinds)]], schema.names)

    return rows.mapInArrow(run, schema)


def align_distinct(df: DataFrame, keep: list[str], first: str, second: str, **options) -> DataFrame:
    """The same, with each distinct pair aligned once."""
    pairs = df.select(F.col(first).alias("_a"), F.col(second).alias("_b")).where("_a is not null and _b is not null").distinct()
    done = align_columns(pairs, ["_a", "_b"], "_a", "_b", **options)
    return df.select(*keep, F.col(first).alias("_f"), F.col(second).alias("_s")).join(done, (F.col("_f") == F.col("_a")) & (F.col("_s") == F.col("_b"))).drop("_f", "_s", "_a", "_b")


def read_matrix(path: str) -> dict:
    """A substitution matrix in the usual text form: a line of letters, then a line per letter."""
    rows = [line.split() for line in open(path) if line.strip() and not line.startswith("#")]
    return {(r[0], c): float(v) for r in rows[1:] for c, v in zip(rows[0], r[1:])}


def best_alleles(seqs: DataFrame, refs: DataFrame, by: list[str], seq: str, gene: str, **options) -> DataFrame:
    """Rows (*by, allele, score): of the alleles of a sequence's gene the one it aligns to best locally, of equals the first in order.

    refs: gene, allele, ref_seq. Genes are matched by the letters and number they begin with.
    """
    prefix = lambda c: F.regexp_extract(F.lower(F.col(c)), "^[a-z]+[0-9]+", 0)
    q = seqs.withColumn("_p", prefix(gene))
    c = q.join(refs.withColumnRenamed("gene", "_ref_gene").withColumn("_rp", prefix("_ref_gene")), F.col("_p") == F.col("_rp"))
    scored = align_distinct(c, [*by, "allele"], seq, "ref_seq", mode="local", **options)
    return scored.groupBy(*by).agg(F.max_by("allele", F.struct("score", F.col("allele"))).alias("_x"), F.max("score").alias("score"), F.min_by("allele", F.struct(-F.col("score"), F.col("allele"))).alias("allele")).drop("_x")


def placed_on_subject(aligned: DataFrame, by: list[str], name: str, pattern: str = "first_aligned", subject: str = "second_aligned", start: str = "second_start") -> DataFrame:
    """Rows (*by, name, subject_pos, insert_no, seq): letters of aligned patterns by the place of the subject; letters in gaps of the subject have the place
    before them and count up from 1."""
    rows = aligned.where(F.col(pattern).isNotNull() & F.col(subject).isNotNull()).select(*by, name, F.col(pattern).alias("_p"), F.col(subject).alias("_s"), F.col(start).cast("int").alias("_a"))
    n = len(by) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("subject_pos", T.IntegerType()), T.StructField("insert_no", T.IntegerType()), T.StructField("seq", T.StringType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, pos, ins, letters = [], [], [], []
            for k, (p, s, first) in enumerate(zip(*[batch.column(n + i).to_pylist() for i in range(3)])):
                solid = np.frombuffer(s.encode("utf-32-le"), np.uint32) != ord("-")
                at = np.arange(len(s))
                last = np.maximum.accumulate(np.where(solid, at, -1))
                parent.append(np.full(len(s), k))
                pos.append(first - 1 + np.cumsum(solid))
                ins.append(at - last)
                letters += p
            if letters:
                rows_of = pa.array(np.concatenate(parent))
                cells = [batch.column(i).take(rows_of) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(ins), pa.int32()), pa.array(letters, pa.string())], schema.names)

    return rows.mapInArrow(place, schema)


#: Letters that one batch of a multiple alignment gives out at most, unless one row alone has more.
LETTERS = 1_000_000


def _letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a column of strings in a row, and how many each row has; null has none."""
    texts = [t or "" for t in column.to_pylist()]
    flat = "".join(texts)
    codes = np.frombuffer(flat.encode(), np.uint8) if flat.isascii() else np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    return codes, np.fromiter(map(len, texts), np.int64, len(texts))


def _as_strings(codes: np.ndarray) -> pa.Array:
    """A string of each code point."""
    if codes.dtype == np.uint8:
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32)), pa.py_buffer(codes.tobytes()))
    return pa.array([chr(c) for c in codes], pa.string())


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many letters each: each letter's row, and its place in it."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Frames:
    """The frames of the groups of one batch. For each subject place: whether a letter stands there, and how many letters are inserted behind it; place 0 is before the subject."""

    def __init__(self, group: np.ndarray, places: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None):
        """``places``: for each row the last place it needs. ``held``: what is known of the first group, from batches before."""
        n = int(group[-1]) + 1
        last = np.zeros(n, np.int64)
        np.maximum.at(last, group, places)
        if held is not None:
            last[0] = max(last[0], len(held[0]) - 1)
        self.start = np.concatenate([[0], np.cumsum(last + 1)])
        self.solid, self.more = np.zeros(self.start[-1], bool), np.zeros(self.start[-1], np.int64)
        if held is not None:
            self.solid[: len(held[0])], self.more[: len(held[1])] = held

    def add(self, group: np.ndarray, place: np.ndarray, insert: np.ndarray) -> None:
        at = self.start[group] + place
        self.solid[at[insert == 0]] = True
        some = insert > 0
        np.maximum.at(self.more, at[some], insert[some])

    def position(self, group: np.ndarray, place: np.ndarray, insert: np.ndarray) -> np.ndarray:
        """The rank among the group's columns, from 1."""
        n = np.concatenate([[0], np.cumsum(self.solid + self.more)])
        at = self.start[group] + place
        return n[at] - n[self.start[group]] + self.solid[at] + insert

    def of(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[group], self.start[group + 1]
        return self.solid[a:b].copy(), self.more[a:b].copy()


def multi_alignment(aligned: DataFrame, subjects: DataFrame | str, by: list[str], name: str, pattern: str = "first_aligned", subject: str = "second_aligned", start: str = "second_start") -> DataFrame:
    """Rows (*by, name, position, subject_pos, seq): many patterns in the frame of their subject, with gaps where a pattern inserts letters.

    subjects: *by, subject_seq; or the name of the column of ``aligned`` that holds the subject, the same on all rows of ``by``, also on those without an alignment.
    A position is the rank of (subject place, insertion number) among those that occur; subject_pos is null on inserted columns, where the
    subject itself (name ``subject``) has ``-``. A subject's frame has no more places than it and its insertions.

    Only whole aligned strings are shuffled, once, and sorted by ``by``. Each row comes twice: first all rows of a subject give its frame, then all give their letters. So a task holds
    the frame of the subject it is at, and no more rows than a batch, however many patterns a subject has; these are in one task, though.
    """
    strings = lambda *cs: [F.col(c).cast("string").alias(t) if c else F.lit(None).cast("string").alias(t) for c, t in zip(cs, ("_n", "_p", "_s", "_t"))]
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    found = F.col(pattern).isNotNull() & F.col(subject).isNotNull()
    if isinstance(subjects, str):
        rows = aligned.where(known).select(*by, F.col(name).cast("string").alias("_n"), F.when(found, F.col(pattern)).alias("_p"), F.when(found, F.col(subject)).alias("_s"), F.col(subjects).alias("_t"), F.col(start).cast("int").alias("_a"))
    else:
        rows = aligned.where(known & found).select(*by, *strings(name, pattern, subject, None), F.col(start).cast("int").alias("_a"))
        rows = rows.unionByName(subjects.where(known).select(*by, *strings(None, None, None, "subject_seq"), F.lit(None).cast("int").alias("_a")))
    same_subject = isinstance(subjects, str)
    tasks = max(int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions")), aligned.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, *by).withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1)))).sortWithinPartitions(*by, "_turn")
    n = len(by)
    schema = T.StructType([*rows.schema.fields[:n], T.StructField(name, T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("subject_pos", T.IntegerType()), T.StructField("seq", T.StringType())])

    most = LETTERS

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.add(pc.fill_null(pc.utf8_length(batch.column(n + 1)), 0), pc.fill_null(pc.utf8_length(batch.column(n + 3)), 0)).to_numpy(zero_copy_only=False)
            part = (np.cumsum(size) - size) // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield batch.slice(a, b - a)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, gapped = None, None, False  # of the group at the end of the batch before: its frame, and whether its gaps are given out
        for batch in batches_of(batches):
            m = batch.num_rows
            new = np.zeros(m, bool)
            for i in range(n):
                c = batch.column(i)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(i)[0].as_py() for i in range(n))
            group = np.cumsum(new)
            goes_on = held is not None and first == key
            turn = batch.column(n + 5).to_numpy(zero_copy_only=False)
            p, p_n = _letters_of(batch.column(n + 1))
            s, _ = _letters_of(batch.column(n + 2))
            t, t_n = _letters_of(batch.column(n + 3))
            row, at = _within(p_n)
            solid = s != ord("-")
            last = np.maximum.accumulate(np.where(solid | (at == 0), np.arange(len(row)), 0))  # the last letter of the subject, or the beginning
            counted = np.cumsum(solid)
            begin = np.cumsum(p_n) - p_n
            before = np.concatenate([[0], counted])[begin]
            pos = pc.fill_null(batch.column(n + 4), 1).to_numpy(zero_copy_only=False).astype(np.int64)[row] - 1 + counted - before[row]
            ins = np.arange(len(row)) - last + ~solid[last] if len(row) else last
            t_row, t_at = _within(t_n)
            need = t_n.copy()
            np.maximum.at(need, row, pos)
            frames = _Frames(group, need, held if goes_on else None)
            one = turn == 0
            own = one[row]
            frames.add(group[row[own]], pos[own], ins[own])
            own = one[t_row]
            frames.add(group[t_row[own]], t_at[own] + 1, np.zeros(int(own.sum()), np.int64))
            # letters
            give = ~one[row]
            row, pos, ins, p = row[give], pos[give], ins[give], p[give]
            shown = ~one & (t_n > 0)
            subject_row = np.flatnonzero(shown)
            lead = np.ones(len(subject_row), bool)  # the first row with the subject of each group gives its gaps; of the same subject on several rows, it alone is shown
            lead[1:] = group[subject_row[1:]] != group[subject_row[:-1]]
            if len(subject_row) and goes_on and gapped and group[subject_row[0]] == 0:
                lead[0] = False
            gap_group, gap_row = group[subject_row[lead]], subject_row[lead]
            if same_subject:
                shown = np.zeros(m, bool)
                shown[gap_row] = True
            give = shown[t_row]
            t_row, t_at, t = t_row[give], t_at[give], t[give]
            lengths = frames.start[gap_group + 1] - frames.start[gap_group]
            k, g_pos = _within(lengths)
            inserted = frames.more[frames.start[gap_group][k] + g_pos]
            j, g_ins = _within(inserted)
            g_row, g_pos, g_ins = gap_row[k[j]], g_pos[j], g_ins + 1
            rows_of = np.concatenate([row, t_row, g_row])
            if len(rows_of):
                places, inserts = np.concatenate([pos, t_at + 1, g_pos]), np.concatenate([ins, np.zeros(len(t_row), np.int64), g_ins])
                wide = np.uint8 if p.dtype == t.dtype == np.uint8 else np.uint32
                letters = np.concatenate([p.astype(wide), t.astype(wide), np.full(len(g_row), ord("-"), wide)])
                names = pa.concat_arrays([batch.column(n).take(pa.array(row)), pa.repeat("subject", len(t_row) + len(g_row))])
                cells = [batch.column(i).take(pa.array(rows_of)) for i in range(n)]
                position = frames.position(group[rows_of], places, inserts)
                yield pa.RecordBatch.from_arrays([*cells, names, pa.array(position.astype(np.int32)), pa.array(places.astype(np.int32), mask=inserts > 0), _as_strings(letters)], schema.names)
            end = int(group[-1])
            gapped = bool((gap_group == end).any()) or (goes_on and gapped and end == 0)
            key, held = tuple(batch.column(i)[m - 1].as_py() for i in range(n)), frames.of(end)

    return rows.mapInArrow(place, schema)


def segment_span(seqs: DataFrame, refs: DataFrame, seq: str = "seq", v: str = "v_gene", j: str = "j_gene", **options) -> DataFrame:
    """Rows (v_gene, j_gene, seq, v_allele, j_allele, v_start, v_end, j_start, j_end, v_to_j): for each pair of segments the most frequent sequence (of equals the first in
    order), where the best allele of either segment lies in it, and the stretch from the first base of the one to the last of the other. refs: gene, allele, ref_seq."""
    pairs = seqs.where(F.col(v).isNotNull() & F.col(j).isNotNull() & (F.length(seq) > 0)).groupBy(F.col(v).alias("v_gene"), F.col(j).alias("j_gene")).agg(F.mode(seq, True).alias("seq"))
    pairs = cut_lineage(pairs)
    out = pairs
    for side, gene in (("v", "v_gene"), ("j", "j_gene")):
        best = best_alleles(pairs.withColumn("_g", F.col(gene)), refs, ["v_gene", "j_gene", "seq"], "seq", "_g", **options).select("v_gene", "j_gene", F.col("allele").alias(f"{side}_allele"))
        chosen = out.join(best, ["v_gene", "j_gene"]).join(refs.select(F.col("allele").alias(f"{side}_allele"), F.col("ref_seq").alias("_ref")), f"{side}_allele")
        keep = [c for c in chosen.columns if c != "_ref"]
        placed = align_columns(chosen, keep, "seq", "_ref", mode="local", **options)
        out = placed.select(*keep, F.col("first_start").alias(f"{side}_start"), F.col("first_end").alias(f"{side}_end"))
    return out.withColumn("v_to_j", F.substr(F.col("seq"), F.col("v_start"), F.greatest(F.lit(0), F.col("j_end") - F.col("v_start") + 1)))
