"""The most frequent values of a column and about how often each occurs, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import pick

BUCKETS = 16
#: Counters of evicted counts per bucket.
LIGHT = 1024
#: Rows that are counted together before they meet the buckets.
ROWS = 200_000
#: Candidates that may be broadcast (16 bytes each).
MOST_BROADCAST = 200_000
#: Groups of partitions that are merged before the last merge.
GROUPS = 64

_STATE = "bucket int, n bigint, keys array<string>, counts array<bigint>, votes array<bigint>, light array<bigint>"


@dataclass
class Bucket:
    """Values with the exact count since they came in, their votes, and one counter array of the counts evicted so far."""

    n: int
    keys: np.ndarray
    counts: np.ndarray
    votes: np.ndarray
    light: np.ndarray

    @staticmethod
    def empty() -> Bucket:
        return Bucket(0, np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(LIGHT, np.int64))

    def add(self, other: Bucket, slots: int) -> None:
        """Take over another bucket's values and counters; keep ``slots`` values.

        Where more remain, each pays as many votes as the first one too many has; who has none left is evicted and its count goes
        to the counter array. So a value loses at most n / (slots + 1) votes, and one that occurs more often stays.
        """
        self.n += other.n
        self.light = self.light + other.light
        both = np.concatenate([self.keys, other.keys])
        code, keys = pd.factorize(both)
        counts = np.bincount(code, np.concatenate([self.counts, other.counts]).astype(np.float64), len(keys)).astype(np.int64)
        votes = np.bincount(code, np.concatenate([self.votes, other.votes]).astype(np.float64), len(keys)).astype(np.int64)
        if len(keys) > slots:
            votes = votes - np.partition(votes, len(votes) - slots - 1)[len(votes) - slots - 1]
            stays = votes > 0
            np.add.at(self.light, _light_place(keys[~stays]), counts[~stays])
            keys, counts, votes = keys[stays], counts[stays], votes[stays]
        self.keys, self.counts, self.votes = keys, counts, votes


def _hash(keys: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(keys, categorize=False) if len(keys) else np.zeros(0, np.uint64)


def _light_place(keys: np.ndarray) -> np.ndarray:
    return ((_hash(keys) >> np.uint64(16)) % np.uint64(LIGHT)).astype(np.int64)


def _rows(state: dict[int, Bucket]) -> pa.RecordBatch:
    items = sorted(state.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _ in items], pa.int32()), pa.array([x.n for _, x in items], pa.int64()),
            pa.array([x.keys.tolist() for _, x in items], pa.list_(pa.string())),
            *[pa.array([getattr(x, f).tolist() for _, x in items], pa.list_(pa.int64())) for f in ("counts", "votes", "light")],
        ],
        ["bucket", "n", "keys", "counts", "votes", "light"],
    )


def sketch(values: DataFrame, slots: int) -> DataFrame:
    """One row per bucket of the only column of ``values`` (strings, no nulls): see ``Bucket``.

    Each task counts its rows in blocks and adds them to its buckets; the buckets of all tasks are recombined one by one, first in
    groups of tasks, then over all. Whatever the number of rows and distinct values, a task holds ``BUCKETS`` x ``slots`` values and a
    shuffled row one bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state: dict[int, Bucket] = {}
        held: list[pa.Array] = []

        def flush() -> None:
            found = pc.value_counts(pa.chunked_array(held))
            keys = found.field("values").to_numpy(zero_copy_only=False)
            counts = found.field("counts").to_numpy().astype(np.int64)
            home = (_hash(keys) % np.uint64(BUCKETS)).astype(np.int64)
            for b in np.unique(home):
                own = home == b
                state.setdefault(int(b), Bucket.empty()).add(Bucket(int(counts[own].sum()), keys[own], counts[own], counts[own], np.zeros(LIGHT, np.int64)), slots)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0))
            if sum(map(len, held)) >= ROWS:
                flush()
        if held:
            flush()
        if state:
            out = _rows(state)
            group = TaskContext.get().partitionId() % GROUPS
            yield out.append_column("grp", pa.array([group] * out.num_rows, pa.int32()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Bucket] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                b, n, keys, counts, votes, light = (batch.column(c)[i] for c in range(6))
                other = Bucket(n.as_py(), keys.values.to_numpy(zero_copy_only=False).astype(object), *[x.values.to_numpy(zero_copy_only=False) for x in (counts, votes, light)])
                state.setdefault(b.as_py(), Bucket.empty()).add(other, slots)
        if state:
            yield _rows(state)

    parts = values.mapInArrow(count, f"{_STATE}, grp int")
    grouped = parts.repartition("bucket", "grp").drop("grp").mapInArrow(merge, _STATE)
    return grouped.repartition("bucket").mapInArrow(merge, _STATE)


def _slots(share: Decimal) -> int:
    """So many that a value with the share can't be voted out, even if all values fall into one bucket."""
    return int(1 / share) + 56


def heavy_candidates(df: DataFrame, column: str, share: str = "0.005") -> DataFrame:
    """Rows (value, at_least, at_most, n_all): every value that may hold ``share`` of the n_all rows, and bounds of its count.

    Null and empty values are neither counted nor returned. No value that holds the share is missing. at_least is exact for
    the time the value was in its bucket, at_most adds the counter its evicted counts went to.
    """
    part = Decimal(share)
    values = pick(df, value=column).where("value is not null and value <> ''").select(F.col("value").cast("string"))
    merged = sketch(values, _slots(part)).withColumn("n_all", F.sum("n").over(Window.partitionBy()))  # BUCKETS rows

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                counts = batch.column("counts")[i].values.to_numpy(zero_copy_only=False)
                light = batch.column("light")[i].values.to_numpy(zero_copy_only=False)
                n_all = batch.column("n_all")[i].as_py()
                most = counts + light[_light_place(keys.to_numpy(zero_copy_only=False).astype(object))]
                may = np.array([Decimal(int(m)) >= part * n_all for m in most], bool)
                at = pa.array(np.flatnonzero(may))
                yield pa.RecordBatch.from_arrays([keys.take(at), pa.array(counts[may]), pa.array(most[may]), pa.array(np.full(int(may.sum()), n_all, np.int64))], ["value", "at_least", "at_most", "n_all"])

    return merged.mapInArrow(entries, "value string, at_least bigint, at_most bigint, n_all bigint")


def heavy_hitters(df: DataFrame, column: str, share: str = "0.005") -> DataFrame:
    """Rows (value, n_rows, n_all): each value that at least ``share`` of the rows with a value hold, with its exact count.

    Null and empty values don't count; values are compared exactly; repeated rows count each; ties at the share are in; an empty
    table gives no rows. A second scan counts the rows of the candidates. These are at most ``BUCKETS`` x slots, whatever the input: about 4,000 at 0.5 percent. Their 64-bit hashes are
    broadcast if the share makes them no more than ``MOST_BROADCAST``, else Catalyst chooses the join; a value that merely shares a hash falls out by its own count.
    """
    found = heavy_candidates(df, column, share).groupBy(F.xxhash64("value").alias("h")).agg(F.max("n_all").alias("n_all"))
    rows = pick(df, value=column).where("value is not null and value <> ''").select(F.col("value").cast("string"))
    rows = rows.withColumn("h", F.xxhash64("value")).join(F.broadcast(found) if BUCKETS * _slots(Decimal(share)) <= MOST_BROADCAST else found, "h")
    counted = rows.groupBy("value").agg(F.count("*").alias("n_rows"), F.max("n_all").alias("n_all"))
    return counted.where(F.col("n_rows") >= F.lit(Decimal(share)) * F.col("n_all"))
