"""Items of varying size put into containers of one capacity with as little room unused as possible."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut_lineage, pick

#: Bins that are packed together, about, and at most about how many items.
BINS = 4096
ITEMS = 65_536


def _fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item places: the largest item first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted; full bins leave the list
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(i)
        elif s == 0 and bins:
            bins[-1].append(i)
            continue
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free - s:
            insort(room, (free - s, b))
    return bins


class _Search:
    """The bins of a group that aren't full, their items as arrays, and the steps between them.

    ``given`` are what a bin may give (sizes of items or of pairs), ``wanted`` what others may give back for it: nothing, an item or a pair. Of the given ones the largest
    that fits takes a place: it is found for all others at once by bisection. A bin that found no step is asked again only about bins that changed since.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins
        self.fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        self.stamp = np.zeros(len(bins), np.int64)  # when a bin changed last
        self.asked = np.full(len(bins), -1, np.int64)  # when it found no step last
        self.now = 0  # steps so far
        self.owner = np.zeros(len(sizes), np.int64)
        for i, b in enumerate(bins):
            self.owner[b] = i
        self.collect()

    def collect(self) -> None:
        """Leave out the bins that are full or empty, and their items."""
        self.open = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0))
        self.items = np.array([x for i in self.open for x in self.bins[i] if self.sizes[x]], np.int64)
        self.pairs = None

    def some_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, bin) of all pairs of items of one bin; made anew only when bins have changed."""
        if self.pairs is None or self.pairs[0] != self.now:
            items = self.items[np.argsort(self.owner[self.items], kind="stable")]
            own = self.owner[items]
            firsts, seconds = [], []
            for step in range(1, len(items)):
                at = np.flatnonzero(own[step:] == own[:-step])
                if not len(at):
                    break
                firsts.append(items[at])
                seconds.append(items[at + step])
            first, second = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
            self.pairs = (self.now, first, second, self.owner[first])
        return self.pairs[1:]

    def best(self, d: int, given: np.ndarray, bins: np.ndarray, wanted: np.ndarray | int) -> tuple[int, int, int] | None:
        """(gain, place in given, place in bins) of the step that raises the squared fill most; ``given`` is sorted."""
        if not len(given) or not len(bins):
            return None
        room = self.capacity - self.fill[bins]
        k = np.searchsorted(given, wanted + room, "right") - 1
        more = np.where(k >= 0, given[k] - wanted, 0)
        gain = np.where(more > 0, more * (self.fill[bins] - self.fill[d] + more), 0)
        at = int(gain.argmax())
        return (int(gain[at]), int(k[at]), at) if gain[at] > 0 else None

    def step(self, d: int) -> bool:
        """Make the bin d give, if it can: an item, one for a smaller one, two for one, one for two, in this order."""
        since = -1 if self.stamp[d] > self.asked[d] else self.asked[d]
        wide = (self.fill >= self.fill[d]) & (self.fill < self.capacity) & (self.stamp > since)
        wide[d] = False
        bins = self.open[wide[self.open]]
        if len(bins):
            own = np.array([x for x in self.bins[d] if self.sizes[x]], np.int64)
            own = own[np.argsort(self.sizes[own], kind="stable")]
            singles = self.sizes[own]
            items = self.items[wide[self.owner[self.items]]]
            into, held = self.owner[items], self.sizes[items]
            one = self.best(d, singles, bins, 0)
            two = self.best(d, singles, into, held)
            if one and (not two or one[0] >= two[0]):
                return self.move(d, int(bins[one[2]]), [int(own[one[1]])], [])
            if two:
                return self.move(d, int(into[two[2]]), [int(own[two[1]])], [int(items[two[2]])])
            i, j = np.triu_indices(len(own), 1)
            sums = singles[i] + singles[j]
            order = np.argsort(sums, kind="stable")
            found = self.best(d, sums[order], into, held)
            if found:
                k = order[found[1]]
                return self.move(d, int(into[found[2]]), [int(own[i[k]]), int(own[j[k]])], [int(items[found[2]])])
            first, second, into = self.some_pairs()
            use = wide[into]
            first, second, into = first[use], second[use], into[use]
            found = self.best(d, singles, into, self.sizes[first] + self.sizes[second])
            if found:
                return self.move(d, int(into[found[2]]), [int(own[found[1]])], [int(first[found[2]]), int(second[found[2]])])
        self.asked[d] = self.now
        return False

    def move(self, d: int, a: int, give: list[int], take: list[int]) -> bool:
        self.now += 1
        for x in give:
            self.bins[d].remove(x)
        for y in take:
            self.bins[a].remove(y)
        self.bins[a] += give
        self.bins[d] += take
        moved = int(self.sizes[give].sum() - self.sizes[take].sum())
        self.owner[give], self.owner[take] = a, d
        self.fill[a] += moved
        self.fill[d] -= moved
        self.stamp[[a, d]] = self.now
        if self.fill[d] == 0:  # items of no size, if there are any, go along
            self.bins[a] += self.bins[d]
            self.owner[self.bins[d]] = a
            self.bins[d] = []
        return True


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search on the bins that aren't full.

    The bins, the emptiest first, give to fuller ones as long as they can, over and over: an item moves, or is exchanged for a smaller one, or two for one or one for two, whichever
    step raises the sum of squared fills most. A bin that is empty goes. It ends when no bin finds a step, so that a second call changes nothing, or when
    there are no more bins than the total needs.
    """
    least = max(1, -(-int(sizes.sum()) // capacity))
    s = _Search([list(b) for b in bins if b], np.asarray(sizes, np.int64), capacity)
    count = len(s.bins)
    while count > least:
        s.collect()
        before = s.now
        for d in s.open[np.argsort(s.fill[s.open], kind="stable")].tolist():
            while 0 < s.fill[d] < capacity and count > least and s.asked[d] < s.now and s.step(d):
                count -= int(s.fill[d] == 0)
        if s.now == before:  # all were asked and none found a step
            break
    return [b for b in s.bins if b]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; no size exceeds the capacity."""
    bins = improve(_fill(sizes, capacity), sizes, capacity)
    out = np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def pack_items(df: DataFrame, item: str, size: str, capacity: int, bins: int = BINS, items: int = ITEMS) -> DataFrame:
    """Rows (item, part_no, size_start, size, bin_id): each item's place in bins of the capacity.

    An item is split only if it alone exceeds the capacity: into parts of the capacity and a rest, numbered from 0; size_start is where a
    part begins in its item. A null or negative size counts as 0; items without size have their row, in some bin. Repeated rows are items of their
    own, a null item is kept, an empty table gives no rows.

    Items are spread by a hash of their row into groups that need about ``bins`` bins (fewer where these would hold more than ``items`` items), however they are keyed;
    each group is packed in one task by best fit and local search and leaves at most a few bins that aren't full, a share of 1 / (bins of a group). Only sizes are
    shuffled. The sizes are computed, and counted, when this is called.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rows = pick(df, item=item, size=size).select("item", F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    rows = cut_lineage(rows)  # sizes are dear, and the number of rows is needed first
    id_type = rows.schema["item"].dataType.simpleString()
    c = F.lit(capacity).cast("bigint")
    last = F.greatest(F.ceil(F.col("size") / c).cast("bigint") - 1, F.lit(0))
    rows = rows.select("item", "size", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part_no"))
    rows = rows.select("item", "part_no", (F.col("part_no") * c).alias("size_start"), F.least(c, F.col("size") - F.col("part_no") * c).alias("size"), "row")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = max(1, -(-n // items), -(-total // (capacity * bins)))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("row", "part_no"), F.lit(groups)))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("part_no", "ascending")])
        bins = rows.column("grp").to_numpy() * (1 << 24) + pack(rows.column("size").to_numpy(), capacity)
        return rows.select(["item", "part_no", "size_start", "size"]).append_column("bin_id", pa.array(bins))

    packed = rows.groupBy("grp").applyInArrow(one, f"item {id_type}, part_no bigint, size_start bigint, size bigint, bin_id bigint")
    return packed.select(F.col("item").alias(item), "part_no", "size_start", F.col("size").alias(size), "bin_id")
