"""Filling containers of a fixed capacity with whole items.

Items are spread over groups of bounded size by a hash, each group is packed by
best fit, largest first, and then improved by local search: documents move, or are
exchanged one for one or two for one, between underfull bins as long as the sum of
squared fills grows, until bins empty. What lies in bins that stay underfull goes into
the next round with far fewer groups, down to a single one, so that only the last
group's last bins have room. A round that seals under ``LEAST_SEALED`` of its items (they
fit each other badly in any group) is the last one, and its bins stay as they are. An item over the capacity fills containers by itself; its
rest is an item like any other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.session import materialize

CAPACITY = 8_192
GROUP_ITEMS = 20_000
FULL = 0.995
LEAST_SEALED = 0.1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions of ``sizes``: each item, largest first, goes where it leaves least room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
            insort(rooms, (room - sizes[i], b))
    return bins


class _Offers:
    """The sums that bins can give away, each with its bins, emptiest first; one index for single items, one for pairs."""

    def __init__(self) -> None:
        self.sums: list[int] = []
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, value: int, fill: int, b: int) -> None:
        if value not in self.bins:
            insort(self.sums, value)
            self.bins[value] = []
        insort(self.bins[value], (fill, b))

    def remove(self, value: int, fill: int, b: int) -> None:
        held = self.bins[value]
        del held[bisect_left(held, (fill, b))]
        if not held:
            del self.bins[value], self.sums[bisect_left(self.sums, value)]

    def best(self, low: int, high: int, fill: int, b: int) -> tuple[int, int] | None:
        """The largest sum over ``low`` and up to ``high`` of another bin not fuller than ``fill``, and that bin."""
        for at in range(bisect_right(self.sums, high) - 1, -1, -1):
            value = self.sums[at]
            if value <= low:
                return None
            for its_fill, source in self.bins[value][:2]:
                if source != b and its_fill <= fill:
                    return value, source
        return None


def _sums(items: list[int], sizes: list[int]) -> tuple[set[int], set[int]]:
    """The sizes of a bin's items, and the sums of two of them."""
    times = Counter(sizes[i] for i in items)
    twice = {2 * v for v, n in times.items() if n > 1}
    return set(times), twice | {v + w for v, w in combinations(times, 2)}


def _pick(items: list[int], total: int, count: int, sizes: list[int]) -> list[int]:
    """``count`` (at most two) items of a bin with this total size."""
    if count < 2:
        return [next(i for i in items if sizes[i] == total)] if count else []
    at: dict[int, int] = {}
    for i in items:
        if total - sizes[i] in at:
            return [at[total - sizes[i]], i]
        at[sizes[i]] = i
    raise ValueError(total)


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins after exchanges between all underfull ones, without those that became empty."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    if len(bins) <= least:
        return bins
    active = [b for b in range(len(bins)) if fill[b] < capacity]
    sums = {b: _sums(bins[b], sizes) for b in active}
    offers = _Offers(), _Offers()

    def index(b: int, change: str) -> None:
        for offered, values in zip(offers, sums[b]):
            for value in values:
                getattr(offered, change)(value, fill[b], b)

    for b in active:
        index(b, "add")
    left, grown = len(bins), True
    while grown and left > least:
        grown = False
        active = sorted((b for b in active if bins[b]), key=lambda b: -fill[b])
        for t in active:
            if not bins[t] or fill[t] == capacity:
                continue
            room, best = capacity - fill[t], (0, 0, 0, 0, 0, 0)
            one, two = sums[t]
            for n_give, n_take, takes in ((1, 0, (0,)), (1, 1, one), (2, 0, (0,)), (2, 1, one), (1, 2, two)):
                for take in takes if best[0] < room else ():
                    found = offers[n_give - 1].best(take + best[0], take + room, fill[t], t)
                    if found is not None:
                        best = (found[0] - take, found[1], found[0], n_give, take, n_take)
            gain, s, give, n_give, take, n_take = best
            if gain:
                gives, takes = _pick(bins[s], give, n_give, sizes), _pick(bins[t], take, n_take, sizes)
                index(t, "remove")
                index(s, "remove")
                bins[t] = [i for i in bins[t] if i not in takes] + gives
                bins[s] = [i for i in bins[s] if i not in gives] + takes
                fill[t] += gain
                fill[s] -= gain
                for b in (t, s):
                    sums[b] = _sums(bins[b], sizes) if fill[b] < capacity else (set(), set())
                    index(b, "add")
                left -= not bins[s]
                grown = True
    return [b for b in bins if b]


def _pack_group(capacity: int, round_no: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_item", "_piece"], kind="stable").reset_index(drop=True)
        sizes = frame["_size"].tolist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        place, sealed = [-1] * len(sizes), [False] * len(sizes)
        for n, b in enumerate(bins):
            full = sum(sizes[i] for i in b) >= FULL * capacity
            for i in b:
                place[i], sealed[i] = n, full
        name = f"r{round_no}-" + frame["_group"].astype(str) + "-" + pd.Series(place, index=frame.index).astype(str)
        return frame.assign(container=name, _sealed=sealed)[["_item", "_piece", "_size", "container", "_sealed"]]

    return run


def pack(df: DataFrame, item: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Rows ``(item, piece, tokens, container)``: every item in a container, whole if it fits one.

    Items must be unique in ``df``. A null or zero size is an item without content: it
    is in no container (null). An item over the capacity has the pieces 0, 1, ... of at
    most the capacity. Other columns of ``df`` are not read. An empty table gives none.
    """
    base = df.select(F.col(item).alias("_item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size"))
    whole = F.floor(F.col("_size") / capacity).cast("int")
    rest = (F.col("_size") % capacity).cast("bigint")
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / capacity).cast("int"), F.lit(1)) - 1),
        lambda n: F.struct(n.alias("_piece"), F.when(n < whole, F.lit(capacity).cast("bigint")).otherwise(rest).alias("_size")),
    )
    pieces = materialize(base.select("_item", F.inline(parts)))
    shape = "_item {}, _piece int, _size bigint, container string, _sealed boolean".format(dict(pieces.dtypes)["_item"])

    alone = pieces.where((F.col("_size") == capacity) | (F.col("_size") == 0)).withColumn(
        "container",
        F.when(F.col("_size") > 0, F.concat_ws("-", F.lit("full"), F.col("_item").cast("string"), F.col("_piece").cast("string"))),
    )
    done, open_items, round_no = [alone], pieces.where((F.col("_size") > 0) & (F.col("_size") < capacity)), 0
    while True:
        count = open_items.count()
        groups = max(1, -(-count // group_items))
        spread = F.pmod(F.xxhash64("_item", "_piece", F.lit(round_no)), F.lit(groups)).cast("int")
        packed = open_items.withColumn("_group", spread).groupBy("_group").applyInPandas(
            _pack_group(capacity, round_no), shape
        )
        if groups == 1:
            done.append(packed.drop("_sealed"))
            break
        packed = materialize(packed)
        if packed.where("_sealed").count() < LEAST_SEALED * count:  # another spread would change little, perhaps nothing
            done.append(packed.drop("_sealed"))
            break
        done.append(packed.where("_sealed").drop("_sealed"))
        open_items, round_no = packed.where("not _sealed").drop("container", "_sealed"), round_no + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(F.col("_item").alias(item), F.col("_piece").alias("piece"), F.col("_size").alias("tokens"), "container")
