"""p9: items of varying length into containers of fixed capacity, by sum-of-squares online packing.

Items arrive in the order of a hash. The state is an array with the number of open containers at each fill level; an item goes to
the level where the sum of squares of that array grows least (a new container counts as level 0; ties: the fullest level).
Keeping all levels about equally populated keeps a partner at hand for every size, so little space stays unused.

The corpus is cut by hash into parts of about ``PART`` items, each packed by itself. What a part leaves open in the end is closed up by
merging whole containers that fit together, fullest first, so items never move apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

PART = 50_000


class SumOfSquares:
    """Online packing; ``place`` gives the number of the container an item goes to."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)  # open containers by fill; 0 and capacity stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """``size`` from 1 to the capacity."""
        c, level = self.capacity, self.level
        if size == c:
            self.fill.append(c)
            return len(self.fill) - 1
        have, then = level[1 : c - size + 1], level[size + 1 :]
        # growth / 2, rounded: moving one container from level h to h + size; a full one leaves the array
        grows = 2 * (then - have) + 2
        grows[-1] = 1 - 2 * have[-1]
        grows[have == 0] = np.iinfo(np.int64).max
        at = len(grows) - 1 - int(grows[::-1].argmin())
        if grows[at] <= 2 * level[size] + 1:
            h = at + 1
            number = self.open[h].pop()
            level[h] -= 1
        else:
            h, number = 0, len(self.fill)
            self.fill.append(0)
        h += size
        self.fill[number] = h
        if h < c:
            level[h] += 1
            self.open[h].append(number)
        return number

    def close(self) -> list[int]:
        """For each container, the one it is merged into: open containers, fullest first, go whole into the fullest one with room."""
        to = list(range(len(self.fill)))
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]  # by fill, of those already closed up
        used = np.zeros(self.capacity + 1, bool)
        for h in range(self.capacity - 1, 0, -1):
            for number in self.open[h]:
                fits = np.flatnonzero(used[: self.capacity - h + 1])
                if len(fits):
                    f = int(fits[-1])
                    into = room[f].pop()
                    used[f] = bool(room[f])
                else:
                    f, into = 0, number
                to[number] = into
                if f + h < self.capacity:
                    room[f + h].append(into)
                    used[f + h] = True
        return to


def pack(df: DataFrame, key: str, size: str, capacity: int, *, part: int = PART) -> DataFrame:
    """``(key, piece int, container long, position int, size int)`` of every item: where each of its pieces lies.

    An item longer than ``capacity`` is cut into full containers and one rest; no other item is split. Items of size 0 (and null
    sizes) take no room: one row with a null container. Rows that repeat an item are packed as often as they come. No container holds more than ``capacity``.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = cut(df.select(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")).withColumn("h", F.xxhash64(key)))
    parts = max(1, math.ceil(items.count() / part))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = SumOfSquares(capacity)
        keys, pieces, places, sizes = [], [], [], []
        number = 0
        for batch in batches:
            number = batch.column("part")[0].as_py() if batch.num_rows else number
            for k, whole in zip(batch.column(key).to_pylist(), batch.column("size").to_pylist()):
                left, piece = whole, 0
                while left > 0 or piece == 0:
                    now = min(left, capacity)
                    keys.append(k)
                    pieces.append(piece)
                    places.append(state.place(now) if now > 0 else -1)
                    sizes.append(now)
                    left, piece = left - now, piece + 1
        to = np.array([*state.close(), -1])
        place = to[np.array(places, np.int64)] if places else np.zeros(0, np.int64)
        _, dense = np.unique(place[place >= 0], return_inverse=True)
        size_of, inside = np.array(sizes, np.int64), place >= 0
        container = np.full(len(place), -1, np.int64)
        container[inside] = dense
        # position: what lies before it in its container, in order of arrival
        order = np.argsort(container, kind="stable")
        total = np.cumsum(size_of[order]) - size_of[order]
        head = np.r_[True, container[order][1:] != container[order][:-1]] if len(order) else np.zeros(0, bool)
        position = np.empty(len(place), np.int64)
        if len(order):
            position[order] = total - np.maximum.accumulate(np.where(head, total, 0))
        ident = (np.int64(number) << 32) + container
        for s in range(0, len(place), 50_000):
            e = slice(s, s + 50_000)
            yield pa.record_batch(
                [
                    pa.array(keys[e], batch_type),
                    pa.array(pieces[e], pa.int32()),
                    pa.array(ident[e], mask=~inside[e]),
                    pa.array(position[e], pa.int32(), mask=~inside[e]),
                    pa.array(size_of[e], pa.int32()),
                ],
                names=[key, "piece", "container", "position", "size"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(df.schema[key].dataType)
    return (
        items.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("h", key)
        .mapInArrow(run, f"`{key}` {kind}, piece int, container long, position int, size int")
    )
