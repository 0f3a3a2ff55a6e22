"""p6: the N best items of every group, by secondary sort and streaming.

Rows of a partition are sorted by group, score and id, and streamed in Arrow batches; of each group the first N distinct
ids pass, nothing is buffered. This happens twice: where the rows are read, before any shuffle, which leaves at
most N rows a group and input partition however hot the group is, and again after a hash partitioning by group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """True where a row differs from the one before it in one of ``names`` (nulls are equal)."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in names:
        column = batch.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        out |= differ | (nulls[1:] != nulls[:-1])
    return out


def _first(group: Sequence[str], item: Sequence[str], n: int):
    """mapInArrow body over sorted rows: the first ``n`` distinct items of each group. Kept between batches: the last row and its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:  # the last row of the batch before comes in front, to be compared with
                both = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            else:
                both = batch
            new_group, new_item = _changes(both, group), _changes(both, [*group, *item])
            if last is None:
                new_group, new_item = np.r_[True, new_group], np.r_[True, new_item]
            # rank of each distinct item within its group, going on from the last batch
            steps = np.cumsum(new_item)
            at = np.where(new_group, steps - 1, 0)
            base = np.maximum.accumulate(at)
            started = np.maximum.accumulate(new_group)
            ranks = np.where(started, steps - base, steps + rank)
            keep = new_item & (ranks <= n)
            last, rank = batch.slice(batch.num_rows - 1), int(ranks[-1])
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: Sequence[str], score: str, item: str, n: int, *, carry: Sequence[str] = ()) -> DataFrame:
    """``group``, ``score``, ``item`` and ``carry`` columns of the ``n`` items of highest score in each group; equal scores by smaller item.

    Null scores and null items take no part; a null in a group column is a value of its own; copies of rows count once; an
    item with several scores counts with each of them. Groups with fewer items are given whole; an empty table gives no rows.
    """
    columns = list(dict.fromkeys([*group, score, item, *carry]))
    rows = df.select(*columns).where(F.col(score).isNotNull() & F.col(item).isNotNull())
    order = [*(F.col(g) for g in group), F.desc(score), F.asc(item)]
    step = _first(group, [score, item], n)
    local = rows.sortWithinPartitions(*order).mapInArrow(step, rows.schema)
    return local.repartition(*(F.col(g) for g in group)).sortWithinPartitions(*order).mapInArrow(step, rows.schema)
