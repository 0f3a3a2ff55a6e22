"""p1: the most similar vectors of every vector, over sharded robust-pruned graphs.

Plan
1. Unusable vectors go (null, other length, null/NaN/infinite number, all zero); repeated
   deliveries of an id count once. Equal vectors form one class; the graphs hold one node a class,
   so a vector that a third of all rows share is indexed and searched once.
2. Spherical k-means makes *lists*, several to a shard. Few lists are fitted on the driver, on a bounded sample (``SAMPLE`` classes, the smallest
   hashes); more than ``DIRECT`` in two levels, the second on the executors, each top cell on a bounded sample of its own. Centres that coincide
   or have no members go. Every class is indexed in its nearest list. Lists that lie together share a shard of about ``SHARD`` nodes; a list that is larger than
   twice that is split by hash over several.
3. Each class asks the shards of its ``PROBES`` nearest lists, without those too far for any member to reach ``floor`` (by the triangle inequality
   over angles, with the largest angle in each list, so nothing is lost by that). Its own shard it asks from within, without a copy. A shard that very many ask is
   kept several times, and each of its askers goes to one.
4. One task a shard: rows arrive with the index first, the graph is built (greedy searches
   propose, relaxed pruning keeps), then queries stream through beam searches in Arrow batches.
   Queries are never buffered.
5. Each link found is used in both directions (a pair is lost only if both searches miss it), then
   the ``k`` best of each class are ranked by cosine (64-bit, rounded to 12 digits) and id.
6. Classes turn back into ids: of a class no more than ``k + 1`` smallest ids can be neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut, spread

#: Bound of each sample that lists are fitted on, in vectors.
SAMPLE = 16384
#: Nodes in a shard, about; lists a shard; askers a shard from which it is kept several times.
SHARD, LISTS, ASKERS = 8192, 16, 131_072
#: Nearest lists whose shards a vector asks.
PROBES = 8
#: Lists that are fitted at once, and most lists (then a shard has fewer).
DIRECT, MOST = 2048, 65_536
#: Most tasks of the search; with more shards each takes several, one after the other.
TASKS = 20_000
DEGREE, BEAM, ALPHA = 24, 24, 1.2
#: Roles of a row in a shard: in the index, there and asking, asking from elsewhere.
HELD, OWN, ASKING = 0, 1, 2


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, vector)`` of each id whose vector can be compared; copies of rows count once."""
    v = F.col(vector)
    fine = (
        F.col(key).isNotNull()
        & (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    # 32-bit zeros of either sign are one value
    return (
        df.where(F.coalesce(fine, F.lit(False)))
        .select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("vector"))
        .dropDuplicates(["id"])
    )


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest value first, so that no square overflows."""
    matrix = matrix.astype(np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float64)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of a spherical k-means, at most ``cells``: each has members in the sample, and no two are the same direction."""
    _, first = np.unique(sample.round(6), axis=0, return_index=True)
    centres = sample[np.sort(first)[:cells]].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        length = np.linalg.norm(total, axis=1)
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    _, first = np.unique(centres.round(6), axis=0, return_index=True)
    centres = centres[np.sort(first)]
    return centres[np.unique(_nearest(sample, centres))]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks of rows."""
    return np.concatenate([(rows[s : s + 1024] @ centres.T).argmax(1) for s in range(0, len(rows), 1024)]) if len(rows) else np.zeros(0, int)


def fit_lists(nodes: DataFrame, n: int, lists: int, dim: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of at most ``lists`` lists, those of one top cell in a row, and the top cell of each."""
    spark = nodes.sparkSession
    taken = nodes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()
    first = unit(np.stack(taken["vector"]))
    if lists <= DIRECT:
        centres = fit_cells(first, lists)
        return centres, np.zeros(len(centres), int)
    tops = fit_cells(first, math.ceil(lists / 512))
    share = min(1.0, sample * len(tops) / n)  # about ``sample`` vectors a top cell

    def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_nearest(unit(_matrix(batch.column("vector"), dim)), tops).astype(np.int32)), batch.column("id"), batch.column("vector")], names=["top", "id", "vector"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        own = unit(np.stack(frame["vector"]))
        centres = fit_cells(own, max(1, round(lists * len(own) / (share * n))))
        return pd.DataFrame({"top": frame["top"].iloc[0], "centre": list(centres)})

    few = nodes.select("id", "vector").where(F.pmod(F.xxhash64(F.lit("lists"), "id"), F.lit(1_000_000)) < share * 1_000_000).mapInArrow(into, "top int, id long, vector array<float>")
    place = Window.partitionBy("top").orderBy(F.xxhash64("id"), "id")
    few = few.withColumn("place", F.row_number().over(place)).where(F.col("place") <= 4 * sample).drop("place")
    found = few.groupBy("top").applyInPandas(fit, "top int, centre array<double>").orderBy("top").toPandas()
    return np.stack(found["centre"]), np.unique(found["top"], return_inverse=True)[1]


@dataclass(frozen=True)
class Router:
    """The lists a vector is near to. ``top`` tells the top cell of each list (all 0: every list is looked at)."""

    centres: np.ndarray
    top: np.ndarray

    def best(self, rows: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """``(lists, cosines)`` of the ``probes`` nearest lists of each row, best first; -1 where there are no more."""
        parts = [self._block(rows[s : s + 1024], probes) for s in range(0, len(rows), 1024)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def _block(self, rows: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, self.top[1:] != self.top[:-1]])
        ends = np.r_[starts[1:], len(self.top)]
        ids, best = np.full((len(rows), probes), -1), np.full((len(rows), probes), -2.0)
        if len(starts) > 1:
            middle = unit(np.add.reduceat(self.centres, starts))
            use = np.argsort(-(rows @ middle.T), axis=1)[:, :8]
        else:
            use = np.zeros((len(rows), 1), int)
        for t in np.unique(use):
            at = np.flatnonzero((use == t).any(1))
            score = rows[at] @ self.centres[starts[t] : ends[t]].T
            both = np.concatenate([best[at], score], 1)
            names = np.concatenate([ids[at], np.broadcast_to(np.arange(starts[t], ends[t]), score.shape)], 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            ids[at], best[at] = np.take_along_axis(names, order, 1), np.take_along_axis(both, order, 1)
        return ids, best


def group_lists(centres: np.ndarray, sizes: np.ndarray, shard: int) -> np.ndarray:
    """The shard of each list: sets of lists are halved along their widest direction until each has about ``shard`` nodes."""
    out, todo, number = np.zeros(len(centres), int), [np.arange(len(centres))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or sizes[own].sum() <= 1.25 * shard:
            out[own] = number
            number += 1
            continue
        spread_out = centres[own] - centres[own].mean(0)
        axis = np.linalg.svd(spread_out[:4096], full_matrices=False)[2][0]
        order = own[np.argsort(spread_out @ axis, kind="stable")]
        half = np.searchsorted(np.cumsum(sizes[order]), sizes[own].sum() / 2)
        half = min(max(1, int(half)), len(order) - 1)
        todo += [order[half:], order[:half]]
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search_shards(dim: int, k: int, floor: float, degree: int, beam: int, alpha: float):
    """mapInArrow body: rows sorted by (shard, role); gives (left, right, cosine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
        from quire.llm.graph import NONE, PrunedGraph

        shard, ids, rows, roles, graph = None, [], [], [], None
        own = base = np.zeros(0)

        def ask(key: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(key), 512):
                asked = unit(matrix[s : s + 512])
                found, _ = graph.search(asked.astype(np.float32), max(beam, k + 1))
                at, col = np.nonzero(found != NONE)
                to = found[at, col]
                exact = np.round(np.einsum("ij,ij->i", asked[at], base[to]), 12)
                left, right = key[s : s + 512][at], own[to]
                keep = (exact >= floor) & (left != right)
                yield pa.record_batch([pa.array(left[keep]), pa.array(right[keep]), pa.array(exact[keep])], names=["left", "right", "cosine"])

        def close() -> Iterator[pa.RecordBatch]:
            """The index is complete: it is built, and what is in it asks."""
            nonlocal own, base, graph
            own, base = np.concatenate(ids), unit(np.concatenate(rows))
            graph = PrunedGraph(base.astype(np.float32), degree, beam, alpha)
            asks = np.concatenate(roles) == OWN
            yield from ask(own[asks], base[asks])

        for batch in batches:
            shards, role, key = batch.column("shard").to_numpy(), batch.column("role").to_numpy(), batch.column("id").to_numpy()
            matrix = _matrix(batch.column("vector"), dim)
            query = role == ASKING
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shards)]):
                if hi <= lo:
                    continue
                if shards[lo] != shard:
                    if ids and graph is None:
                        yield from close()
                    shard, ids, rows, roles, graph = shards[lo], [], [], [], None
                if not query[lo]:
                    ids.append(key[lo:hi])
                    rows.append(matrix[lo:hi])
                    roles.append(role[lo:hi])
                    continue
                if not ids:
                    continue  # a list without nodes
                if graph is None:
                    yield from close()
                yield from ask(key[lo:hi], matrix[lo:hi])
        if ids and graph is None:
            yield from close()

    return run


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "vector", *, dim: int = 64, k: int = 5, floor: float = 0.85, shard: int = SHARD, probes: int = PROBES, sample: int = SAMPLE, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, askers: int = ASKERS) -> DataFrame:
    """``(id, neighbour, cosine)``: of each usable vector, the at most ``k`` others of highest cosine
    among those with cosine >= ``floor`` that the graph search finds; equal cosines (to 12 digits): smaller id first.

    Nulls, NaN, other lengths and zero vectors have no neighbours and are nobody's; an id that comes
    with several vectors keeps one of them; an empty table gives no rows. Other columns are ignored.
    """
    base = cut(usable(df, key, vector, dim))
    nodes = cut(base.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n = nodes.count()
    wanted = math.ceil(n / shard)
    if wanted > 1:
        router = Router(*fit_lists(nodes, n, min(LISTS * wanted, max(wanted, MOST)), dim, sample))
    else:
        router = Router(np.ones((1, dim)) / math.sqrt(dim), np.zeros(1, int))
    probes = min(probes, len(router.centres))
    rows = spread(nodes.select("id", "vector"), "id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch and list: how many nodes lie in it and how far out, how many ask it."""
        for batch in batches:
            if not batch.num_rows:
                continue
            near, score = router.best(unit(_matrix(batch.column("vector"), dim)), probes)
            lists, asks = np.unique(near[near >= 0], return_counts=True)
            held = np.bincount(near[:, 0], minlength=len(router.centres))[lists]
            least = np.full(len(router.centres), 1.0)
            np.minimum.at(least, near[:, 0], score[:, 0])
            yield pa.record_batch([pa.array(lists), pa.array(held.astype(np.int64)), pa.array(asks.astype(np.int64)), pa.array(least[lists])], names=["list", "held", "asks", "least"])

    sizes, asks, least = np.zeros(len(router.centres), np.int64), np.zeros(len(router.centres), np.int64), np.ones(len(router.centres))
    if wanted > 1:
        for r in rows.mapInArrow(measured, "list long, held long, asks long, least double").groupBy("list").agg(F.sum("held").alias("held"), F.sum("asks").alias("asks"), F.min("least").alias("least")).collect():
            sizes[r["list"]], asks[r["list"]], least[r["list"]] = r["held"], r["asks"], r["least"]
    else:
        sizes[:], asks[:] = n, n
    # shards: lists that lie together; a list that is too large for one is split over several
    of_list = group_lists(router.centres, sizes, shard)
    held, asked = np.bincount(of_list, weights=sizes), np.bincount(of_list, weights=asks)
    pieces = np.where(held > 2 * shard, np.ceil(held / shard), 1).astype(int)
    kept = np.maximum(1, np.ceil(asked / askers)).astype(int)
    starts = np.concatenate([[0], np.cumsum(pieces * kept)])
    total = int(starts[-1])
    # beyond this angle no member of a list can be as near as ``floor``
    reach = np.cos(np.minimum(np.pi, np.arccos(np.clip(least, -1, 1)) + math.acos(floor) + 1e-3)) if -1 < floor < 1 and wanted > 1 else np.full(len(least), -2.0)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node as rows of shards: held in all copies of its own, asking in one copy of each other (by a mixed id)."""
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                ids = batch.column("id").to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                near, score = router.best(unit(_matrix(batch.column("vector"), dim)), probes)
                home = of_list[near[:, 0]]
                mine = (mixed % pieces[home].astype(np.uint64)).astype(int)
                line, shards, roles = [], [], []
                for c in range(kept[home].max()):  # the index, in each copy
                    at = np.flatnonzero(kept[home] > c)
                    line.append(at)
                    shards.append(starts[home[at]] + mine[at] * kept[home[at]] + c)
                    roles.append(np.where((mixed[at] >> np.uint64(7)) % kept[home[at]].astype(np.uint64) == c, OWN, HELD))
                use = (near >= 0) & (score >= reach[near])
                use[:, 0] = True
                row, col = np.nonzero(use)
                pairs = np.unique(np.stack([row, of_list[near[row, col]]], 1), axis=0)  # each shard once
                for piece in range(pieces[pairs[:, 1]].max()):
                    at = pairs[(pieces[pairs[:, 1]] > piece) & ~((pairs[:, 1] == home[pairs[:, 0]]) & (mine[pairs[:, 0]] == piece))]
                    line.append(at[:, 0])
                    shards.append(starts[at[:, 1]] + piece * kept[at[:, 1]] + ((mixed[at[:, 0]] >> np.uint64(7)) % kept[at[:, 1]].astype(np.uint64)).astype(int))
                    roles.append(np.full(len(at), ASKING))
                taken = batch.take(pa.array(np.concatenate(line)))
                yield pa.record_batch([pa.array(np.concatenate(shards).astype(np.int32)), pa.array(np.concatenate(roles).astype(np.int32)), taken.column("id"), taken.column("vector")], names=["shard", "role", "id", "vector"])

    links = (
        rows.mapInArrow(routed, "shard int, role int, id long, vector array<float>")
        .repartitionById(min(total, TASKS), F.pmod("shard", F.lit(min(total, TASKS))))
        .sortWithinPartitions("shard", "role", "id")
        .mapInArrow(_search_shards(dim, k, floor, degree, beam, alpha), "left long, right long, cosine double")
    )
    both = cut(links)
    both = both.union(both.select("right", "left", "cosine")).groupBy("left", "right").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("left").orderBy(F.desc("cosine"), F.asc("right"))
    both = both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    return _members(base, nodes, both, k)


def _members(base: DataFrame, nodes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Links of classes as links of ids. Only the ``k + 1`` smallest ids of a class can be among the
    ``k`` best of anything, so no class is ever gathered whole."""
    shared = nodes.where("n > 1").select("vector", F.col("id").alias("class"))
    copies = base.join(shared, "vector").select("class", "id")
    by_id = Window.partitionBy("class").orderBy("id")
    few = copies.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    other = (
        links.join(few.withColumnRenamed("class", "right"), "right", "left")
        .select(F.col("left").alias("class"), F.explode(F.coalesce("ids", F.array("right"))).alias("neighbour"), "cosine")
    )
    first = Window.partitionBy("class").orderBy(F.desc("cosine"), F.asc("neighbour"))
    other = other.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
    member = nodes.where("n = 1").select(F.col("id").alias("class"), "id").union(copies)
    found = member.join(other, "class").select("id", "neighbour", "cosine")
    within = copies.join(few, "class").select("id", F.explode("ids").alias("neighbour")).where("id <> neighbour").withColumn("cosine", F.lit(1.0))
    place = Window.partitionBy("id").orderBy(F.desc("cosine"), F.asc("neighbour"))
    return found.union(within).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")


def pairs(neighbours: DataFrame) -> DataFrame:
    """Each unordered pair of which at least one is a neighbour of the other, once."""
    return neighbours.select(F.least("id", "neighbour").alias("left_id"), F.greatest("id", "neighbour").alias("right_id")).distinct()
