"""Nearest neighbours by stable projections and kd-trees.

Vectors are projected on a few Gaussian directions. The square of a projected distance over the
square of the true one then follows a chi-square law, whatever the vectors. A kd-tree over the
projections hands out a query's projected neighbours from near to far; each is verified on the
original vectors, until a vector that is nearer than the k-th best one found would almost surely
have been handed out.

The upper part of the tree cuts the table into shards, the lower part is built in each. A query
first searches the shard it lies in; what it finds there bounds which others it goes to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, saved, spread, width

#: Directions, seed of the directions, and the probability with which a neighbour must have been seen.
DIRECTIONS, SEED, SURE = 8, 4, 0.985
#: Vectors of a shard and points of a leaf in it; queries by copies of one vector that are answered together.
SHARD, LEAF, TOGETHER = 32_768, 64, 4096
#: Shards there are at least, so that a small table still spreads, and vectors to which the upper tree is fitted.
LEAST_SHARDS, SAMPLE = 16, 1 << 17


def chi_square(x: float, directions: int = DIRECTIONS) -> float:
    """The distribution function for an even number of directions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(directions // 2))


def bound(sure: float = SURE) -> float:
    """The ratio of squares that a projected neighbour stays below with probability `sure`."""
    low, high = 0.0, 200.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < sure else (low, middle)
    return high


def directions(size: int) -> np.ndarray:
    """The directions for vectors of so many components."""
    return np.random.default_rng(SEED).standard_normal((size, DIRECTIONS))


class Cuts:
    """The upper part of the tree, fitted to a sample of projections: it parts all space into cells, of about equally many points."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, child below the cut, child from it on; -1 - cell for a cell
        self.low, self.high = [], []
        edge = np.full(DIRECTIONS, math.inf)
        self.root = self._grow(sample, cells, -edge, edge)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, own: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        reach = np.ptp(own, axis=0) if len(own) else np.zeros(DIRECTIONS)
        axis = int(np.argmax(reach))
        if cells < 2 or reach[axis] == 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        values = np.sort(own[:, axis])
        cut = values[len(values) * (cells // 2) // cells]
        if cut == values[0]:
            cut = values[np.searchsorted(values, cut, "right")]
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        left = own[:, axis] < cut
        at = len(self.nodes)
        self.nodes.append((axis, float(cut), 0, 0))
        self.nodes[at] = (axis, float(cut), self._grow(own[left], cells // 2, low, below), self._grow(own[~left], cells - cells // 2, above, high))
        return at

    def cell(self, projected: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(projected), np.int32)
        stack = [(self.root, np.arange(len(projected)))]
        while stack:
            node, own = stack.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                axis, cut, below, above = self.nodes[node]
                left = projected[own, axis] < cut
                stack += [(below, own[left]), (above, own[~left])]
        return out

    def gaps(self, at: np.ndarray) -> np.ndarray:
        """The square of a point's distance to each cell."""
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        return (gap * gap).sum(axis=1)


class Tree:
    """A kd-tree over projections: points in order of leaves, and the box of each leaf."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.directions = directions(vectors.shape[1])
        self.projected = vectors @ self.directions
        leaves, stack = [], [np.arange(len(vectors))]
        while stack:
            own = stack.pop()
            spread = np.ptp(self.projected[own], axis=0)
            axis = int(np.argmax(spread))
            if len(own) <= LEAF or spread[axis] == 0:
                leaves.append(own)
                continue
            half = len(own) // 2
            order = np.argpartition(self.projected[own, axis], half)
            stack += [own[order[half:]], own[order[:half]]]
        self.order = np.concatenate(leaves)
        self.ends = np.cumsum([len(own) for own in leaves])
        self.low = np.array([self.projected[own].min(axis=0) for own in leaves])
        self.high = np.array([self.projected[own].max(axis=0) for own in leaves])
        self.vectors = vectors[self.order]
        self.projected = self.projected[self.order]

    def near(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Points from near to far in projection: (indices into order, square below which all were handed out)."""
        at = query @ self.directions
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        box = (gap * gap).sum(axis=1)
        leaves = np.argsort(box, kind="stable")
        starts = self.ends - np.diff(self.ends, prepend=0)
        waiting, far = np.zeros(0, np.int64), np.zeros(0)
        k, step = 0, 4
        while k < len(leaves):
            new = np.concatenate([np.arange(starts[j], self.ends[j]) for j in leaves[k : k + step]])
            k, step = k + step, step * 2
            waiting = np.concatenate((waiting, new))
            far = np.concatenate((far, ((self.projected[new] - at) ** 2).sum(axis=1)))
            safe = box[leaves[k]] if k < len(leaves) else math.inf
            ready = far <= safe
            yield waiting[ready], float(safe)
            waiting, far = waiting[~ready], far[~ready]


def search(tree: Tree, query: np.ndarray, count: np.ndarray, k: int, most: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points found, by index, and their squared distances: as many as have k ids, and none beyond `most`.

    count: the ids that each point has.
    """
    limit = bound()
    best, far = np.zeros(0, np.int64), np.zeros(0)
    for found, safe in tree.near(query):
        if len(found):
            square = ((tree.vectors[found] - query) ** 2).sum(axis=1)
            near = square <= most
            best, far = np.concatenate((best, tree.order[found[near]])), np.concatenate((far, square[near]))
            order = np.argsort(far, kind="stable")
            best, far = best[order], far[order]
            have = np.cumsum(count[best])
            if len(have) and have[-1] >= k:
                most = far[np.searchsorted(have, k)]
                best, far = best[far <= most], far[far <= most]
        if safe >= limit * most and safe > 0:
            break
    return best, far


def usable(vector: str) -> Column:
    """Not null nor empty nor zero, and all components finite."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Some rows of a list column, all of `size` numbers."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[rows][:, None] + np.arange(size)]


def projections(lists: pa.Array) -> np.ndarray:
    """Each vector on the directions for its own length."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), DIRECTIONS))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[rows] = _matrix(lists, rows, size) @ directions(size)
    return out


def _hits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, asks, a, b, v, ids, most) in order of (shard, asks), so points come before queries -> (a, b, ids, square).

    A shard's points are held, its queries stream past them.
    """
    now, points, trees = None, [], {}
    for batch in bounded(batches):
        shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (asks[1:] != asks[:-1])))
        for low, high in zip(starts, [*starts[1:], len(shard)], strict=True):
            part = batch.slice(low, high - low)
            if shard[low] != now:
                now, points, trees = shard[low], [], {}
            if not asks[low]:
                points.append(part.select(["v", "ids"]))
                continue
            lists, most = part.column("v"), part.column("most").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            names, found, far = [], [], []
            for size in np.unique(sizes):
                if size not in trees:
                    held = pa.Table.from_batches(points).combine_chunks() if points else None
                    own = np.flatnonzero(np.diff(held.column("v").chunk(0).offsets.to_numpy()) == size) if held else np.zeros(0, int)
                    ids = held.column("ids").chunk(0).take(pa.array(own)) if len(own) else None
                    trees[size] = (Tree(_matrix(held.column("v").chunk(0), own, size)), ids, np.diff(ids.offsets.to_numpy())) if len(own) else None
                if trees[size] is None:
                    continue
                tree, ids, count = trees[size]
                rows = np.flatnonzero(sizes == size)
                for row, query in zip(rows, _matrix(lists, rows, size), strict=True):
                    best, square = search(tree, query, count, k, most[row])
                    names.append(np.full(len(best), row))
                    found.append(ids.take(pa.array(best)))
                    far.append(square)
            if names:
                row = pa.array(np.concatenate(names))
                yield pa.RecordBatch.from_arrays([part.column("a").take(row), part.column("b").take(row), pa.concat_arrays(found), pa.array(np.concatenate(far))], ["a", "b", "ids", "square"])


def nearest(table: DataFrame, queries: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each row that `queries` marks: query_id, rank from 1, vec_id, score (Euclidean).

    Candidates are all rows but those with the query's own id; all of them if there are fewer than k. Vectors that are
    not usable() and rows without an id take no part; vectors are compared with those of their own length alone. A row
    that is there more than once is that often a candidate; an id that is a query more than once has one list of k, from
    all of its vectors. Ties go to smaller ids. Other columns are not read.

    Equal vectors are one point with the k + 1 smallest of their ids, and are asked once for all queries. Each point lies
    in one shard, a cell of a kd-tree fitted to about SAMPLE projections (more points than SHARD a cell: in parts by a
    hash). A query visits its own cell, and then those that the chi-square bound on what it found there leaves.
    """
    spark = table.sparkSession
    a, b = F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")
    rows = table.filter(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    copies = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).alias("m"), F.max("asks").alias("asks"))
    asking = saved(copies.filter("asks").select("id", a, b, "v"))
    first = copies.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("turn") <= k + 1)
    points = saved(first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "m"))).alias("ids"), F.max("asks").alias("asks")).select(a, b, "v", "ids"))
    n, q = points.count(), asking.count()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            flat = projections(batch.column(0)).ravel()
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), DIRECTIONS).cast(pa.list_(pa.float64()))], ["p"])

    share = min(1.0, SAMPLE / max(n, 1))
    some = points.filter(F.pmod(F.col("b"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").mapInArrow(project, "p array<double>").toArrow()
    sample = np.array(some.column("p").combine_chunks().flatten()).reshape(-1, DIRECTIONS)
    sample = sample[np.lexsort(sample.T)]
    cells = min(max(LEAST_SHARDS, -(-n // SHARD)), max(1, len(sample) // LEAF))
    cuts = spark.sparkContext.broadcast(Cuts(sample, cells))
    parts = max(1, -(-n // (SHARD * cells)))

    def route(batches: Iterator[pa.RecordBatch], *, home: bool) -> Iterator[pa.RecordBatch]:
        """home: each row to its own cell; else queries with what bounds them to the other cells."""
        tree, limit = cuts.value, bound()
        for batch in bounded(batches):
            at = projections(batch.column("v"))
            own = tree.cell(at)
            if home:
                yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], ["cell", *batch.schema.names])
                continue
            most = batch.column("most").to_numpy()
            for k, point in enumerate(at):
                cell = np.flatnonzero(tree.gaps(point) < limit * most[k])
                cell = cell[cell != own[k]].astype(np.int32)
                if len(cell):
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *(c.take(pa.array(np.full(len(cell), k))) for c in batch.columns)], ["cell", *batch.schema.names])

    def sharded(part: Column) -> Column:
        return (F.col("cell").cast("long") * parts + part).alias("shard")

    ids, every = "array<struct<id:long,m:long>>", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    placed = points.mapInArrow(lambda x: route(x, home=True), f"cell int, a long, b long, v array<double>, ids {ids}")
    placed = saved(placed.select(sharded(F.pmod("b", F.lit(parts))), F.lit(False).alias("asks"), "a", "b", "v", "ids", F.lit(math.inf).alias("most")))

    def found(asked: DataFrame) -> DataFrame:
        sent = asked.withColumn("part", every).select(sharded(F.col("part")), F.lit(True).alias("asks"), "a", "b", "v", F.lit(None).cast(ids).alias("ids"), "most")
        dealt = placed.unionByName(sent).repartition(width(spark), "shard").sortWithinPartitions("shard", "asks")
        return saved(dealt.mapInArrow(lambda x: _hits(x, k + 1), f"a long, b long, ids {ids}, square double"))

    asked = saved(asking.groupBy("a", "b").agg(F.first("v").alias("v")))
    inside = spread(asked).mapInArrow(lambda x: route(x, home=True), "cell int, a long, b long, v array<double>")
    near = found(inside.withColumn("most", F.lit(math.inf)))
    # Of a query's points in its own cell, the one with which k + 1 ids are together bounds all the rest.
    order = Window.partitionBy("a", "b").orderBy("square").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = near.withColumn("have", F.sum(F.size("ids")).over(order)).filter(F.col("have") > k).groupBy("a", "b").agg(F.min("square").alias("most"))
    limited = asked.join(reach, ["a", "b"], "left").select("a", "b", "v", F.coalesce("most", F.lit(math.inf)).alias("most"))
    outside = spread(limited).mapInArrow(lambda x: route(x, home=False), "cell int, a long, b long, v array<double>, most double")
    hits = near.unionByName(found(outside)).select("a", "b", "square", F.inline("ids"))
    closest = hits.withColumn("turn", F.row_number().over(Window.partitionBy("a", "b").orderBy("square", "id"))).filter(F.col("turn") <= k + 1).drop("turn")
    # Queries with one vector may be very many; they meet what was found for it in groups of about TOGETHER at least.
    group = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-q // TOGETHER)))).alias("g")
    own = asking.select("a", "b", group, F.col("id").alias("query_id"))
    met = own.join(closest.join(own.select("a", "b", "g").distinct(), ["a", "b"]), ["a", "b", "g"]).filter("id <> query_id")
    rows = met.select("query_id", F.col("id").alias("vec_id"), F.sqrt("square").alias("score"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
