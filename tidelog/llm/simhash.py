"""SimHash near-duplicates by vantage-point trees.

Equal fingerprints fall together first. A tree over a bounded sample of fingerprints cuts the space
into shards: at each node the distance to a vantage point decides the side, and a fingerprint whose
distance is within the link radius of the cut also visits the other side. A link between two
fingerprints is found in the home shard of the one with the smaller shard number. Shards search
with trees of their own and return a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, saved, text_bytes
from tidelog.llm.components import components

#: Words of a shingle, seed of its hash, largest distance of linked fingerprints.
WORDS, SEED, RADIUS = 3, 42, 3
#: The tree is built from about so many fingerprints, and has so many shards at most.
SAMPLE, MOST_SHARDS = 16_384, 1024
#: Fingerprints at home in a shard, by estimate; a shard with more than SPLIT rows is dealt to pairs of blocks.
SHARD, SPLIT = 16_384, 1 << 17
#: Fingerprints that are compared each with each.
LEAF = 384
#: Words of a text that are hashed at a time.
BLOCK = 1 << 19


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a whole lower-cased text, in blocks."""
    words, digest = text.split(), xxhash.xxh64_intdigest
    if 0 < len(words) < WORDS:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)
    for k in range(0, len(words) - WORDS + 1, BLOCK):
        block = words[k : k + BLOCK + WORDS - 1]
        joined = b" ".join(block)
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        ends = np.cumsum(lengths + 1) - 1
        first, last = (ends - lengths)[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist()
        yield np.fromiter([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64, len(first))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A bit is set where more than half of the hashes set it; no words give 0."""
    raw, at = text_bytes(texts)
    lower = raw.tobytes().lower()  # changes A-Z alone
    own, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i in range(len(sizes)):
        for h in shingle_hashes(lower[at[i] : at[i + 1]]):
            own.append(h)
            sizes[i] += len(h)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    hashes = np.concatenate(own)
    # Eight bits of eight bytes are counted at a time; a byte holds the count of 255 hashes.
    blocks = -(-sizes[full] // 255)
    first = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(sizes[full]) - sizes[full], blocks) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


@dataclass
class Node:
    """Inside the cut or at home in a shard. share: of the sample, at home and as visitors."""

    point: int = 0
    cut: int = 0
    near: Node | None = None
    far: Node | None = None
    shard: int = -1
    blocks: int = 1


def build(sample: np.ndarray, total: int) -> Node:
    """A tree over a sample of `total` fingerprints; leaves get numbers from left to right."""
    scale = total / max(1, len(sample))
    shards = [0]

    def grow(home: np.ndarray, all_: np.ndarray, depth: int) -> Node:
        if len(home) * scale > SHARD and len(home) > 8 and depth < MOST_SHARDS.bit_length() - 1:
            for point in home[:: max(1, len(home) // 4)][:4]:
                d = np.bitwise_count(home ^ point)
                e = np.bitwise_count(all_ ^ point)
                cut = int(np.median(d))
                near, far = e <= cut + RADIUS, e > cut - RADIUS
                if 0 < (d <= cut).sum() < len(home) and near.sum() + far.sum() < 1.8 * len(all_):
                    return Node(int(point), cut, grow(home[d <= cut], all_[near], depth + 1), grow(home[d > cut], all_[far], depth + 1))
        shards[0] += 1
        return Node(shard=shards[0] - 1, blocks=max(1, int(np.ceil(len(all_) * scale / SPLIT))))

    return grow(sample, sample, 0)


def route(node: Node, x: np.ndarray) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
    """Leaves with the indices of fingerprints that are at home there, and of those that visit from a later shard."""

    def walk(node: Node, home: np.ndarray, visit: np.ndarray) -> Iterator:
        if not len(home) and not len(visit):
            return
        if node.near is None:
            yield node, home, visit
            return
        d = np.bitwise_count(x[home] ^ np.uint64(node.point))
        e = np.bitwise_count(x[visit] ^ np.uint64(node.point))
        inside = d <= node.cut
        yield from walk(node.near, home[inside], np.concatenate((visit[e <= node.cut + RADIUS], home[~inside & (d <= node.cut + RADIUS)])))
        yield from walk(node.far, home[~inside], visit[e > node.cut - RADIUS])

    yield from walk(node, np.arange(len(x)), np.zeros(0, np.int64))


class Forest:
    """Links fingerprints at most RADIUS apart; root holds the smallest index of each tree."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.root, self.pending, self.waiting = x, np.arange(len(x)), [], 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pending.append((a, b))
        self.waiting += len(a)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        a, b = map(np.concatenate, zip(*self.pending, strict=True))
        self.pending, self.waiting, root = [], 0, self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while ((up := root[root]) != root).any():
                root = up
        self.root = root

    def compare(self, a: np.ndarray, b: np.ndarray, *, same: bool = False) -> None:
        """Each of a with each of b, some at a time."""
        step = max(1, (1 << 20) // max(1, len(b)))
        for k in range(0, len(a), step):
            near = np.bitwise_count(self.x[a[k : k + step], None] ^ self.x[None, b]) <= RADIUS
            i, j = np.nonzero(near)
            if same:
                i, j = i[a[k + i] < b[j]], j[a[k + i] < b[j]]
            if len(i):
                self.link(a[k + i], b[j])

    def within(self, a: np.ndarray) -> None:
        stack = [a]
        while stack:
            a = stack.pop()
            if len(a) <= LEAF:
                self.compare(a, a, same=True)
                continue
            d = np.bitwise_count(self.x[a] ^ self.x[a[len(a) // 2]])
            cut = int(np.median(d))
            inside = d <= cut
            if inside.all():
                self.compare(a, a, same=True)
                continue
            stack += [a[inside], a[~inside]]
            self.between(a[inside & (d > cut - RADIUS)], a[~inside & (d <= cut + RADIUS)])

    def between(self, a: np.ndarray, b: np.ndarray) -> None:
        stack = [(a, b)]
        while stack:
            a, b = sorted(stack.pop(), key=len)
            if len(a) * len(b) <= LEAF * LEAF or len(a) <= 32:
                self.compare(a, b)
                continue
            point = self.x[b[len(b) // 2]]
            d, e = np.bitwise_count(self.x[b] ^ point), np.bitwise_count(self.x[a] ^ point)
            cut = int(np.median(d))
            if (d <= cut).all():
                self.compare(a, b)
                continue
            stack += [(a[e <= cut + RADIUS], b[d <= cut]), (a[e > cut - RADIUS], b[d > cut])]


def links(distinct: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints at most RADIUS apart: column fp -> a spanning forest of each shard."""
    spark = distinct.sparkSession
    share = min(1.0, SAMPLE / max(1, total))
    picked = distinct.filter(F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.sort(picked.toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    np.random.default_rng(0).shuffle(sample)
    tree = spark.sparkContext.broadcast(build(sample, total))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = batch.column(0).to_numpy().view(np.uint64)
            block = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            for leaf, home, visit in route(tree.value, x):
                at = np.concatenate((home, visit))
                own = np.arange(len(at)) < len(home)
                mine = (block[at] % np.uint64(leaf.blocks)).astype(np.int32)
                for other in range(leaf.blocks):  # one row for each pair of blocks that a fingerprint is in
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), leaf.shard, np.int32)), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine), pa.array(x[at].view(np.int64)), pa.array(own)],
                        ["shard", "i", "j", "block", "fp", "home"],
                    )

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(rows["fp"].to_numpy(np.int64).view(np.uint64))
        home, block = rows["home"].to_numpy(), rows["block"].to_numpy()
        _, i, j = key
        if i == j:
            forest.within(np.flatnonzero(home))
            forest.between(np.flatnonzero(home), np.flatnonzero(~home))
        else:
            forest.between(np.flatnonzero(home & (block == i)), np.flatnonzero(block == j))
            forest.between(np.flatnonzero(~home & (block == i)), np.flatnonzero(home & (block == j)))
        forest.settle()
        moved = np.flatnonzero(forest.root != np.arange(len(rows)))
        x = forest.x.view(np.int64)
        return pd.DataFrame({"a": x[moved], "b": x[forest.root[moved]]})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, i int, j int, block int, fp long, home boolean")
    return dealt.groupBy("shard", "i", "j").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and class of every whole text: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null texts and texts without words have fingerprint zero and link like any other. Null ids are passed over in
    choosing the smallest id. Rows that are there more than once give as many rows. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["doc_id", "fp"])

    printed = saved(docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp long"))
    distinct = saved(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(links(distinct, distinct.count()))
    joined = saved(distinct.join(label, distinct.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    smallest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = joined.select("fp", "label").join(smallest, "label").select(F.col("fp").alias("of"), "component_id")
    return printed.join(by_print, printed.fp == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose class has a smaller id; all columns stay. Rows without an id stay."""
    classes = near_duplicates(docs, doc_id=doc_id, text=text)
    gone = classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(docs.columns)
