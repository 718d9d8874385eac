"""Hard-negative mining over product codes with residual norms.

Each vector is an array of integers. It is cut into subvectors, and each subvector is stored as the
nearest word of a codebook together with the norm of what the word leaves over. An anchor's product
with a word is looked up in a table; by Cauchy and Schwarz, its product with what is left over is no
larger than the product of the norms. So sums from the tables, plus or minus a bound, tell which
vectors may be among the wanted ones; those alone are multiplied, in exact integers.

Vectors lie in shards; the anchors stream past each of them, first for their positives, then for
the negatives in the windows that the positives open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, saved, spread, width

#: Components of a subvector, words of a codebook, and vectors to which codebooks are fitted, in so many rounds.
SUB, WORDS, SAMPLE, ROUNDS = 2, 256, 4096, 6
#: Vectors of a shard, shards there are at least, vectors that are scored at a time, anchors that are answered together.
SHARD, LEAST_SHARDS, CHUNK, TOGETHER = 1 << 17, 16, 8192, 64
LOWEST = -(1 << 62)


def _subvectors(codes: np.ndarray) -> np.ndarray:
    """(n, components) -> (n, subvectors, SUB), with zeros to fill the last one."""
    n, size = codes.shape
    parts = -(-size // SUB)
    padded = np.zeros((n, parts * SUB), codes.dtype)
    padded[:, :size] = codes
    return padded.reshape(n, parts, SUB)


def fit(codes: np.ndarray) -> np.ndarray:
    """Codebooks of integers (subvectors, words, SUB), by Lloyd's rounds."""
    cut = _subvectors(codes.astype(float))
    n, parts, _ = cut.shape
    words = min(WORDS, n)
    books = cut[np.linspace(0, n - 1, words).astype(int)].transpose(1, 0, 2).copy()
    for part in range(parts):
        for _ in range(ROUNDS):
            own = _nearest(cut[:, part], books[part])
            count = np.bincount(own, minlength=words)
            for axis in range(SUB):
                total = np.bincount(own, cut[:, part, axis], words)
                books[part, :, axis] = np.where(count > 0, total / np.maximum(count, 1), books[part, :, axis])
    return np.rint(books).astype(np.int64)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(axis=1) / 2 - points @ book.T, axis=1)


def encode(codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each subvector, and the norms of what they leave over, rounded up."""
    cut = _subvectors(codes)
    words = np.zeros(cut.shape[:2], np.uint8)
    for part in range(cut.shape[1]):
        words[:, part] = _nearest(cut[:, part].astype(float), books[part].astype(float))
    left = (cut - books[np.arange(cut.shape[1]), words]).astype(float)
    return words, np.nextafter(np.sqrt((left * left).sum(axis=2)).astype(np.float32), np.float32(np.inf))


def _blobs(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(blobs: pa.Array, kind: type) -> np.ndarray:
    """The matrix of binary values of one length."""
    if not len(blobs):
        return np.zeros((0, 0), kind)
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = blobs.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw.view(kind).reshape(len(blobs), -1) if len(raw) else np.zeros((len(blobs), 0), kind)


class Shard:
    """Vectors of one size; wholly equal rows count once."""

    def __init__(self, held: pa.Table, books: np.ndarray) -> None:
        column = lambda name: held.column(name).combine_chunks()
        self.ids, self.labels = column("id").to_numpy(), column("label").to_numpy()
        self.codes, self.words, self.rest = _matrix(column("code"), np.int32), _matrix(column("words"), np.uint8), _matrix(column("rest"), np.float32)
        order = np.lexsort((*self.codes.T, self.labels, self.ids))
        self._take(order)
        again = (self.ids[1:] == self.ids[:-1]) & (self.labels[1:] == self.labels[:-1]) & (self.codes[1:] == self.codes[:-1]).all(axis=1)
        if again.any():
            self._take(np.flatnonzero(np.append(True, ~again)))
        self.books = books
        self.peak = int(np.abs(self.codes.astype(np.int64)).max(initial=0))

    def _take(self, rows: np.ndarray) -> None:
        self.ids, self.labels, self.codes, self.words, self.rest = self.ids[rows], self.labels[rows], self.codes[rows], self.words[rows], self.rest[rows]

    def bounds(self, anchors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Chunks of vectors with the least and the greatest product that each may have with each anchor (vectors, anchors)."""
        size = anchors.shape[1]
        peak = int(np.abs(anchors).max(initial=0))
        if 4 * max(peak, 1) * max(self.peak, int(np.abs(self.books).max(initial=0)), 1) * max(size, 1) >= 1 << 62:
            raise ValueError("products of these vectors may pass 64 bits")
        cut = _subvectors(anchors)
        tables = np.einsum("aps,pws->pwa", cut, self.books)
        norms = np.sqrt((cut.astype(float) ** 2).sum(axis=2)).T
        for start in range(0, len(self.ids), CHUNK):
            own = slice(start, min(start + CHUNK, len(self.ids)))
            score = np.zeros((own.stop - start, len(anchors)), np.int64)
            for part, table in enumerate(tables):
                score += table[self.words[own, part]]
            reach = np.ceil((self.rest[own].astype(float) @ norms) * (1 + 1e-9)).astype(np.int64) + 1
            yield own, score - reach, score + reach

    def exact(self, rows: np.ndarray, anchors: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.codes[rows].astype(np.int64), anchors[cols])


def _best(cols: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the k first of each column by (score descending, id), and each column's k-th score."""
    order = np.lexsort((ids, -scores, cols))
    cols = cols[order]
    starts = np.searchsorted(cols, np.arange(n))
    kept = np.arange(len(cols)) - starts[cols] < k
    kth = np.full(n, LOWEST)
    full = np.searchsorted(cols, np.arange(n), "right") - starts >= k
    kth[full] = scores[order[starts[full] + k - 1]]
    return order[kept], kth


def positives(shard: Shard, anchors: dict[str, np.ndarray], k: int) -> pa.Table:
    """Each anchor's k best other rows of its label: key, place (0), id, score."""
    n = len(anchors["id"])
    cols, ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(n, LOWEST)
    for own, low, high in shard.bounds(anchors["code"]):
        wanted = (shard.labels[own, None] == anchors["label"]) & (shard.ids[own, None] != anchors["id"])
        if len(low) >= k:  # k vectors have at least the k-th of the lower bounds
            least = np.maximum(least, np.partition(np.where(wanted, low, LOWEST), len(low) - k, axis=0)[len(low) - k])
        rows, at = np.nonzero(wanted & (high >= least))
        rows += own.start
        cols, ids, scores = np.append(cols, at), np.append(ids, shard.ids[rows]), np.append(scores, shard.exact(rows, anchors["code"], at))
        kept, kth = _best(cols, scores, ids, k, n)
        cols, ids, scores, least = cols[kept], ids[kept], scores[kept], np.maximum(least, kth)
    return pa.table({"id": anchors["id"][cols], "key": anchors["key"][cols], "place": np.zeros(len(cols), np.int32), "other": ids, "score": scores})


def negatives(shard: Shard, anchors: dict[str, np.ndarray], k: int) -> pa.Table:
    """For each window (low, high) of an anchor the k best rows of other labels in it: key, place (of the window), id, score."""
    n, windows = anchors["low"].shape
    parts, found = [], [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(windows)]
    least = anchors["low"].copy()
    for own, low, high in shard.bounds(anchors["code"]):
        wanted = shard.labels[own, None] != anchors["label"]
        rows, at = np.nonzero(wanted & (high >= least.min(axis=1)) & (low <= anchors["high"].max(axis=1)))
        rows += own.start
        ids, scores = shard.ids[rows], shard.exact(rows, anchors["code"], at)
        for w in range(windows):
            inside = (scores >= least[at, w]) & (scores <= anchors["high"][at, w])
            now = tuple(np.append(a, b[inside]) for a, b in zip(found[w], (at, ids, scores), strict=True))
            kept, kth = _best(now[0], now[2], now[1], k, n)
            found[w] = tuple(a[kept] for a in now)
            least[:, w] = np.maximum(least[:, w], kth)
    for w, (cols, ids, scores) in enumerate(found):
        parts.append(pa.table({"id": anchors["id"][cols], "key": anchors["key"][cols], "place": np.full(len(cols), w, np.int32), "other": ids, "score": scores}))
    return pa.concat_tables(parts)


def _anchors(part: pa.RecordBatch, low: int, high: int) -> dict[str, np.ndarray]:
    out = {"id": part.column("id").to_numpy(), "label": part.column("label").to_numpy(), "key": part.column("key").to_numpy(), "code": _matrix(part.column("code"), np.int32).astype(np.int64)}
    lists = part.column("positives")
    sizes = np.diff(lists.offsets.to_numpy())
    if sizes.any():
        # Windows in integers: low * p <= 100 * n <= high * p. One that isn't there lets nothing in.
        score = lists.flatten().to_numpy()
        at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(score)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out["low"], out["high"] = np.full((len(sizes), sizes.max()), 1 << 62), np.full((len(sizes), sizes.max()), LOWEST)
        out["low"][at], out["high"][at] = -(-low * score // 100), high * score // 100
    return out


def _mine(batches: Iterator[pa.RecordBatch], books: dict[int, np.ndarray], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, asks, ...) in order of shard and asks: a shard's vectors are held, its anchors stream past them."""
    now, points, shard = None, [], None
    for batch in bounded(batches):
        name, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, (np.diff(name) != 0) | (asks[1:] != asks[:-1])))
        for first, last in zip(starts, [*starts[1:], len(name)], strict=True):
            part = batch.slice(first, last - first)
            if name[first] != now:
                now, points, shard = name[first], [], None
            if not asks[first]:
                points.append(part)
                continue
            if shard is None:
                if not points:
                    continue
                size = part.column("size")[0].as_py()
                shard = Shard(pa.Table.from_batches(points), books.get(size, np.zeros((-(-size // SUB), 1, SUB), np.int64)))
                points = points[:1]
            for start in range(0, len(part), TOGETHER):
                anchors = _anchors(part.slice(start, TOGETHER), low, high)
                yield from (negatives if "low" in anchors else positives)(shard, anchors, k).to_batches()


def hard_negatives(table: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each row that `anchors` marks and each of its positives, the hardest negatives: anchor_id, positive_id, rank from
    1, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), in double precision; a score is the product with the anchor, exact. Positives
    are the first other rows of the anchor's label by (score descending, id), negatives the first rows of other labels of
    those with low * positive <= 100 * negative <= high * positive. All there are, if fewer. Rows with a null id, label or
    vector, or with a null or non-finite component, take no part; vectors meet those of their own length alone, and empty
    ones have products of 0. "Other" rows have another id. Wholly equal rows count once; rows that share an id alone are rows
    each, and anchors each. A component past 32 bits, or products that may pass 64, are an error. Other columns are not read.

    Codebooks are fitted to SAMPLE vectors at most. They decide how much is multiplied and nothing else: a length that is not
    in the sample has one word of zeros. Vectors are dealt to shards of about SHARD by their ids,
    so no label fills one, and each anchor visits all shards of its length.
    """
    spark = table.sparkSession
    v = F.col(vector)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    code = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), code.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    n = rows.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(SAMPLE).toArrow().column("v").to_pylist()
    sizes: dict[int, list] = {}
    for code in some:
        sizes.setdefault(len(code), []).append(code)
    books = spark.sparkContext.broadcast({size: fit(np.array(codes, np.int64)) for size, codes in sizes.items() if size})

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy()
            for size in np.unique(np.diff(offsets)):
                own = np.flatnonzero(np.diff(offsets) == size)
                codes = lists.values.to_numpy()[offsets[own][:, None] + np.arange(size)].astype(np.int64).reshape(len(own), size)
                words, rest = encode(codes, books.value.get(size, np.zeros((-(-size // SUB), 1, SUB), np.int64)))
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), size, np.int32)), batch.column("id").take(at), batch.column("label").take(at), batch.column("asks").take(at), _blobs(codes.astype(np.int32)), _blobs(words), _blobs(rest)], ["size", "id", "label", "asks", "code", "words", "rest"])

    parts = max(LEAST_SHARDS, -(-n // SHARD))
    stored = saved(spread(rows).mapInArrow(store, "size int, id long, label long, asks boolean, code binary, words binary, rest binary"))
    own = F.pmod(F.xxhash64("id"), F.lit(parts))
    key = F.xxhash64("label", "code").alias("key")
    asking = saved(stored.filter("asks").select("size", "id", "label", "code", key).distinct())

    def shard(part: Column) -> Column:
        return (F.col("size").cast("long") * parts + part).alias("shard")

    none, scores = F.lit(None), "array<long>"
    held = stored.select(shard(own), F.lit(False).alias("asks"), "size", "id", "label", "code", "words", "rest", none.cast("long").alias("key"), none.cast(scores).alias("positives"))

    def mined(asked: DataFrame, k: int) -> DataFrame:
        sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        sent = sent.select(shard(F.col("part")), F.lit(True).alias("asks"), "size", "id", "label", "code", none.cast("binary").alias("words"), none.cast("binary").alias("rest"), "key", "positives")
        dealt = held.unionByName(sent).repartition(width(spark), "shard").sortWithinPartitions("shard", "asks")
        found = dealt.mapInArrow(lambda x: _mine(x, books.value, k, low, high), "id long, key long, place int, other long, score long")
        order = Window.partitionBy("id", "key", "place").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = saved(mined(asking.withColumn("positives", F.array().cast(scores)), positives))
    lists = near.groupBy("id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))
    far = mined(asking.join(lists, ["id", "key"]), negatives)
    pairs = near.select("id", "key", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(pairs, ["id", "key", "place"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same by multiplying all; rows by the label that the query gives them.
ORACLE_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, c.v)::BIGINT END AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), w AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM w WHERE rank <= 5
"""
