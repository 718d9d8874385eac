"""Removal of long repeated passages by sparse suffix sorting.

Every window of `length` bytes has an anchor: the first of its substrings of CORE bytes with the
smallest hash. Equal windows have equal anchors at the same place, so only anchors whose core is
there twice matter. What stands around them, to the right and, turned, to the left, is sorted:
multikey quicksort on machine words down to a shallow depth, then a blind trie for each group that
still agrees. Common prefixes of neighbours then tell for every window whether another equals it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, saved, spread, text_bytes, width

LENGTH = 400
#: Windows that share the choice of an anchor; what is left of a window's length is the core.
REACH = 256
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
#: Bytes to which strings are sorted by words before tries take over, and contexts that are sorted at a time.
SHALLOW, GATHER = 32, 8192
#: A core with more distinct contexts is not sorted in one task: its windows are counted by digest, ZONE at a time.
HOT, ZONE = 4096, 32
#: Bits of a context's first and last window in a packed place.
BITS = 12

_BYTES = np.random.default_rng(3).integers(1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def core_hashes(raw: np.ndarray, core: int) -> np.ndarray:
    """A hash of the `core` bytes from each place on, by doubling."""
    h, size = _BYTES[raw], 1
    while size * 2 <= core:
        h = h[:-size] + h[size:] * np.uint64(pow(_BASE, size, 1 << 64))
        size *= 2
    if size < core:
        h = h[: len(raw) - core + 1] * np.uint64(_BASE) + h[core - size : core - size + len(raw) - core + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return h


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, reach: int = REACH) -> Iterator[tuple[np.ndarray, ...]]:
    """(core hash, text, place in text, first and last distance of a window's start before it) of the anchors of whole texts.

    An anchor may come in parts, each with distances of its own.
    """
    core = length - reach + 1
    sizes = np.diff(at)
    for low in range(0, max(0, len(raw) - length + 1), CHUNK):
        part = raw[low : low + CHUNK + length - 1]
        h = core_hashes(part, core)
        best, size = h, 1
        while size < reach:
            step = min(size, reach - size)
            best = np.minimum(best[:-step], best[step:])
            size += step
        # Windows that lie in one text; a run of them has one smallest hash.
        n = len(best)
        text = np.searchsorted(at, np.arange(low, low + n, dtype=np.int64), "right") - 1 if len(sizes) > 1 else np.zeros(n, np.int64)
        inside = np.arange(low, low + n) + length <= at[text + 1]
        new = inside.copy()
        new[1:] &= (best[1:] != best[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        start = np.flatnonzero(new)
        if not len(start):
            continue
        last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        where = np.empty(len(start), np.int64)
        for k in range(0, len(start), 4096):
            own = start[k : k + 4096]
            where[k : k + 4096] = own + np.argmax(h[own[:, None] + np.arange(reach)] == best[own][:, None], axis=1)
        more = np.flatnonzero(last > where)
        if len(more):  # the smallest hash comes again before the run ends
            extra = []
            for k in more.tolist():
                places = start[k] + np.flatnonzero(h[start[k] : last[k] + reach] == best[start[k]])
                begins = np.concatenate(([start[k]], places[:-1] + 1))
                ends = np.minimum(places, last[k])
                ok = begins <= last[k]
                extra.append((begins[ok], ends[ok], places[ok]))
            keep = np.ones(len(start), bool)
            keep[more] = False
            start, last, where = (np.concatenate((a[keep], *(e[j] for e in extra))) for j, a in enumerate((start, last, where)))
        yield h[where], text[start], low + where - at[text[start]], where - last, where - start


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], own: list[int]) -> tuple[list[int], list[int]]:
    """Strings in order, and the common prefix of each with the one before.

    An inner node knows the depth at which its strings part and a child for each byte there (-1: the end). A string
    goes down without a comparison, is compared with the one leaf it comes to, and is put where they part.
    """
    root: list = [own[0]]  # a leaf is a list of equal strings, an inner node a tuple (depth, children)
    for k in own[1:]:
        s, node = strings[k], root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0]]
        if s == other:
            node.append(k)
            continue
        split, above, node = _lcp(s, other), None, root
        while isinstance(node, tuple) and node[0] < split:
            above, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        mine = s[split] if split < len(s) else -1
        if isinstance(node, tuple) and node[0] == split:
            node[1][mine] = [k]
            continue
        made = (split, {mine: [k], other[split] if split < len(other) else -1: node})
        if above is None:
            root = made
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = made
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, tuple):
            children = [node[1][c] for c in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])]
            stack.append((children[0], shared))
        else:
            order += node
            common += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, common


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings within their groups, and common prefixes with the one before; -1 where a group begins."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    words = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, SHALLOW, np.int64)
    common[np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1 if n else 0))] = -1
    for w in range(SHALLOW // 8):
        # Parts that agree so far are parted by their next word.
        part = np.cumsum(common < SHALLOW)
        crowded = np.bincount(part, minlength=part[-1] + 1)[part] > 1
        rows = np.flatnonzero(crowded)
        if not len(rows):
            break
        key = words[order[rows], w]
        turn = np.lexsort((key, part[rows]))
        order[rows], key = order[rows][turn], key[turn]
        differ = key[1:] ^ key[:-1]
        cut = (differ != 0) & (part[rows][1:] == part[rows][:-1])
        lead = sum((differ >> np.uint64(64 - 8 * b) == 0).astype(np.int64) for b in range(1, 8)) + (differ == 0)
        common[rows[1:][cut]] = 8 * w + lead[cut]
    part = np.cumsum(common < SHALLOW)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        if b - a > 1:
            inner, shared = blind_trie(strings, order[a:b].tolist())
            order[a:b] = inner
            common[a + 1 : b] = shared[1:]
    follows = common >= 0
    follows[:1] = False
    before = np.concatenate((order[:1], order[:-1]))
    common = np.where(follows, np.minimum(common, np.minimum(sizes[order], sizes[before])), -1)
    return order, common


def repeated(group: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance, from low to high, of a window before the anchor that equals another of its group; -1 for none.

    A context reaches from `high` before the anchor to `length - low` after it.
    """
    n = len(contexts)
    sides = ([c[h:] for c, h in zip(contexts, high.tolist(), strict=True)], [c[:h][::-1] for c, h in zip(contexts, high.tolist(), strict=True)])
    (right, right_common), (left, left_common) = (deep_shallow(s, group) for s in sides)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        have = (low <= t) & (t <= high)
        right_class[right] = np.cumsum(right_common < length - t)
        left_class[left] = np.cumsum(left_common < t)
        rows = np.flatnonzero(have)
        key = right_class[rows] * (n + 1) + left_class[rows]
        turn = np.argsort(key)
        same = key[turn][1:] == key[turn][:-1]
        both = np.zeros(len(rows), bool)
        both[turn[1:][same]] = both[turn[:-1][same]] = True
        hit = rows[both]
        least[hit] = np.where(least[hit] < 0, t, least[hit])
        most[hit] = t
    return least, most


def _signed(*digest: bytes) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def spans(rows: DataFrame, length: int, reach: int) -> DataFrame:
    """(id, text) -> (id, start, stop): parts that windows repeated elsewhere cover, of texts told apart by id; each is compared once."""
    spark = rows.sparkSession
    texts = rows.groupBy("id").agg(F.first("text").alias("text"))
    mask = (1 << BITS) - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, at = text_bytes(batch.column(1))
            for core, text, place, low, high in anchors(raw, at, length, reach):
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(place << 2 * BITS | low << BITS | high)], ["core", "id", "place"])

    def around(batches: Iterator[pa.RecordBatch], *, whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            bodies = batch.column(1).cast(pa.binary())
            for k, (id_, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                body = bodies[k].as_py() or b""
                places = np.array([o["place"] for o in own], np.int64)
                low, high, where = places >> BITS & mask, places & mask, places >> 2 * BITS
                parts = [body[a:b] for a, b in zip((where - high).tolist(), (where - low + length).tolist(), strict=True)]
                core, place = pa.array([o["core"] for o in own], pa.int64()), pa.array(places)
                tail = [pa.array(parts, pa.binary())] if whole else [pa.array([id_] * len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays([core, *_signed(*map(_digest, parts)), place, *tail], ["core", "d1", "d2", "place", "context" if whole else "id"])

    def with_texts(places: DataFrame) -> DataFrame:
        listed = places.groupBy("id").agg(F.collect_list(F.struct("core", "place")).alias("own")).withColumnRenamed("id", "of")
        return texts.join(listed, texts.id == listed.of).select("id", "text", "own")

    key = ["core", "d1", "d2"]
    found = saved(spread(rows).mapInArrow(find, "core long, id binary, place long").distinct())
    # What is joined with a core that very many anchors have is read from a table, so that it is copied to parts of these.
    twice = saved(found.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"))
    # Anchors with cores that are there twice, and a digest of what stands around each.
    near = saved(with_texts(found.join(twice, "core")).mapInArrow(lambda b: around(b, whole=False), "core long, d1 long, d2 long, place long, id binary"))
    contexts = saved(near.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one")))
    # Cores with a context that is there once: its windows may still equal those of other contexts.
    open_ = saved(contexts.groupBy("core").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("lone")).filter("m > 1 AND lone > 0").select("core", "m"))
    asked = contexts.select("core", "one.id", "one.place").join(open_, "core")
    sizes = open_.withColumnRenamed("core", "c")
    around_one = saved(with_texts(asked).mapInArrow(lambda b: around(b, whole=True), "core long, d1 long, d2 long, place long, context binary").join(sizes, F.col("core") == F.col("c")).drop("c"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            core = table.column("core").to_numpy()
            places = table.column("place").to_numpy()
            least, most = repeated(core, places >> BITS & mask, places & mask, table.column("context").to_pylist(), length)
            hit = least >= 0
            columns = [table.column(c).to_numpy()[hit] for c in key]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(least[hit]), pa.array(most[hit])], [*key, "least", "most"])

        for batch in bounded(batches):
            held.append(batch)
            if sum(b.num_rows for b in held) > GATHER:
                table = pa.Table.from_batches(held)
                core = table.column("core").to_numpy()
                end = int(np.flatnonzero(core == core[-1])[0])  # the last group may go on
                if end:
                    yield out(table.slice(0, end))
                    held = table.slice(end).to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    result = "core long, d1 long, d2 long, least long, most long"
    sorted_ = around_one.filter(F.col("m") <= HOT).repartition(width(spark), "core").sortWithinPartitions("core").mapInArrow(sort, result)
    crowded = _counted(around_one.filter(F.col("m") > HOT), length)
    partial = sorted_.unionByName(crowded)
    low, high = F.shiftright("place", BITS).bitwiseAND(F.lit(mask)), F.col("place").bitwiseAND(F.lit(mask))
    where = F.shiftright("place", 2 * BITS)
    whole = near.join(contexts.filter("n > 1").select(key), key).select("id", (where - high).alias("start"), (where - low + length).alias("stop"))
    part = near.join(saved(partial), key).select("id", (where - F.col("most")).alias("start"), (where - F.col("least") + length).alias("stop"))
    return whole.unionByName(part)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """What repeated() says, for cores with very many contexts: no task holds a core.

    Windows go by zones of distances. If what all windows of a zone share is there once, none is repeated; if what they
    all make up is there twice, all are. Only for zones between the two are windows counted one by one, by digest.
    """
    mask = (1 << BITS) - 1

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows: list[tuple] = []
            for core, d1, d2, place, context in zip(*(batch.column(c).to_pylist() for c in ("core", "d1", "d2", "place", "context")), strict=True):
                low, high = place >> BITS & mask, place & mask
                for zone in range(low // ZONE, high // ZONE + 1):
                    a, b = max(low, zone * ZONE), min(high, zone * ZONE + ZONE - 1)
                    union = context[high - b : high - a + length]
                    shared = union[b - a : length]
                    rows.append((core, d1, d2, a, b, union, _digest(shared), _digest(union)))
            if rows:
                core, d1, d2, a, b, union, shared, all_ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (core, d1, d2, a, b)), pa.array(union, pa.binary()), *_signed(*shared), *_signed(*all_)], ["core", "d1", "d2", "a", "b", "union", "s1", "s2", "u1", "u2"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = [
                (core, d1, d2, t, _digest(union[b - t : b - t + length]))
                for core, d1, d2, a, b, union in zip(*(batch.column(c).to_pylist() for c in ("core", "d1", "d2", "a", "b", "union")), strict=True)
                for t in range(a, b + 1)
            ]
            if rows:
                core, d1, d2, t, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (core, d1, d2, t)), *_signed(*w)], ["core", "d1", "d2", "t", "w1", "w2"])

    def often(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)

    # Contexts without a window in a zone's part of another's run have other bounds a and b, and no window in common there.
    zoned = saved(contexts.mapInArrow(zones, "core long, d1 long, d2 long, a long, b long, union binary, s1 long, s2 long, u1 long, u2 long").withColumn("zone", F.floor(F.col("a") / ZONE)))
    by_union = ["core", "a", "b", "u1", "u2"]
    full = zoned.join(often(zoned, *by_union), by_union).select("core", "d1", "d2", F.col("a").alias("least"), F.col("b").alias("most"))
    rest = zoned.join(often(zoned, *by_union), by_union, "left_anti")
    single = saved(rest.select("core", "d1", "d2", "a", "b", "union").unionByName(zoned.join(often(zoned, *by_union), by_union).dropDuplicates(by_union).select("core", "d1", "d2", "a", "b", "union")).mapInArrow(windows, "core long, d1 long, d2 long, t long, w1 long, w2 long"))
    found = single.join(often(single, "core", "t", "w1", "w2"), ["core", "t", "w1", "w2"]).groupBy("core", "d1", "d2").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    return full.unionByName(found).groupBy("core", "d1", "d2").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def _merged(own: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((o["start"], o["stop"]) for o in own or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, reach: int = REACH, keep: bool = False) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts elsewhere, in any document.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; keep adds kept_text, what stays as
    text, where a character that was cut through is U+FFFD. A null text is empty. Equal texts, of one row or many, fall
    together first: all of their bytes are there elsewhere, so such texts go whole, short ones apart, and one of them
    meets the others. Null ids are ids. Other columns are not read. Empty in, empty out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    body: Column = F.coalesce(F.col(text), F.lit(""))
    same = F.unhex(F.substring(F.sha2(body, 256), 1, 32))
    rows = docs.select(F.col(doc_id).alias("doc_id"), same.alias("id"), body.alias("text"))
    long = rows.filter(F.octet_length("text") >= length).select("id", "text")
    often = long.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    covered = spans(long, length, reach).unionByName(often.select("id", F.lit(0).cast("long").alias("start"), F.lit(1 << 40).alias("stop")))
    listed = covered.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("own")).withColumnRenamed("id", "of")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sizes, gone, runs, shas, kepts = [], [], [], [], []
            for body, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = _merged(own, len(body))
                edges = [0, *(e for p in parts for e in p), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if parts else body
                sizes.append(len(body))
                gone.append(len(body) - len(kept))
                runs.append(len(parts))
                shas.append(hashlib.sha256(kept).hexdigest())
                kepts.append(kept.decode("utf-8", "replace") if keep else None)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, gone, runs)), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kepts, pa.string())] if keep else columns, [*names, "kept_text"] if keep else names)

    joined = rows.join(listed, rows.id == listed.of, "left").select("doc_id", "text", "own")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep)
