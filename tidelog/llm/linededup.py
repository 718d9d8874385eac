"""Line dedup by an exact set-similarity join.

A line is the set of its words; a line goes if an earlier one, in order of document and line, has a
Jaccard similarity of at least SIMILARITY with it. Words are ordered by rarity, as a sketch over all
documents counts them, and lines meet under the words of their prefixes. Length, place of the word
and parity of the hashes rule out most of those that meet; the rest is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, saved, spread, text_bytes, width

#: A line is a set of lower-cased words; every line with a word takes part, unless the caller asks for more words.
LEAST_WORDS, SIMILARITY = 1, (4, 5)
#: Counters of the rarity sketch.
COUNTERS = 1 << 20
#: Bytes of text that are turned into sets at a time; only a longer line is taken as a whole.
CHUNK = 1 << 20

#: Postings that a task gathers before it sends them off, and earlier lines named at first for each line and word.
GATHER, NAMED = 1 << 20, 4
#: Lines under a crowded word that one task compares with as many others.
MEET = 8192
#: Lines of more words have WIDE further words of parity in their postings.
LONG, WIDE = 120, 4

#: What a posting says: the word, where the line is, its size, the word's place, parity and hash of the set.
_FIELDS = {"word": np.uint32, "doc": np.int64, "line": np.int32, "size": np.int32, "place": np.int32, "parity": np.uint64, "more": np.uint64, "set": np.uint64}
_PLACE = list(_FIELDS).index("place")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D | 1
_BYTES = np.random.default_rng(8).integers(1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
#: White space parts words and counts nothing in their hashes.
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_BYTES[~_WORD] = 0
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1]


@dataclass
class Sets:
    """Lines with enough distinct words: document, number in it, and the words' hashes, sorted, end to end."""

    doc: np.ndarray
    line: np.ndarray
    words: np.ndarray
    size: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def line_sets(raw: np.ndarray, at: np.ndarray, least: int = LEAST_WORDS) -> Iterator[Sets]:
    """The sets of all lines of whole texts with at least `least` distinct words, some lines at a time."""
    breaks = np.flatnonzero(raw == 10)
    ends = np.concatenate((at[1:], breaks))  # a line ends with its text or at a line feed, which may be the next text's first
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    is_last = order < len(at) - 1
    doc = np.cumsum(np.concatenate(([0], is_last[:-1])))
    starts = np.concatenate(([0], np.where(is_last[:-1], ends[:-1], ends[:-1] + 1))) if len(ends) else ends
    first_line = np.concatenate(([0], np.flatnonzero(is_last)[:-1] + 1)) if len(ends) else ends
    number = np.arange(len(ends)) - first_line[doc] if len(ends) else ends
    k = 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK, "right")))
        yield from _sets(raw[starts[k] : ends[stop - 1]], starts[k:stop] - starts[k], doc[k:stop], number[k:stop], least)
        k = stop


def _sets(raw: np.ndarray, starts: np.ndarray, doc: np.ndarray, number: np.ndarray, least: int) -> Iterator[Sets]:
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[(starts > 0) & (starts < len(raw))]
    first[inner] = word[inner]  # where a text begins without a space before it
    begin = np.flatnonzero(first)
    if not len(begin):
        return
    power, inverse = powers(len(raw))
    values = _BYTES[raw]
    values *= power
    h = np.add.reduceat(values, begin)
    h *= inverse[begin]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    of = np.searchsorted(starts, begin, "right") - 1
    bits = np.uint64(64 - int(len(starts)).bit_length())
    order = np.argsort(of.astype(np.uint64) << bits | h >> (np.uint64(64) - bits))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    of, h = of[new], h[new]
    size = np.bincount(of, minlength=len(starts))
    full = size >= least
    if not full.any():
        return
    h = h[full[of]]
    yield Sets(doc[full], number[full], h, size[full])


def by_rarity(sets: Sets, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each line with the rarest first, ties by hash, and each word's place."""
    start = np.repeat(sets.start, sets.size)
    place = np.arange(len(start)) - start
    seen = counts[sets.words & np.uint64(COUNTERS - 1)].astype(np.uint64)
    bits = int(sets.size.max(initial=0)).bit_length()
    if bits + len(sets.size).bit_length() <= 32:  # line, count and place in one number, which sorts faster than an order does
        low = np.uint64(bits)
        key = np.sort((sets.owner.astype(np.uint64) << np.uint64(32) | seen) << low | place.astype(np.uint64))
        order = start + (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.lexsort((seen, sets.owner))
    return sets.words[order], place


def rarity(docs: DataFrame, text: str, least: int = LEAST_WORDS) -> np.ndarray:
    """COUNTERS counts of lines by hash of their words, over all documents; a fixed number of bytes."""
    part = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in bounded(batches):
            for sets in line_sets(*text_bytes(batch.column(0)), least):
                np.add.at(counts, (sets.words & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        for k in range(0, COUNTERS, part):
            if counts[k : k + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts[k : k + part].tobytes()])], ["k", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("counts"))
        return pa.table({"k": table.column("k")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()])})

    rows = docs.select(text).mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").collect()
    counts = np.zeros(COUNTERS, np.int64)
    for row in rows:
        counts[row["k"] : row["k"] + part] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32)


def _pack(columns: list[np.ndarray], which: np.ndarray) -> bytes:
    """Columns one after the other; those of wide parity for long lines alone."""
    long = which[columns[3][which] > LONG]
    parts = [c[which].tobytes() for c in columns[: len(_FIELDS)]] + [c[long].tobytes() for c in columns[len(_FIELDS) :]]
    return np.int64(len(which)).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    each = []
    for blob in blobs:
        n, raw = int(np.frombuffer(blob, np.int64, 1)[0]), zstandard.ZstdDecompressor().decompress(blob[8:])
        at, columns = 0, []
        for kind in _FIELDS.values():
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        long = columns[3] > LONG
        m = int(long.sum())
        for _ in range(WIDE):
            column = np.zeros(n, np.uint64)
            column[long] = np.frombuffer(raw, np.uint64, m, at)
            columns.append(column)
            at += 8 * m
        each.append(columns)
    return [np.concatenate(c) for c in zip(*each, strict=True)]


def postings(sets: Sets, ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """A posting for each word of each line's prefix: columns as _FIELDS, then WIDE words of parity."""
    over, under = SIMILARITY
    words, place = by_rarity(sets, counts)
    owner = sets.owner
    prefix = sets.size - -(-over * sets.size // under) + 1
    kept = place < prefix[owner]
    if len(words):
        whole = np.add.reduceat((words ^ (words >> np.uint64(31))) * _MIX, sets.start)
        parity = [*_parity(words, sets.start, 57, 2), *(np.zeros(len(sets.size), np.uint64) for _ in range(WIDE))]
        long = sets.size > LONG
        if long.any():
            sizes = sets.size[long]
            for wide, part in zip(parity[2:], _parity(words[long[owner]], np.cumsum(sizes) - sizes, 20, WIDE), strict=True):
                wide[long] = part
    else:
        whole, parity = words, [words] * (2 + WIDE)
    owner = owner[kept]
    columns = (words[kept] >> np.uint64(32), ids[sets.doc][owner], sets.line[owner], sets.size[owner], place[kept], parity[0][owner], parity[1][owner], whole[owner])
    return [*(c.astype(t) for c, t in zip(columns, _FIELDS.values(), strict=True)), *(p[owner] for p in parity[2:])]


def joined(gathered: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of all that was gathered end to end; each part goes when it is copied, so that little is there twice."""
    columns = []
    for k in range(len(gathered[0])):
        columns.append(np.concatenate([g[k] for g in gathered]))
        for g in gathered:
            g[k] = columns[-1][:0]
    gathered.clear()
    return columns


def earliest(columns: list[np.ndarray]) -> np.ndarray:
    """Marks the postings of the earliest line of each set; a line's postings come one after the other, from place 0 on."""
    _, doc, line, _, place, _, _, whole, *_ = columns
    begins = np.flatnonzero(place == 0)
    order = begins[np.lexsort((line[begins], doc[begins], whole[begins]))]
    new = np.ones(len(order), bool)
    new[1:] = whole[order][1:] != whole[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    kept = np.zeros(len(place), bool)
    kept[order] = (doc[order] == doc[head]) & (line[order] == line[head])
    return kept[begins[np.cumsum(place == 0) - 1]]


def _parity(words: np.ndarray, start: np.ndarray, shift: int, parts: int) -> list[np.ndarray]:
    """Bits of which each word of a line turns one, by its hash from bit `shift` on."""
    part = (words >> np.uint64(shift)) % np.uint64(parts)
    bit = np.uint64(1) << (words >> np.uint64(shift) & np.uint64(64 * parts - 1)) // np.uint64(parts)
    return [np.bitwise_xor.reduceat(np.where(part == p, bit, np.uint64(0)), start) for p in range(parts)]


def meet(columns: list[np.ndarray], named: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of lines under the same word, in order: (line, earlier line or -1, word or -1, whether more were left out), by index.

    Without an earlier line and a word, the line is the same set as an earlier one. Of lines that may be similar, the
    `named` earliest are given. Under words where some line had more, all lines come once more with the word.
    """
    over, under = SIMILARITY
    word, doc, line, size, place, parity, parity2, whole, *wide = columns
    in_order = np.lexsort((line, doc))
    key = word.astype(np.uint64) << np.uint64(32) | whole >> np.uint64(32)
    first = in_order[np.argsort(key[in_order], kind="stable")]
    same = np.zeros(len(first), bool)
    same[1:] = (word[first][1:] == word[first][:-1]) & (whole[first][1:] == whole[first][:-1]) & (size[first][1:] == size[first][:-1])
    # Equal sets meet under each of their words; one row, from the rarest, is enough. What is the same in the same place
    # comes from a row that is there twice.
    again = np.flatnonzero(same)
    copies, before = first[again], first[again - 1]
    copies = copies[(place[copies] == 0) & ((doc[copies] != doc[before]) | (line[copies] != line[before]))]
    none = np.full(len(copies), -1)
    yield copies, none, none, none > 0
    unlike = np.ones(len(first), bool)
    unlike[first[same]] = False
    left = in_order[unlike[in_order]]
    left = left[np.argsort(word[left], kind="stable")]
    begins = np.ones(len(left), bool)
    begins[1:] = word[left][1:] != word[left][:-1]
    start = np.maximum.accumulate(np.where(begins, np.arange(len(left)), 0))
    later = np.flatnonzero(~begins)
    had = np.zeros(len(left), np.int32)
    sizes, places = size[left].astype(np.int64), place[left].astype(np.int64)
    bits = [c[left] for c in (parity, parity2)]
    k = 0
    while len(later):
        # The cheap tests come first, and what they leave goes on.
        x, y = later, start[later] + k
        may = under * np.minimum(sizes[x], sizes[y]) >= over * np.maximum(sizes[x], sizes[y])
        x, y = x[may], y[may]
        total = sizes[x] + sizes[y]
        need = -(-over * total // (over + under))
        may = np.minimum(places[x], places[y]) + np.minimum(sizes[x] - places[x], sizes[y] - places[y]) >= need
        x, y, most = x[may], y[may], (total - 2 * need)[may]
        # Each word that only one of the two has turns one bit.
        may = sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int64) for c in bits) <= most
        x, y, most = x[may], y[may], most[may]
        both = np.minimum(sizes[x], sizes[y]) > LONG
        if both.any():
            may = sum(np.bitwise_count(w[left[x]] ^ w[left[y]]).astype(np.int64) for w in wide) <= most
            x, y = x[may | ~both], y[may | ~both]
        if len(x):
            had[x] += 1
            few = had[x] <= named
            none = np.full(int(few.sum()), -1)
            yield left[x[few]], left[y[few]], none, none > 0
            later = later[had[later] <= named]
        k += 1
        later = later[start[later] + k < later]
    more = had > named
    crowded = np.zeros(len(left) + 1, bool)
    crowded[start[more]] = True
    members = np.flatnonzero(crowded[start])
    yield left[members], np.full(len(members), -1), word[left[members]].astype(np.int64), more[members]


def together(parts: Iterator[tuple[np.ndarray, ...]], least: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """Small tuples of columns joined to larger ones."""
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for part in parts:
        kept.append(part)
        rows += len(part[0])
        if rows >= least:
            yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))
            kept, rows = [], 0
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def place_of(docs: DataFrame, doc_id: str, text: str) -> Column:
    """The number that orders documents: an integer id itself, a hash of any other; without an id a hash of the text, after all others."""
    whole = docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long")
    own = F.col(doc_id).cast("long") if whole else F.shiftright(F.xxhash64(F.col(doc_id).cast("string")), 2)
    return F.when(F.col(doc_id).isNotNull(), own).otherwise(F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62)))


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The lines that go: (doc, line), line counting from 0 in its document."""
    if least_words < 1:
        raise ValueError("a line without words is not compared")
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(rarity(docs, text, least_words))
    buckets = 4 * width(spark)
    texts = spread(docs.select(place_of(docs, doc_id, text).alias("doc"), F.col(text).alias("text")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            columns = joined(gathered)
            # Of copies of a set that are gathered, only the earliest needs to meet others.
            first = earliest(columns)
            copy = np.flatnonzero(~first & (columns[_PLACE] == 0))
            sent = np.flatnonzero(first)
            bucket = (columns[0][sent] % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = [(int(bucket[p[0]]), sent[p], False) for p in np.split(order, cuts)]
            if len(copy):
                parts.append((int(columns[1][copy[0]] % buckets), copy, True))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([_pack(columns, p) for _, p, _ in parts], pa.binary()), pa.array([c for *_, c in parts])], ["bucket", "data", "copies"])

        for batch in bounded(batches):
            ids = batch.column(0).to_numpy()
            for sets in line_sets(*text_bytes(batch.column(1)), least_words):
                gathered.append(postings(sets, ids, counts.value))
            if sum(len(g[0]) for g in gathered) > GATHER:
                yield out()
        if gathered:
            yield out()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc, line, by_doc, by_line, word, more):  # noqa: ANN001, ANN202
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line), by_doc, by_line, word, pa.array(more)], ["doc", "line", "by_doc", "by_line", "word", "more"])

        def search(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            columns = _unpack(blobs)
            _, doc, line, *_ = columns
            for x, y, word, more in together(meet(columns, NAMED)):
                yield rows(doc[x], line[x], pa.array(doc[y], mask=y < 0), pa.array(line[y], mask=y < 0), pa.array(word, mask=word < 0), more)

        now, blobs = None, []
        for batch in bounded(batches):
            for bucket, data, copies in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if copies:
                    _, doc, line, *_ = _unpack([data])
                    none = np.ones(len(doc), bool)
                    yield rows(doc, line, pa.array(doc, mask=none), pa.array(line, mask=none), pa.array(doc, mask=none), ~none)
                    continue
                if bucket != now and blobs:
                    yield from search(blobs)
                    blobs = []
                now = bucket
                blobs.append(data)
        if blobs:
            yield from search(blobs)

    sent = texts.mapInArrow(send, "bucket int, data binary, copies boolean")
    dealt = sent.repartition(width(spark), "bucket").sortWithinPartitions("bucket")
    met = saved(dealt.mapInArrow(find, "doc long, line int, by_doc long, by_line int, word long, more boolean").distinct())
    at = ["doc", "line"]
    gone = met.filter("by_doc IS NULL AND word IS NULL").select(at)
    pairs = saved(met.filter("by_doc IS NOT NULL").join(gone, at, "left_anti").select("doc", "line", "by_doc", "by_line"))
    members = met.filter("word IS NOT NULL").select("doc", "line", "word", "more")
    ends = pairs.select(at).unionByName(pairs.select(F.col("by_doc").alias("doc"), F.col("by_line").alias("line")))
    similar = saved(verified(saved(sets_of(texts, ends, least_words)), pairs).unionByName(gone).distinct())
    open_ = members.filter("more").join(similar, at, "left_anti").select("doc", "line", "word", F.lit(True).alias("open"))
    crowds = saved(members.join(open_.select("word").distinct(), "word", "left_semi").join(open_, ["word", *at], "left").select("word", "doc", "line", F.coalesce("open", F.lit(False)).alias("open")))
    if crowds.isEmpty():
        return similar
    return saved(similar.unionByName(compared(sets_of(texts, crowds.select(at), least_words), crowds)).distinct())


def sets_of(texts: DataFrame, lines: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The sets of some lines (doc, line): (at, no, words), more than once where rows share an id."""
    wanted = lines.groupBy("doc").agg(F.collect_set("line").alias("lines")).withColumnRenamed("doc", "of")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, at = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            lines = batch.column(2).to_pylist()
            keys = np.sort(np.concatenate([np.int64(k) << 32 | np.array(own, np.int64) for k, own in enumerate(lines)]))
            for found in line_sets(raw, at, least):
                own = found.doc.astype(np.int64) << 32 | found.line
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == own)
                if len(hit):
                    start = found.start
                    words = [found.words[start[k] : start[k] + found.size[k]].view(np.int64) for k in hit]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found.doc[hit]]), pa.array(found.line[hit].astype(np.int32)), pa.array(words, pa.list_(pa.int64()))], ["at", "no", "words"])

    # The lists of lines are the small side; a hash of them spares the sort of all texts.
    return texts.join(wanted.hint("shuffle_hash"), F.col("doc") == F.col("of")).select("doc", "text", "lines").mapInArrow(sets, "at long, no int, words array<long>")


def verified(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (doc, line, by_doc, by_line), the (doc, line) whose sets are similar enough."""
    over, under = SIMILARITY
    both = pairs.join(words.select(F.col("at").alias("doc"), F.col("no").alias("line"), F.col("words").alias("x")), ["doc", "line"])
    both = both.join(words.select(F.col("at").alias("by_doc"), F.col("no").alias("by_line"), F.col("words").alias("y")), ["by_doc", "by_line"])
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * (over + under) >= over * (F.size("x") + F.size("y"))).select("doc", "line")


def compared(words: DataFrame, crowds: DataFrame) -> DataFrame:
    """Of lines (word, doc, line, open) under words that very many share, the open ones with a similar earlier line there.

    Pairs are never listed: a word's lines are cut into blocks of about MEET lines, each block of open lines meets each block
    of all in a task of its own, and an open line counts its words in the earlier ones.
    """
    over, under = SIMILARITY

    def check(table: pa.Table) -> pa.Table:
        line, doc, asks = (table.column(c).to_numpy() for c in ("line", "doc", "asks"))
        lists = table.column("words").combine_chunks()
        sizes, starts = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        _, word = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        order = np.lexsort((line, doc))
        there = order[~asks[order]]
        there = there[np.append(True, (np.diff(doc[there]) != 0) | (np.diff(line[there]) != 0))[: len(there)]]  # each place once
        asking = np.flatnonzero(asks)
        both = np.concatenate((there, asking))
        known = np.arange(len(both)) < len(there)
        order = np.lexsort((known, line[both], doc[both]))  # a line comes before its own place
        earlier = np.zeros(len(both), np.int64)
        earlier[order] = np.cumsum(known[order])
        own = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in there]) if len(there) else np.zeros(0, int)
        owner = np.repeat(np.arange(len(there)), sizes[there])
        by_word = np.argsort(word[own], kind="stable")
        edge = np.searchsorted(word[own][by_word], np.arange(word.max(initial=-1) + 2))
        hits = []
        for x, n in zip(asking, earlier[len(there) :], strict=True):
            mine = word[starts[x] : starts[x] + sizes[x]]
            seen = np.concatenate([owner[by_word[edge[w] : edge[w + 1]]] for w in mine])
            common = np.bincount(seen[seen < n], minlength=1)[: max(n, 1)]
            if n and (common * (over + under) >= over * (sizes[x] + sizes[there][: len(common)])).any():
                hits.append(x)
        return table.select(["doc", "line"]).take(pa.array(hits, pa.int64()))

    rows = crowds.join(words, (F.col("doc") == F.col("at")) & (F.col("line") == F.col("no"))).select("word", "doc", "line", "open", "words")
    counts = saved(crowds.groupBy("word").agg(F.ceil(F.count_if("open") / MEET).alias("askers"), F.ceil(F.count("*") / MEET).alias("blocks"))).withColumnRenamed("word", "of")
    sized = rows.join(counts, F.col("word") == F.col("of"))
    block = lambda n: F.pmod(F.xxhash64("doc", "line"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    asking = sized.filter("open").select("word", block("askers").alias("i"), each("blocks").alias("j"), "doc", "line", F.lit(True).alias("asks"), "words")
    there = sized.select("word", each("askers").alias("i"), block("blocks").alias("j"), "doc", "line", F.lit(False).alias("asks"), "words")
    return asking.unionByName(there).groupBy("word", "i", "j").applyInArrow(check, "doc long, line int")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with text without the lines that go, the rest joined by line feeds as before; all columns and rows stay.

    A text may end up empty; a null text stays null. Documents come in order of an integer id, or of a hash of any other;
    those without an id come last, by a hash of the text. Rows that share an id, or have none and one text, count as
    one place, so they do not remove each other's lines. Blank lines stay, and so do lines of fewer than `least_words`
    distinct words. Extra columns may have any names. An empty table gives an empty result.
    """
    gone = removed_lines(docs, doc_id=doc_id, text=text, least_words=least_words).groupBy("doc").agg(F.collect_set("line").alias("gone"))
    named = gone.select(F.col("doc").alias("__lines_doc"), F.col("gone").alias("__lines_gone"))
    marked = F.col("__lines_gone")

    def without(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), marked), lambda k: F.get(lines, k)), "\n")

    # As an element of an array a text's lines are split once, and not anew for each line that stays.
    clean = F.when(marked.isNull(), docs[text]).otherwise(F.get(F.transform(F.array(F.split(docs[text], "\n", -1)), without), F.lit(0)))
    joined = docs.join(named.hint("shuffle_hash"), place_of(docs, doc_id, text) == F.col("__lines_doc"), "left")
    return joined.select(*(clean.alias(c) if c == text else docs[c] for c in docs.columns))
