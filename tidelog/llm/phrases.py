"""Phrase collocations by pivot partitioning.

Each occurrence of a phrase belongs to one word of it: the rarest, and of equally rare ones the
leftmost. Around each word that can be such a pivot, the text is rewritten to the fragment that
phrases of this pivot can reach: it ends at rarer words and at the ends of a piece. Fragments are
counted where they are read, routed to their pivot, and mined there, each pivot by itself; only
phrases that it owns are counted, so most rare phrases end where they are mined.

Rarity comes from a table of bounded size that sums the counts of words by hash. It never tells a
word to be rarer than it is, so no phrase is lost by it, and all counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, saved, spread, width

#: Words of a phrase at most.
LONGEST = 4
_REACH = LONGEST - 1
_SKIP, _BREAK = 0, 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


@dataclass(frozen=True)
class Limits:
    """What a task keeps in hand; results do not depend on it."""

    #: Entries of the table of rarities (8 MB), a power of two.
    slots: int = 1 << 21
    #: Words, fragments that are counted together, fragments that are mined together, bytes of text that are split together.
    vocabulary: int = 1 << 19
    pending: int = 1 << 20
    mined: int = 1 << 18
    block: int = 4 << 20
    #: A pivot with more occurrences than this part of a partition's share of all words is salted.
    part: int = 4


LIMITS = Limits()


def _texts(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, bytes]]:
    """Rows (lang, text as bytes) -> blocks of lower-cased text of one language; pieces are parted by line feeds."""
    for batch in bounded(batches):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            raw, k = b"\n".join(texts).translate(_LOWER), 0
            while k < len(raw):
                stop = raw.find(b"\n", k + block)
                stop = len(raw) if stop < 0 else stop
                yield lang, raw[k:stop]
                k = stop


def _count(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """The words of each language, counted."""
    tally: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in tally.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        tally.clear()

    for lang, raw in _texts(batches, limits.block):
        tally.setdefault(lang, Counter()).update(raw.split())
        if sum(map(len, tally.values())) > limits.vocabulary:
            yield from flush()
    yield from flush()


class Vocabulary(dict):
    """The words of one language that a task has met: word -> number, with its hash and its rarity."""

    def __init__(self, lang: str, table: np.ndarray, least: int) -> None:
        super().__init__({b"": _SKIP, b"\n": _BREAK})
        self.lang, self.table, self.least = lang, table, least
        self.seed = xxhash.xxh64_intdigest(lang, seed=42)
        self.words, self.hash = [b"", b"\n"], [0, 0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hash.append(xxhash.xxh64_intdigest(word, seed=self.seed))
        return number

    def ready(self) -> None:
        """Arrays over all words so far: hashes, counts from the table, and order (rarer is smaller; -1 ends a fragment)."""
        self.hashes = np.array(self.hash, np.uint64)
        self.counts = self.table[(self.hashes & np.uint64(len(self.table) - 1)).astype(np.int64)].astype(np.int64)
        self.counts[:2] = 0
        self.order = np.where(self.counts >= self.least, self.counts << 32 | (self.hashes >> np.uint64(32)).astype(np.int64), -1)


def _fragments(raw: bytes, words: Vocabulary) -> np.ndarray:
    """A row for each pivot that has neighbours: the words from _REACH before it to _REACH after it, -1 where the fragment ended."""
    tokens = raw.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
    words.ready()
    ids = np.concatenate(([_BREAK] * _REACH, ids[ids != _SKIP], [_BREAK] * _REACH)).astype(np.int32)
    order = words.order[ids]
    pivot = np.flatnonzero(order >= 0)
    own = order[pivot]
    out = np.full((len(pivot), 2 * _REACH + 1), -1, np.int32)
    out[:, _REACH] = ids[pivot]
    for step in (1, -1):
        goes_on = np.ones(len(pivot), bool)
        for j in range(step, step * LONGEST, step):
            other = order[pivot + j]
            goes_on &= other >= own if step > 0 else other > own
            out[goes_on, _REACH + j] = ids[pivot[goes_on] + j]
    return out[(out[:, _REACH - 1] >= 0) | (out[:, _REACH + 1] >= 0)]


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of small integers, with the sums of their counts."""
    if not len(rows):
        return np.zeros(0, np.int64), counts
    mixed = ((rows.astype(np.int64) + 2).astype(np.uint64) * _ODD[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed * _ODD[0], kind="stable")
    near = rows[order]
    same = (near[1:] == near[:-1]).all(axis=1)
    mixed = mixed[order]
    if ((mixed[1:] == mixed[:-1]) & ~same).any():  # two rows with one hash may lie between each other's copies
        order = np.lexsort(rows.T)
        near = rows[order]
        same = (near[1:] == near[:-1]).all(axis=1)
    starts = np.flatnonzero(np.append(True, ~same))
    return order[starts], np.add.reduceat(counts[order], starts)


def _joined(words: pa.Array, rows: np.ndarray) -> pa.Array:
    """The words of each row, with spaces between; numbers below 0 are none."""
    columns = [words.take(pa.array(np.maximum(c, 0), mask=c < 0)) for c in rows.T]
    return pc.binary_join_element_wise(*columns, pa.scalar(" ", words.type), null_handling="skip")


def _deal(batches: Iterator[pa.RecordBatch], table: np.ndarray, least: int, share: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Counted fragments with the pivot's number and salt in one long: (deal, final, lang, words, at, n)."""
    known: dict[str, Vocabulary] = {}
    step = max(1, limits.pending // 8)
    pending: dict[str, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in pending.items():
            words, rows = known[lang], np.concatenate(parts)
            words.ready()
            first, n = summed(rows, np.ones(len(rows), np.int64))
            for low in range(0, len(first), step):
                own = rows[first[low : low + step]]
                pivot = own[:, _REACH]
                salts = 1 + words.counts[pivot] // share
                whole = (np.where(own >= 0, words.hashes[np.maximum(own, 0)], np.uint64(0)) * _ODD).sum(axis=1, dtype=np.uint64)
                salt = (whole >> np.uint64(24)) % salts.astype(np.uint64)
                deal = ((words.hashes[pivot] + salt * _ODD[1]) * _ODD[0]).view(np.int64)
                text = _joined(pa.array(words.words, pa.binary()), own).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(salts == 1), pa.repeat(lang, len(own)), text, pa.array((own[:, :_REACH] >= 0).sum(axis=1).astype(np.int32)), pa.array(n[low : low + len(own)])], ["deal", "final", "lang", "words", "at", "n"])
        pending.clear()
        if sum(map(len, known.values())) > limits.vocabulary:
            known.clear()

    for lang, raw in _texts(batches, limits.block):
        words = known[lang] if lang in known else known.setdefault(lang, Vocabulary(lang, table, least))
        pending.setdefault(lang, []).append(_fragments(raw, words))
        if sum(len(x) for parts in pending.values() for x in parts) > limits.pending:
            yield from flush()
    yield from flush()


def _owned(held: pa.Table, least: int) -> pa.RecordBatch:
    """The phrases that the pivots of whole groups of fragments own: (lang, phrase, size, n). A final count below `least` goes."""
    held = held.combine_chunks()
    column = lambda name: held.column(name).combine_chunks()
    lists, langs = pc.split_pattern(column("words"), " "), column("lang").dictionary_encode()
    offsets, flat = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    ids, at, n, final = flat.indices.to_numpy().astype(np.int32), column("at").to_numpy(), column("n").to_numpy(), column("final").to_numpy(zero_copy_only=False)
    right, lang = np.diff(offsets) - 1 - at, langs.indices.to_numpy()
    rows, counts, ends = [], [], []
    for before in range(LONGEST):
        for after in range(LONGEST - before):
            own = np.flatnonzero((at >= before) & (right >= after)) if before + after else []
            if not len(own):
                continue
            row = np.full((len(own), LONGEST + 1), -1, np.int32)
            row[:, 0] = lang[own]
            for j in range(before + after + 1):
                row[:, j + 1] = ids[offsets[own] + at[own] - before + j]
            rows.append(row)
            counts.append(n[own])
            ends.append(final[own])
    rows, counts, ends = np.concatenate(rows), np.concatenate(counts), np.concatenate(ends)
    first, total = summed(rows, counts)
    kept = ~ends[first] | (total >= least)
    rows, total = rows[first[kept]], total[kept]
    words = flat.dictionary.cast(pa.string())
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(rows[:, 0])), _joined(words, rows[:, 1:]), pa.array((rows[:, 1:] >= 0).sum(axis=1).astype(np.int32)), pa.array(total)], ["lang", "phrase", "size", "n"])


def _mine(batches: Iterator[pa.RecordBatch], least: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Fragments in order of deal. A pivot's group is mined whole; groups of salted ones may be mined in parts, as they are summed later."""
    held, rows = [], 0

    def take(everything: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        table = pa.Table.from_batches(held)
        deal = table.column("deal").to_numpy()
        stop = len(deal) if everything or not table.column("final")[-1].as_py() else int(np.searchsorted(deal, deal[-1]))
        if stop:
            yield _owned(table.slice(0, stop), least)
        rest = table.slice(stop)
        held, rows = rest.to_batches(), len(rest)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= limits.mined:
            yield from take(False)
    if rows:
        yield from take(True)


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def counted(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, n), and the phrases of 2 to LONGEST words that are there `least` times or more (lang, phrase, size, n)."""
    spark = docs.sparkSession
    said = spread(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")))
    words = saved(said.mapInArrow(lambda x: _count(x, limits), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    slot = F.pmod(F.xxhash64("lang", "word"), F.lit(limits.slots)).cast("int").alias("slot")
    full = words.groupBy(slot).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    table = np.zeros(limits.slots, np.int32)
    table[full.column("slot").to_numpy()] = np.minimum(full.column("n").to_numpy(), (1 << 30) - 1)
    rare = spark.sparkContext.broadcast(table)
    total = words.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // (limits.part * width(spark)))
    fragments = said.mapInArrow(lambda x: _deal(x, rare.value, least, share, limits), "deal long, final boolean, lang string, words string, at int, n long")
    dealt = fragments.repartition(width(spark), "deal").sortWithinPartitions("deal")
    mined = dealt.mapInArrow(lambda x: _mine(x, least, limits), "lang string, phrase string, size int, n long")
    return words, saved(mined.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, cover: int = 80, top: int = 2000, limits: Limits = LIMITS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score (all numbers long).

    Words are runs without blanks and tabs, lower-cased in A-Z; phrases of 2 to LONGEST words never pass one of .,;:!? or a
    line's end. a counts a phrase, l and r the two sides of the cut after k words with the least score
    floor(2000000 * a / (l + r)), the smallest k of equal ones; n counts all words of the language. Phrases with a < least
    are none; one that lies in a longer one with 100 * count >= cover * a is left out. Order: score and a descending, phrase.

    A null text is empty; a null language is `und`, with those that are called so. Repeated rows count each. Other columns
    are not read. A piece of text, between two ends, must fit into a task's memory.
    """
    spark = docs.sparkSession
    words, grams = counted(docs, text=text, lang=lang, least=least, limits=limits)
    counts = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n").unionByName(grams.select("lang", "phrase", "n"))
    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", F.col("n").alias("a"), "k", first.alias("first"), F.substring("phrase", F.length(first) + 2, F.length("phrase")).alias("rest"))
    left, right = (counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(short)) for name, short in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    inside = grams.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * cover))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(width(spark))).alias("bucket"))
    # A language's phrases are ranked in buckets first, so that its last ranking has `top` rows of each at most.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM pieces WHERE len(w) > 0
), f AS (
  SELECT lang, size, array_to_string(w[s:s + size - 1], ' ') AS phrase, count(*) AS f FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE s + size - 1 <= len(w) GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
frequent AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, k, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT c.lang, c.f, array_to_string(c.w[s:s + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(2, size)) AS m FROM frequent WHERE size > 2) c, (SELECT unnest([1, 2, 3]) AS s) WHERE s + m - 1 <= c.size)
  GROUP BY lang, phrase
), ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
