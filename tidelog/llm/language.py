"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of up to three letters, words padded with a
space, in order of frequency. A document's language is the one whose profile has the smallest
out-of-place distance to the document's own: the sum over its n-grams of the difference of ranks,
or the length of a profile where the n-gram is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, held_out

#: Length of a profile.
RANKS = 300
#: Bits of a code point in an n-gram's code.
BITS = 21
#: Letters that are turned into n-grams at a time, so that long texts take bounded memory.
BLOCK = 1 << 20
#: N-grams that a task gathers before it merges them.
GATHER = 1 << 21


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes of a whole text's n-grams and how often each occurs; none if it has no letter."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[points]
    keep = known.copy()
    keep[1:] |= known[:-1]  # of a run of other characters only the first stays, as a space
    points = np.where(known, points, np.uint32(32))[keep].astype(np.uint64)
    if not points.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space, shift = np.uint64(32), np.uint64(BITS)
    points = np.pad(points, (int(points[0] != space), int(points[-1] != space)), constant_values=32)
    for at in range(0, len(points) - 1, BLOCK):  # blocks overlap by two, and n-grams count where they begin
        a = points[at : at + BLOCK]
        b = points[at + 1 : at + 1 + BLOCK]
        c = points[at + 2 : at + 2 + BLOCK]
        two = a[: len(b)] << shift | b
        middle = b[: len(c)] != space
        three = (two[: len(c)] << shift | c)[middle]
        found.append(merged(np.concatenate((a[a != space], two, three))))
    return found[0] if len(found) == 1 else merged(*map(np.concatenate, zip(*found, strict=True)))


def merged(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with the sums of their counts."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    if counts is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The codes of the most frequent n-grams in order of rank; the smaller code is first among equals."""
    return codes[np.argsort(-counts, kind="stable")[:RANKS]]


class Profiles:
    """The profiles of all languages as one table: a row for each n-gram, a column for each language."""

    def __init__(self, by_lang: dict[str, list[int]]) -> None:
        self.langs = sorted(by_lang)
        self.codes = np.array(sorted({c for codes in by_lang.values() for c in codes}), np.uint64)
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(by_lang[lang], np.uint64)), k] = np.arange(len(by_lang[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - its distance as a share of the largest one); ties go to the first name."""
        own = top(*grams(text)) if text else ()
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        rank = self.rank[at]
        out = np.where(rank < 0, RANKS, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (RANKS * len(own)))


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Count the n-grams of every document that is not held out and has a language; keep each language's most frequent.

    All such documents count, whole. What reaches the driver is RANKS rows for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list] = {}

        def out(name: str) -> pa.RecordBatch:
            codes, counts = merged(*map(np.concatenate, zip(*gathered.pop(name), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])

        for batch in bounded(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = gathered.setdefault(name, [])
                own.append(grams(body))
                if len(own) >= 256:
                    own[:] = [merged(*map(np.concatenate, zip(*own, strict=True)))]
            for name in [n for n, own in gathered.items() if sum(len(c) for c, _ in own) > GATHER]:
                yield out(name)
        for name in list(gathered):
            yield out(name)

    seen = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(lang, text)
    sums = seen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RANKS).collect()
    by_lang: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        by_lang.setdefault(row["lang"], []).append(row["code"])
    return Profiles(by_lang)


def identify(docs: DataFrame, profiles: Profiles, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of each whole text: doc_id, held_out, lang_pred, score (0 to 1).

    A text that is null or has no letter is "und" with score 0, as is every text if nothing was learned. Equal rows
    give equal rows. A null id counts as the empty text for held_out. Other columns are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(profiles)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [shared.value.nearest(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
