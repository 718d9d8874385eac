"""A quality classifier: a generalised additive model with pairwise interactions.

Boosting visits the features in turn, again and again; each visit fits a tree of few leaves on one
feature to the gradients and adds it to that feature's table of bins. Then the pairs of features
whose joint bins explain most of what is left are boosted in the same way, with trees that cut
once on each of the two. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, held_out, text_bytes

#: At about most so many labelled documents are learned from, picked by a hash of the id.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 64, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, DAMPING = 150, 80, 0.1, 2.0
LEAST_SCORE = 0.3

#: Classes of bytes: other, upper case, lower case, digit, space, line feed, common marks, other marks, above ASCII.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 7
_KINDS[[ord(c) for c in ".,;:'\"-()?!"]] = 6
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 8
_KINDS[[32, 9, 11, 12, 13]] = 4
_KINDS[10] = 5
FEATURES = (
    "log_bytes", "upper", "digits", "spaces", "line_feeds", "common_marks", "other_marks", "above_ascii", "exclamations",
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "commonest_word", "short_words",
    "marked_words", "distinct_lines", "line_length", "longest_word", "full_stops",
)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text; nulls count as empty."""
    raw, at = text_bytes(texts)
    n = len(at) - 1
    shares = np.zeros((n, 11))
    out = np.zeros((n, len(FEATURES)))
    for i in range(n):
        one = raw[at[i] : at[i + 1]]
        if not len(one):
            continue
        bytes_ = np.bincount(one, minlength=256)
        shares[i, :9] = np.bincount(_KINDS, bytes_, 9) / len(one)
        shares[i, 9], shares[i, 10] = bytes_[33] / len(one), bytes_[46] / len(one)
        text = one.tobytes()
        words, lines = text.split(), text.split(b"\n")
        count = max(1, len(words))
        seen: dict[bytes, int] = {}
        get = seen.get
        for w in words:
            seen[w] = get(w, 0) + 1
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        out[i, 9:] = (
            np.log1p(len(words)), lengths.mean(), len(seen) / count, sum(a == b for a, b in pairwise(words)) / count,
            max(seen.values(), default=0) / count, (lengths <= 3).mean(), sum(not w[-1:].isalpha() and w[-1] < 128 for w in seen) / max(1, len(seen)),
            len(set(lines)) / len(lines), np.log1p(len(one) / len(lines)), np.log1p(lengths.max()), shares[i, 10],
        )
    out[:, 0] = np.log1p(np.diff(at))
    out[:, 1:9] = shares[:, [1, 3, 4, 5, 6, 7, 8, 9]]
    return out


@dataclass
class Model:
    """Edges of the bins of each feature, their tables, and the tables of pairs; start is the score of no evidence."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        for k, table in enumerate(self.tables):
            total += table[bins[k]]
        for (a, b), table in self.pairs.items():
            total += table[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: (gain, first bin of the right side)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + DAMPING) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + DAMPING) - g.sum() ** 2 / (h.sum() + DAMPING)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(RATE * g.sum() / (h.sum() + DAMPING))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values for each bin: cut where the gain is largest, up to so many leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts)]
        gain, at, k = max(cuts)
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = _leaf(g[a:b], h[a:b])
    return step


def _pair_cuts(g: np.ndarray, h: np.ndarray) -> tuple[float, int, list[int]]:
    """The best tree that cuts on rows and then each side on columns: (gain, row of the cut, columns of the two cuts).

    All cuts are tried together, from sums over the corners of the joint histogram: a cut of rows that explains nothing by
    itself still counts with the best cuts of its sides. A cut at 0 leaves a side whole.
    """
    corner_g, corner_h = (np.pad(v.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for v in (g, h))
    gains, columns = 0.0, []
    for sides in ((corner_g[:-1], corner_h[:-1]), (corner_g[-1:] - corner_g[:-1], corner_h[-1:] - corner_h[:-1])):
        left_g, left_h = (v[:, :-1] for v in sides)
        right_g, right_h = (v[:, -1:] - v[:, :-1] for v in sides)
        gain = left_g**2 / (left_h + DAMPING) + right_g**2 / (right_h + DAMPING)
        columns.append(gain.argmax(axis=1))
        gains = gains + gain.max(axis=1)
    row = int(np.argmax(gains))
    return float(gains[row] - g.sum() ** 2 / (h.sum() + DAMPING)), row, [int(c[row]) for c in columns]


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the better of the trees that cut first on the one or the other feature of a pair."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, row, columns = _pair_cuts(a, b)
        if gain > best[0]:
            step = np.zeros_like(a)
            for rows, column in zip((slice(0, row), slice(row, None)), columns, strict=True):
                for part in (slice(0, column), slice(column, None)):
                    step[rows, part] = _leaf(a[rows, part], b[rows, part])
            best = (gain, step.T if turned else step)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from a bounded sample. With no rows, or one class only, every score is the smoothed share of ones."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(start=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [(np.arange(len(t)) * PAIR_BINS // len(t)) for t in model.tables]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = gradients()
            size = len(model.tables[k])
            step = _tree(np.bincount(own, g, size), np.bincount(own, h, size))
            model.tables[k] += step
            total += step[own]
    joint = {(a, b): model.coarse[a][bins[a]] * PAIR_BINS + model.coarse[b][bins[b]] for a, b in combinations(range(x.shape[1]), 2)}

    def squares(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradients()
        return tuple(np.bincount(own, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))

    chosen = sorted(joint, key=lambda p: (-_pair_tree(*squares(joint[p]))[0], p))[:PAIRS]
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            _, step = _pair_tree(*squares(joint[p]))
            model.pairs[p] += step
            total += step.ravel()[joint[p]]
    return model


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from labelled documents that are not held out, about `sample` of them at most.

    Which ones follows from a hash of the id alone. Null ids and labels other than 0 and 1 are passed over; an id that
    is labelled more than once counts with each label, and a document that is there more than once with each text.
    """
    usable = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isin(0, 1) & ~held_out(doc_id)).select(F.col(doc_id).alias("labelled"), F.col(quality).cast("double").alias("y"))
    share = min(1.0, sample / max(1, usable.count()))
    part = usable.filter(F.pmod(F.xxhash64(F.col("labelled").cast("string"), F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = docs.join(F.broadcast(part), F.col(doc_id) == F.col("labelled")).select("y", F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], ["y", *FEATURES])

    rows = picked.mapInArrow(run, ", ".join(f"{c} double" for c in ("y", *FEATURES))).toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy()  # the order of rows must not matter
    return fit(rows[:, 1:], rows[:, 0])


def classify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_SCORE, keep: bool = False) -> DataFrame:
    """Score each whole text: doc_id, held_out, score, predicted (1 from `least` on).

    A null text is scored as the empty one. Equal rows give equal rows; a null id counts as the empty text for
    held_out. keep=True returns the columns of docs for the documents with predicted 1 instead. Other columns are not
    read, or, with keep, pass as they are. Empty in, empty out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    if keep:
        at = docs.columns.index(text)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches):
                yield batch.filter(pa.array(shared.value.scores(features(batch.column(at))) >= least))

        return docs.mapInArrow(kept, docs.schema)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            score = shared.value.scores(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
