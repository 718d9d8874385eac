import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from tidelog.llm import simhash
from tidelog.llm.common import table
from tidelog.llm.components import components

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_classes(prints):
    values = np.array(sorted(set(prints.values())), np.uint64)
    root = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    while ((low := np.where(near, root[None], len(values)).min(axis=1)) != root).any():
        root = low
    root = dict(zip(values.tolist(), root.tolist(), strict=True))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    return {i: first[root[p]] for i, p in prints.items()}


def test_fingerprints_of_all_kinds_of_texts():
    texts = ["", None, "A", "a B", "A b\tc\n\nd É", "x " * 2000, "é ß " * 300, " \x0b ", "the End of THE end " * 700]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [slow_print(t) for t in texts]


def test_blocks_of_words_do_not_matter(monkeypatch):
    text = " ".join(str(i * i) for i in range(100))
    whole = simhash.fingerprints(pa.array([text]))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprints(pa.array([text])) == whole


def test_trees_find_every_link(monkeypatch):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(60)]
    x = list({b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(8))) & (1 << 64) - 1 for b in base for _ in range(30)})
    x = np.array(x, np.uint64)
    monkeypatch.setattr(simhash, "SHARD", 100)
    tree = simhash.build(x[::3], len(x))
    met = set()
    for _, home, visit in simhash.route(tree, x):
        both = np.concatenate((home, visit))
        met |= {(min(a, b), max(a, b)) for a in home.tolist() for b in both.tolist() if a != b}
    want = {(a, b) for a in range(len(x)) for b in range(a) if (int(x[a]) ^ int(x[b])).bit_count() <= 3}
    assert {(b, a) for a, b in want} <= met
    monkeypatch.setattr(simhash, "LEAF", 40)
    forest = simhash.Forest(x)
    forest.within(np.arange(len(x)))
    forest.settle()
    slow = slow_classes({i: int(v) for i, v in enumerate(x)})
    assert forest.root.tolist() == [slow[i] for i in range(len(x))]


def test_classes_are_those_of_brute_force(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: slow_print(r.text) for r in rows}
    want = slow_classes(prints)
    for shard, split in ((4096, 1 << 17), (20, 1 << 17), (50, 30)):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "SPLIT", split)
        got = simhash.near_duplicates(docs).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
        assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == docs.columns


def test_edges_of_the_input(spark):
    rows = [(3, None, "x"), (2, "", "y"), (None, "a b c d", "z"), (5, "A B C D", None), (5, "A B C D", None), (9, "b " * 100_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("2", 2), ("3", 2), ("5", 5), ("5", 5), ("9", 9), ("None", 5)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    edges += [(200, 203), (203, 201), (202, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {i: 200 for i in range(200, 204)}
