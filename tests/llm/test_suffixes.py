import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import suffixes
from tidelog.llm.common import table, text_bytes


def slow(texts, length):
    """(bytes, removed, runs, digest of what stays) of each text."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        runs = sum(c and (not k or not covered[k - 1]) for k, c in enumerate(covered))
        out.append((len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=40), st.data())
def test_sorting_and_common_prefixes(strings, data):
    group = np.array([data.draw(st.integers(0, 2)) for _ in strings])
    old, suffixes.SHALLOW = suffixes.SHALLOW, 8
    try:
        order, common = suffixes.deep_shallow(strings, group)
    finally:
        suffixes.SHALLOW = old
    assert [(group[k], strings[k]) for k in order] == sorted((g, s) for g, s in zip(group, strings, strict=True))
    for before, k, c in zip(order, order[1:], common[1:], strict=False):
        a, b = strings[before], strings[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c == (n if group[before] == group[k] else -1)


@pytest.mark.parametrize("chunk", [1 << 20, 30])
def test_every_window_has_the_anchor_of_its_content(monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    random.seed(1)
    texts = ["".join(random.choice("ab") for _ in range(120)), "", "a" * 90, "abcab" * 30, "short"] * 2
    raw, at = text_bytes(pa.array(texts))
    of = {}
    for core, text, place, low, high in suffixes.anchors(raw, at, 20, 12):
        for c, t, p, a, b in zip(*map(np.ndarray.tolist, (core, text, place, low, high)), strict=True):
            for d in range(a, b + 1):
                assert (t, p - d) not in of
                of[t, p - d] = (c, d)
    assert set(of) == {(t, k) for t, s in enumerate(texts) for k in range(len(s) - 19)}
    by = {}
    for (t, k), anchor in of.items():
        assert by.setdefault(texts[t][k : k + 20], anchor) == anchor


def cases():
    random.seed(4)
    word = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passage, other = word(60), word(45)
    texts = [word(30) + passage + word(25) for _ in range(12)] + [word(5) + passage[k:] + other[: 45 - k] for k in range(20)]
    texts += [passage[:k] + word(9) + other for k in range(0, 60, 7)] + ["z" * 200, "xy" * 70, word(90), None, "", "short", word(400) + other]
    return [*texts, texts[0], texts[0]]


@pytest.mark.parametrize(("hot", "gather", "zone"), [(4096, 8192, 32), (4096, 5, 32), (2, 8192, 4), (3, 10, 5)])
def test_same_as_brute_force(spark, monkeypatch, hot, gather, zone):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "GATHER", gather)
    monkeypatch.setattr(suffixes, "ZONE", zone)
    texts = cases()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, place string")
    got = suffixes.remove_repeats(docs, length=40, reach=24).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == slow(texts, 40)


def test_long_texts_null_ids_and_repeated_rows(spark):
    random.seed(9)
    long = " ".join(str(random.random()) for _ in range(60_000))
    rows = [(1, long), (2, long[200_000:200_500] + "!"), (None, "q" * 399), (None, None), (7, "r" * 401), (8, "same " * 100), (8, "same " * 100), (8, "another text under the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in suffixes.remove_repeats(docs).collect())))
    assert got == sorted(str((i, *w)) for (i, _), w in zip(rows, slow([t for _, t in rows], 400), strict=True))
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_kept_text(spark):
    docs = spark.createDataFrame([(1, "abc" + "0123456789" * 5), (2, "0123456789" * 5 + "def")], "doc_id long, text string")
    assert [r.kept_text for r in suffixes.remove_repeats(docs, length=40, reach=24, keep=True).orderBy("doc_id").collect()] == ["abc", "def"]


def test_very_many_equal_rows(spark):
    """Rows of one text are compared once, however many there are."""
    random.seed(2)
    text = " ".join(str(random.random()) for _ in range(300))
    rows = [(k, text) for k in range(2000)] + [(2000, text[1000:1600] + "?"), (2001, "tiny"), (2002, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    got = suffixes.remove_repeats(docs).collect()
    assert time.perf_counter() - began < 60
    assert Counter((r.n_bytes, r.n_removed, r.n_spans) for r in got) == {(len(text), len(text), 1): 2000, (601, 600, 1): 1, (4, 0, 0): 2}


def windows(texts, length=400):
    """What op3 must return for texts, by counting all windows of so many bytes by their hash."""
    seen = Counter()
    for raw in texts.values():
        seen.update(xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(len(raw) - length + 1))
    out = {}
    for doc, raw in texts.items():
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            if seen[xxhash.xxh3_64_intdigest(raw[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        removed = np.cumsum(gone)[:-1] > 0
        left = np.frombuffer(raw, np.uint8)[~removed].tobytes()
        spans = int((np.diff(np.concatenate(([0], removed.astype(np.int8)))) == 1).sum())
        out[doc] = (len(raw), int(removed.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def test_planted_passages_in_a_whole_table(spark):
    """Passages of 60 words in two to forty documents, copies, and near copies with a word changed, among all documents of a table."""
    random.seed(12)
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(5, 9)))
    clean = [(10_000 + k, " ".join(word() for _ in range(300))) for k in range(40)]
    planted, k = [], 20_000
    for times in (2, 2, 3, 5, 40):
        passage = " ".join(word() for _ in range(60))
        for _ in range(times):
            planted.append((k, " ".join(word() for _ in range(50)) + " " + passage + " " + " ".join(word() for _ in range(50))))
            k += 1
    whole = " ".join(word() for _ in range(250)).split()
    copies = [(30_000 + k, " ".join(whole)) for k in range(4)] + [(31_000 + k, " ".join(whole[: 50 * k] + [word()] + whole[50 * k + 1 :])) for k in range(5)]
    data = rows + clean + planted + copies
    random.shuffle(data)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame).collect()}
    assert got == windows({doc: (text or "").encode() for doc, text in data})
    assert all(got[doc][1] == 0 for doc, _ in clean)
    assert all(got[doc][1] >= 400 and got[doc][2] == 1 for doc, _ in planted)
    assert all(got[30_000 + k][1] == got[30_000 + k][0] for k in range(4))


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """What counts is bytes and not words: of passages of 60 words, one of 399 bytes stays and one of 400 goes, and n_bytes is the length before."""
    random.seed(21)
    word = lambda n: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for size in (399, 400):
        passage = " ".join([*(word(5) for _ in range(59)), word(size - 59 * 6)])
        assert len(passage) == size and len(passage.split()) == 60
        rows += [(size * 10 + k, f"{word(300)}{k}{passage}{k}{word(300)}") for k in range(2)]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3990: (1001, 0), 3991: (1001, 0), 4000: (1002, 400), 4001: (1002, 400)}
