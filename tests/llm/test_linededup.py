import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import linededup, registry
from tidelog.llm.common import table, text_bytes

SF = "/root/testdata/sf0.001"


def slow(rows, least=1):
    """Texts by id after each line that is similar to an earlier one has gone."""
    seen, out, by_word = [], {}, {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.encode().lower().split())
            if len(words) >= least:
                near = {k for w in words for k in by_word.get(w, ())}
                hit = any(5 * len(words & seen[k]) >= 4 * len(words | seen[k]) for k in near)
                for w in words:
                    by_word.setdefault(w, []).append(len(seen))
                seen.append(words)
                if hit:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_same_as_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = slow([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == want


def variants(n):
    random.seed(5)
    base = [f"w{k}" for k in range(40)]
    for _ in range(n):
        yield " ".join(random.choice(["q%d" % random.randrange(30), w]) if random.random() < 0.3 else w for w in base)


@pytest.mark.parametrize("named", [1, 4])
def test_a_large_group_of_similar_lines(spark, monkeypatch, named):
    monkeypatch.setattr(linededup, "NAMED", named)
    monkeypatch.setattr(linededup, "CHUNK", 300)
    lines = list(variants(400))
    rows = [(k, "\n".join(lines[k * 4 : k * 4 + 4] + ["The common line of all the documents", "short line"])) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == slow(rows)


def test_sets_of_lines(monkeypatch):
    texts = ["", "a b c d e a\n\nF g h i\tj k", None, "x", "p q r s t", "\n" * 5 + "v w x y z é\x0bA a"]
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(linededup, "CHUNK", chunk)
        found = [(int(d), int(n), int(z)) for s in linededup.line_sets(*text_bytes(pa.array(texts)), 5) for d, n, z in zip(s.doc, s.line, s.size, strict=True)]
        assert found == [(1, 0, 5), (1, 2, 6), (4, 0, 5), (5, 5, 7)]
    assert np.isin(1, 1)


def test_gathered_columns_are_not_held_twice():
    tracemalloc.start()
    gathered = [[np.full(10_000, k, np.uint64) for _ in range(12)] for k in range(20)]
    size = tracemalloc.get_traced_memory()[0]
    columns = linededup.joined(gathered)
    assert tracemalloc.get_traced_memory()[1] < 1.2 * size
    tracemalloc.stop()
    assert all((c == np.repeat(np.arange(20), 10_000)).all() for c in columns) and not gathered


def test_edges_of_the_input(spark):
    long = "\n".join(f"{k} {k + 1} {k + 2} {k + 3} {k + 4}" for k in range(20_000)) + "\n" + "y" * 100_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two three four five", "c"), (3, "one two three four five", "d"), (4, "x\nFive one two three four", None), (7, long, "e"), (8, long, "f"), (9, "same row of five words", "g"), (9, "same row of five words", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted(map(tuple, linededup.dedup_lines(docs).collect()), key=str)
    want = [(1, None, "a"), (2, "", "b"), (None, "", "c"), (3, "one two three four five", "d"), (4, "x", None), (7, long, "e"), (8, "", "f"), (9, "same row of five words", "g"), (9, "same row of five words", "g")]
    assert got == sorted(want, key=str)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_no_words_alone(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n\t")], "doc_id long, text string")
    for least in (1, 5):
        assert sorted(map(tuple, linededup.dedup_lines(docs, least_words=least).collect())) == [(1, ""), (2, None), (3, " \n\t")]
    short = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(r.text for r in linededup.dedup_lines(short, least_words=5).collect()) == ["a b", "a b"]


def test_any_ids_and_column_names(spark):
    rows = [("x", "one two", 1, "g", 0.5), ("y", "one two", 2, "h", 0.5), (None, "one two\nthree", 3, "i", 0.5), (None, "three", 4, "i", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, gone long, doc string, line double")
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = {r.gone: r.text for r in out.collect()}
    assert sorted([texts[1], texts[2]]) == ["", "one two"]
    assert sum(t.count("three") for t in texts.values()) == 1 and sum(t.count("one") for t in texts.values()) == 1


def test_crowded_words_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(linededup, "NAMED", 1)
    monkeypatch.setattr(linededup, "MEET", 16)
    lines = list(variants(300))
    rows = [(k, "\n".join(lines[k * 3 : k * 3 + 3])) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == slow(rows)


def test_the_query_compares_short_lines_too(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows)
    assert want != slow(rows, 5)
    assert {r.doc_id: r.text for r in registry.QUERIES["op8_lines"](spark, SF).collect()} == want


@pytest.mark.parametrize("named", [1, 4])
def test_lines_of_few_words(spark, monkeypatch, named):
    monkeypatch.setattr(linededup, "NAMED", named)
    random.seed(3)
    lines = [" ".join(random.choice("abcdefg") for _ in range(random.randrange(8))) for _ in range(600)]
    lines += ["第一章　序言", "第一章　序言", "One two three four", "four three two one five", "", "", " \t"]
    rows = [(k, "\n".join(lines[k * 5 : k * 5 + 5])) for k in range(len(lines) // 5 + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow(rows)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == want
    assert sum(t.count("第一章") for t in want.values()) == 1
