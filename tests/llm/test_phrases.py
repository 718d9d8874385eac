import re
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from tidelog.llm import phrases, registry
from tidelog.llm.common import table

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            counts.update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in wanted.items():
            inside = (b for q, b in wanted.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def shown(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def documents(seed, n=300, hot=0.3):
    random = np.random.default_rng(seed)
    words = [*"abcdefgh", "Été", "ÉTÉ", "x\x1cy", " ", " ", "of", "THE", "the", "zz\x85", "中", "\x00", *(f"w{i}" for i in range(40))]
    p = 1 / np.arange(1, len(words) + 1)
    joins = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ; ", "\r\n", "\x0b"]
    rows = []
    for i in range(n):
        own = random.choice(words, random.integers(0, 120), p=p / p.sum())
        text = "".join(w + str(j) for w, j in zip(own, random.choice(joins, len(own)), strict=True))
        rows.append(("hot phrase of words " * 30 if random.random() < hot else text, ["en", "en", "und", None, "de"][i % 5]))
    return rows


#: Many collisions in the table, pivots salted, groups mined in parts.
SMALL = phrases.Limits(slots=64, vocabulary=20, pending=256, mined=100, block=200, part=40)


@pytest.mark.parametrize("limits", [phrases.LIMITS, SMALL])
def test_against_brute_force(spark, limits):
    rows = documents(1) + [(None, "en"), ("", "en"), ("", "none"), ("the the the the the " * 5000, "de")]
    data = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(3)
    want = brute(rows, 6)
    assert len(want) > 100 and shown(phrases.collocations(data, least=6, limits=limits)) == want


def test_top_and_thresholds(spark):
    rows = documents(2, 200)
    data = spark.createDataFrame(rows, "text string, lang string")
    assert shown(phrases.collocations(data, least=5, top=7)) == brute(rows, 5, 7)
    assert phrases.collocations(data.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_scores_past_64_bits(spark, monkeypatch):
    big = 3 * 10**18
    grams = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, word string, n long")
    monkeypatch.setattr(phrases, "counted", lambda *_, **__: (words, grams))
    row = phrases.collocations(grams).first()
    assert row.score == 2_000_000 * big // (2 * big + 7) and row.l == big and row.n == 2 * big + 7


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = table(spark, sf_dir, "documents").toArrow()  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({registry.ORACLE_SQL['op12_phrases']})").fetchall()
    got = shown(registry.op12_phrases(spark, sf_dir))
    assert want and got == sorted(want)
    assert all(a[1] + 1 == b[1] for a, b in pairwise(got) if a[0] == b[0])


def test_fragments_end_at_rarer_words():
    words = phrases.Vocabulary("en", np.zeros(1024, np.int32), 1)
    for word, count in {"a": 9, "b": 5, "c": 7, "d": 6}.items():
        number = words[word.encode()]
        words.table[words.hash[number] & 1023] = count
    rows = phrases._fragments(b"c a b a d b c\na rare a", words)
    text = [" ".join(words.words[i].decode() if i >= 0 else "." for i in row) for row in rows]
    assert text == [". . . c a . .", ". c a b a d b", ". . a d . . .", ". a d b c . ."]


def test_rows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "_ODD", np.zeros_like(phrases._ODD))
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], np.int32)
    first, n = phrases.summed(rows, np.array([1, 10, 2, 20, 5]))
    assert sorted(zip(rows[first].tolist(), n.tolist(), strict=True)) == [([1, 2], 3), ([3, 4], 30), ([5, 6], 5)]
