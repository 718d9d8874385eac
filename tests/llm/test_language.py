import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import language
from tidelog.llm.common import table

SF = "/root/testdata/sf0.01"


def slow_grams(text):
    out, words, word = Counter(), [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in words:
        padded = f" {w} "
        for k, c in enumerate(padded):
            if c != " ":
                out[c] += 1
            if k:
                out[padded[k - 1 : k + 1]] += 1
            if k > 1:
                out[padded[k - 2 : k + 1]] += 1
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << language.BITS | ord(c)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab éß1. \n中", max_size=60))
def test_grams_are_those_of_padded_words(text):
    codes, counts = language.grams(text)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in slow_grams(text).items()}


def test_blocks_do_not_matter(monkeypatch):
    text = "some words, and more of them. " * 50
    whole = language.grams(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, language.grams(text), strict=True))


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    out = language.identify(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_edges_of_the_input(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 .", "de"), (None, "the cat", "en"), (5, "the the cat " * 100_000, "en"), (6, "der hund", "de"), (6, "der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs, language.learn(docs)).collect()
    assert len(out) == 7
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (1, 2, 3))
    nothing = language.identify(docs, language.learn(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(docs.limit(0), language.learn(docs)).count() == 0


def test_predictions_are_those_of_brute_force(spark):
    """Profiles, distances, ties and scores by plain counting over all documents that are not held out."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text", "lang").collect()
    sums = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            sums.setdefault(r.lang, Counter()).update(slow_grams(r.text))

    def profile(counts):
        ranked = sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.RANKS]
        return {g: rank for rank, g in enumerate(ranked)}

    profiles = {lang: profile(counts) for lang, counts in sorted(sums.items())}
    want = {}
    for r in rows:
        own = profile(slow_grams(r.text or ""))
        far = {lang: sum(abs(p[g] - rank) if g in p else language.RANKS for g, rank in own.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        want[r.doc_id] = (best, 1 - far[best] / (language.RANKS * len(own))) if own else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.learn(docs)).collect()}
    assert len(profiles) == 4 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
