import hashlib
import os
import subprocess
import sys
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from test_linededup import slow as slow_lines
from test_simhash import slow_classes, slow_print

import __spark_entry__ as entry
import corpus_pipeline
from tidelog.llm import quality
from tidelog.llm.common import ARROW_BYTES, table

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_against_brute_force(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pieces":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()} if name != "mixing" else docs.collect())
    good, lines, single, mix, digests = kept
    start = table(spark, SF, "documents")
    model = quality.learn(start, table(spark, SF, "labels"))
    assert set(good) == {r.doc_id for r in quality.classify(start, model).filter("score >= 0.3").collect()}
    assert {i: r.text for i, r in lines.items()} == slow_lines([(i, r.text) for i, r in good.items()])
    assert all(r.n_chars == len(r.text) for r in lines.values())
    first = slow_classes({i: slow_print(r.text) for i, r in lines.items()})
    assert set(single) == set(first.values())
    sizes, taken = Counter(), Counter()
    for r in single.values():
        sizes[r.source] += len(r.text.split())
    for r in mix:
        assert single[r.doc_id].text.startswith(r.text)
        taken[r.source] += len(r.text.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    assert all(taken[s] <= 3 * sizes[s] for s in sizes)
    assert sum(sizes.values()) - len(sizes) <= sum(taken.values()) <= sum(sizes.values())
    full = {s for s in sizes if taken[s] == 3 * sizes[s]}
    rates = [taken[s] / weight[s] for s in sizes if s not in full]
    assert max(rates) - min(rates) <= 1
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in mix:
        ids = library.encode(r.text, add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect()) == want
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.concat(F.lit("word"), "id"), 1000).alias("text"))
    before = spark.conf.get(ARROW_BYTES)
    try:
        for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[-1]):
            spark.conf.unset(ARROW_BYTES)
            stage(spark, table(spark, SF, "documents"), SF)
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 20 << 20 and max(found) < 6 << 20
    finally:
        spark.conf.set(ARROW_BYTES, before)


def test_all_operators_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry.queries()


def test_the_rest_does_without(tmp_path):
    """Without the subpackage and the pipeline, the entry module still imports."""
    import shutil

    shutil.copytree(os.path.join(HERE, "tidelog"), tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
