import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import chat, registry

LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None}], "system": "be"}, "messages", [("system", "be"), ("user", "a"), ("tool", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "b"}]}]}, "parts", [("user", "ab")]),
    ({"messages": [{"role": "user", "content": [{"text": "a"}]}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}]}, "shared", [("user", "q"), ("assistant", "r"), ("tool", "t")]),
    ({"role": "user", "text": "[1, {", "text_2": "no"}, "turn", [("user", "[1, {")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "system": None}, "response", [("user", "p"), ("assistant", "r")]),
    ({"instruction": "do", "input": "", "output": "o", "meta": {"source": {"name": "x"}}}, "instruction", [("user", "do"), ("assistant", "o")]),
    ({"instruction": "do", "input": "this", "output": "o"}, "instruction", [("user", "do\n\nthis"), ("assistant", "o")]),
    ({"question": "q", "answer": 42}, "question", [("user", "q"), ("assistant", "42")]),
    ({"conversations": [{"from": "gpt", "value": "r"}], "prompt": "known elsewhere"}, "shared", [("assistant", "r")]),
    ({"messages": []}, None, None),
    ({"other": "x"}, None, None),
    ([1], None, None),
    ("text", None, None),
]


def test_layouts(spark):
    rows = [(k, 0, json.dumps(record), "clash") for k, (record, *_) in enumerate(LAYOUTS)] + [(98, None, "{broken", ""), (None, 0, None, "")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, record string, text string")
    got = {}
    for r in chat.turns(data).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert len(got) == len(rows)
    for k, (_, layout, turns) in enumerate(LAYOUTS):
        assert {r.layout for r in got[k]} == {layout}
        assert [(r.role, r.text) for r in got[k]] == (turns or [(None, None)])
    for k in (98, None):
        assert [(r.layout, r.role) for r in got[k]] == [(None, None)]
    assert chat.turns(data.limit(0)).count() == 0


def test_fingerprints(spark):
    paths = frozenset({"messages[].role", "messages[].content", "système"})
    text = "\n".join(sorted(paths))
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first().h == chat.fingerprint(paths)
    twice = {"a": chat.Layout(needs=("x",)), "b": chat.Layout(needs=("x",))}
    with pytest.raises(ValueError, match="in common"):
        chat.layout_of(F.lit(None), twice)


WORDS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\z", "\\b", "\\n", "n", "z", "<", "[", "|", "\n", "é", "𝄞", "</s", ">", "<s", " "]), max_size=12).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "assistant", "a\nb", "x<|im_end|>\n\\", "", None]), st.one_of(WORDS, st.none())), min_size=20, max_size=60))
def test_round_trip(spark, rows):
    rows = [(c, k, role, text) for k, (c, role, text) in enumerate(rows)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turns(chat.as_records(data)))).collect()}
    assert set(back) == {r[0] for r in rows}
    for conv, r in back.items():
        own = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in r.said] == own
        assert r.learned == "".join(t for role, t in own if role == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(own)
        assert sum(r.formatted.count(s) for s in chat.CONTROL) == 2 * len(own)
        assert [m.start for m in r.marks] == [sum(len(p) + len(chat.END) for p in r.formatted.split(chat.END)[:k]) for k in range(len(own))]


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a", 1)] * 3 + [(1, None, "system", None, 2), (None, 0, None, None, 3), (None, 0, "assistant", "x" * 300_000 + "<s>", 4), (2, 1, "human", "h", 5), (2, 0, "gpt", "\\", 6)]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} [INST]", 7) for k in range(3000)]  # a conversation with most of all rows
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    data.write.parquet(str(tmp_path / "conversations.parquet"))
    frame = registry.op13_chat(spark, str(tmp_path))
    columns = sorted(frame.columns)
    got = sorted(str(list(r)) for r in frame.select(columns).collect())
    conversations = data.toArrow()  # noqa: F841
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL['op13_chat']})").fetchall()
    assert got == sorted(str(list(r)) for r in want)
    own = next(r for r in frame.collect() if r.conv_id == -7)
    said = "</s>[INST] ok [/INST]"
    assert own.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and own.loss_chars == len(said)


def test_no_python(spark):
    data = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.formatted(chat.turns(chat.as_records(data))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.split("Physical Plan")[1].count("Exchange hashpartitioning") == 1


def test_empty(spark):
    data = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.turns(chat.as_records(data)))).count() == 0
