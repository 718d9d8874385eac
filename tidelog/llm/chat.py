"""Chat formatting by schema fingerprints.

A record is JSON text of any layout. The paths of its nested fields, as far as some layout knows
them, are hashed; the hash selects a declarative layout, which says where the record's turns are.
The turns of a conversation are laid out under one template, in which control strings inside texts
are escaped, with marks that tell where each turn begins and which characters count for the loss.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
#: Marks of the template. A turn is START, role, a line feed, text, END.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that mean something to this template or to other ones. None is part of another, and none begins inside another.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Other names of roles in lists of the layout `shared`.
ALIASES = {"human": "user", "gpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are: in the list `each`, or in the record itself, under the fields `role` and `text` (a list
    of texts if `text` has [], the first path that is there if it has |); or under fields of their own for each of `fixed`:
    (role, the fields that make up its text)."""

    needs: tuple[str, ...] = ()
    may: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    aliases: bool = False
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def shapes(self) -> list[frozenset[str]]:
        """The sets of paths that a record of this layout may have."""
        extras = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [shape for extra in extras if (shape := frozenset(self.needs + extra))]


LAYOUTS = {
    "messages": Layout(needs=("messages[].role", "messages[].content"), may=("system",), each="messages", role="role", text="content[].text|content", fixed=(("system", ("system",)),)),
    "parts": Layout(needs=("messages[].role", "messages[].content[].text"), may=("system",), each="messages", role="role", text="content[].text", fixed=(("system", ("system",)),)),
    "shared": Layout(needs=("conversations[].from", "conversations[].value"), may=("system",), each="conversations", role="from", text="value", aliases=True, fixed=(("system", ("system",)),)),
    "turn": Layout(needs=("role", "text"), role="role", text="text"),
    "prompt": Layout(may=("system", "prompt", "completion"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    "response": Layout(needs=("prompt", "response"), may=("system",), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    "instruction": Layout(needs=("instruction", "output"), may=("input", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    "question": Layout(needs=("question", "answer"), may=("system",), fixed=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
}


def fingerprint(paths: frozenset[str]) -> int:
    """XXH64 of the sorted paths, as Spark's xxhash64 has it."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)), seed=42)
    return value - (value >> 63 << 64)


def field_paths(record: Column) -> Column:
    """The paths of all leaves of a VARIANT, as a.b and a[].b; all elements of a list count together."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"((?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9,]+\))?)"), 1)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), F.lit("").alias("at"), none.alias("out"))

    def step(s: Column, t: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", "")
        top = F.get(s["open"], F.size(s["open"]) - 1)
        named = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        is_name, is_object, is_array, is_end = t.endswith(": "), t == "OBJECT<", t == "ARRAY<", t == ">"
        deeper = F.array_append(s["open"], s["at"])
        return F.struct(
            F.when(is_object | is_array, deeper).when(is_end, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            F.when(is_name, named).when(is_array, F.concat(s["at"], F.lit("[]"))).otherwise(s["at"]).alias("at"),
            F.when(is_name | is_object | is_array | is_end, s["out"]).otherwise(F.array_append(s["out"], s["at"])).alias("out"),
        )

    return F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["out"]))


def layout_of(record: Column, layouts: dict[str, Layout] = LAYOUTS) -> Column:
    """The name of a VARIANT's layout; null if there is none.

    The fingerprint covers the paths that layouts know, so other fields do not change it. A set of known paths that is no
    layout's own goes to the first layout all of whose needed paths are there. ValueError if two layouts share a shape.
    """
    names: dict[int, str] = {}
    for name, layout in layouts.items():
        for shape in layout.shapes():
            if names.setdefault(fingerprint(shape), name) != name:
                raise ValueError(f"{name} and {names[fingerprint(shape)]} have a shape in common: {sorted(shape)}")
    known = sorted({p for layout in layouts.values() for p in layout.needs + layout.may})
    paths = F.array_intersect(field_paths(record), F.lit(known))
    by_print = F.expr("map(" + ", ".join(f"cast('{k}' as bigint), {_quoted(v)}" for k, v in names.items()) + ")")
    exact = F.try_element_at(by_print, F.xxhash64(F.array_join(F.array_sort(paths), "\n")))
    within = [F.when(F.size(F.array_except(F.lit(list(layout.needs)), paths)) == 0, name) for name, layout in layouts.items() if layout.needs]
    return F.when(F.size(paths) > 0, F.coalesce(exact, *within))


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _message(value: Column, layout: Layout) -> Column:
    def found(path: str) -> Column:
        whole, _, inner = path.partition("[].")
        return F.array_join(F.transform(_at(value, whole, "array<variant>"), lambda p: _at(p, inner, "string")), "") if inner else _at(value, path, "string")

    text = F.coalesce(*map(found, layout.text.split("|")))
    role = F.coalesce(_at(value, layout.role, "string"), F.lit(""))
    if layout.aliases:
        role = F.coalesce(F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ALIASES.items())), role), role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    """Turns from fields of their own come first; one whose fields are all absent or null is none."""
    own = []
    for role, fields in layout.fixed:
        texts = [_at(record, f, "string") for f in fields]
        text = F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n") if len(texts) > 1 else texts[0]
        own.append(F.when(F.coalesce(*texts).isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    fixed = F.filter(F.array(*own), lambda t: t.isNotNull()) if own else F.array()
    listed = F.array()
    if layout.each:
        listed = F.coalesce(F.transform(_at(record, layout.each, "array<variant>"), lambda m: _message(m, layout)), F.array().cast(TURN))
    elif layout.role:
        listed = F.array(_message(record, layout))
    return F.concat(fixed.cast(TURN), listed.cast(TURN))


def turns(records: DataFrame, *, conv: str = "conv_id", turn: str = "turn", record: str = "record", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """Records (conv, turn, record as JSON text) -> a row for each turn: conv, turn, place, layout, role, text.

    A conversation may be one record or several, of different layouts; `turn` orders them, `place` the turns of one record.
    A null role or text is empty. Text that is no JSON, and a record of no layout, null or past Spark's limit for a VARIANT
    give one row with a null layout, role and text, so that nothing goes unseen. Other columns are not read.
    """
    read = records.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.try_parse_json(F.col(record)).alias("record"))
    named = read.withColumn("layout", layout_of(F.col("record"), layouts))
    found = F.coalesce(*(F.when(F.col("layout") == name, _turns(F.col("record"), layout)) for name, layout in layouts.items()))
    rows = named.select("conv", "turn", "layout", F.posexplode_outer(found).alias("place", "said"))
    return rows.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.coalesce("place", F.lit(0)).alias("place"), "layout", "said.role", "said.text")


def _quoted(text: str) -> str:
    """A literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escaped(column: str, *, line: bool = False) -> Column:
    r"""A backslash becomes \b, and each control string gets \z after its first character; `line`: a line feed becomes \n."""
    changes = [("\\", "\\b"), *((s, f"{s[0]}\\z{s[1:]}") for s in CONTROL), *[("\n", "\\n")] * line]
    return F.expr(reduce(lambda sql, change: f"replace({sql}, {_quoted(change[0])}, {_quoted(change[1])})", changes, f"`{column}`"))


def unescaped(text: Column, *, line: bool = False) -> Column:
    out = F.replace(text, F.lit("\\z"), F.lit(""))
    out = F.replace(out, F.lit("\\n"), F.lit("\n")) if line else out
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def formatted(said: DataFrame, *, conv: str = "conv_id", turn: str = "turn", learn: str = "assistant") -> DataFrame:
    """Turns -> a row for each conversation: conv, formatted, marks.

    Turns are in order of (turn, place, role, text), nulls first; repeated rows are turns each, and a null conv is one
    conversation. marks has for each turn the code points at which it starts, and between which the loss counts: the text
    of a turn whose role is `learn`, else nothing (start = from = to). Rows without a role (of records that were not
    understood) are no turns. A conversation is one text, so it must fit into a row.
    """
    rows = said.filter(F.col("role").isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "place", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(START), escaped("role", line=True), F.lit("\n")))
    rows = rows.withColumn("piece", F.concat("head", escaped("text"), F.lit(END))).withColumn("head", F.length("head").cast("long"))
    order = Window.partitionBy("conv").orderBy("turn", "place", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.length("piece")
    lost = F.col("role") == learn
    mark = F.struct(start.alias("start"), F.when(lost, start + F.col("head")).otherwise(start).alias("from"), F.when(lost, F.col("end") - len(END)).otherwise(start).alias("to"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("n", "piece", mark.alias("mark")))).alias("all"))
    return whole.select(F.col("conv").alias(conv), F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"), F.transform("all", lambda t: t["mark"]).alias("marks"))


def read_back(rows: DataFrame, *, text: str = "formatted", marks: str = "marks") -> DataFrame:
    """Adds to rows with formatted text and marks: `said` (the turns that the text holds), `learned` (all text under the loss)."""
    ends = F.split(F.col(text), r"<\|im_end\|>\n", -1)
    pieces = F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        line = F.position(F.lit("\n"), piece)
        role = F.substring(piece, F.lit(len(START) + 1), line - len(START) - 1)
        return F.struct(unescaped(role, line=True).alias("role"), unescaped(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    def under(piece: Column, k: Column) -> Column:
        mark = F.get(F.col(marks), k)
        return unescaped(F.substring(piece, (mark["from"] - mark["start"] + 1).cast("int"), (mark["to"] - mark["from"]).cast("int")))

    return rows.withColumn("said", F.transform(pieces, turn)).withColumn("learned", F.array_join(F.transform(pieces, under), ""))


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records of several layouts, by a hash of the conversation's number.

    Layouts that rename roles get those turns alone that they can name.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = F.to_json(F.struct("conv_id", "turn", role.alias("role"), text.alias("text")))
    messages = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    parts = F.to_json(F.struct(F.array(F.struct(role.alias("role"), F.array(F.struct(text.alias("text"), F.lit("text").alias("type"))).alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.array(F.struct(F.when(role == "user", "human").otherwise("gpt").alias("from"), text.alias("value"))).alias("conversations")))
    prompt = F.to_json(F.struct(F.when(role == "user", text).alias("prompt"), F.when(role == "assistant", text).alias("completion"), F.when(role == "system", text).alias("system")))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    record = F.when((kind == 1) & role.isin("user", "assistant"), shared).when((kind == 2) & role.isin("user", "assistant", "system"), prompt).when(kind == 3, parts).when(kind == 4, messages).otherwise(plain)
    return rows.select("conv_id", "turn", record.alias("record"))


#: What the formatted table must give, told from the rows themselves.
_MARKED = reduce(lambda sql, s: f"replace({sql}, '{s}', '{s[0]}\\z{s[1:]}')", CONTROL, "replace({0}, '\\', '\\b')")
ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, length({_MARKED.format("text")}) + length(replace({_MARKED.format("role")}, chr(10), '\\n')) + {len(START) + 1 + len(END)} AS size FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""
