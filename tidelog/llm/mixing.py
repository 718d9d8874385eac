"""Mixing sources to target weights.

Each document gets a hash-random key, of its id and its text. The keys of a source are dealt to ranges; sums of the ranges
give each range its start in the source's sequence, and sums within a range give each document its
own. A source takes its whole sequence as often as its target holds it, and then cuts the sequence
at what is left of the target. The ranges split a hot source, so no task holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved

#: Weights, repeating over the sources in order of code points.
WEIGHTS = (5, 2, 1)
#: No target is above so many times the size of its source.
MOST_EPOCHS = 3
#: Rows of a range, about; a range is named by the first hex digits of the key, of which there are two at least.
RANGE_ROWS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> the same with target, by water-filling under MOST_EPOCHS times the size.

    One row for each source, which is all that this sorts in one task. A level L is sought so that the targets
    min(MOST_EPOCHS * size, weight * L) add up to the sum of all sizes: the sources with the smallest ratio of cap to
    weight are the full ones, and the first ratio that is not below its level begins the rest.
    """
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("ordinal") - 1) % len(WEIGHTS) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.col("source_size") * MOST_EPOCHS
    return (
        sizes.withColumn("ordinal", F.row_number().over(by_name))
        .withColumn("weight", weights)
        .withColumn("ratio", cap.cast("double") / F.col("weight"))
        .withColumn("full_size", F.coalesce(F.sum(cap).over(by_ratio), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("full_size")).cast("double") / (F.sum("weight").over(whole) - F.col("full_weight")))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "ordinal", "level"))).over(whole)["level"])
        .select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), cap.cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", salt: str = "mix") -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target, taken, and source, epochs, part.

    epochs is how often the whole document is taken, part the words of one more, cut copy. The words taken of a source
    are its target without the fraction. A null source is a source of its own, a null text has no words, a null id is
    keyed as the empty text. The key is that of id and text, so rows that share an id, or have none, are spread and ordered
    like others; rows that are equal in both share the words of their places in any order. Other columns are not read. An
    empty table gives an empty result.
    """
    placed = _placed(docs, doc_id, text, source, salt, carry=False)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("part")).alias("taken"), "source", "epochs", "part")


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, salt: str, *, carry: bool) -> DataFrame:
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    # Rows of one id and text that are carried are told apart by their other columns, as far as Spark can hash them.
    rest = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)) if carry else F.lit(0)
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] * carry
    digits = max(2, math.ceil(math.log(max(1, docs.count() / RANGE_ROWS), 16)))
    sized = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), key.alias("key"), rest.alias("rest"), *whole)
        .withColumn("range", F.substring("key", 1, digits))
    )
    if not carry:
        sized = saved(sized)
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).select("source", "range", "start")
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    plan = saved(
        starts.join(goals, starts.source.eqNullSafe(goals.source)).select(starts.source.alias("of"), F.col("range").alias("in"), "start", "source_size", "target")
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "rest").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(plan, placed.source.eqNullSafe(F.col("of")) & (placed.range == F.col("in")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("inside")
    return joined.withColumn("epochs", epochs).withColumn("part", F.least("size", F.greatest(F.lit(0), left)).cast("long"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", salt: str = "mix") -> DataFrame:
    """The documents of the mix, with the columns of docs: a row for each time that one is taken.

    A copy that the budget cuts ends with the last word taken; documents without a word are kept once, as they weigh
    nothing. Rows that share an id are told apart as in mix(), those that share a text too by their other columns, so reruns
    agree whatever order the rows come in.
    """
    placed = _placed(docs, doc_id, text, source, salt, carry=True)
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    body = F.when((F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size")), cut).otherwise(F.col(f"row.{text}"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + (F.col("part") > 0).cast("long"))
    rows = placed.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*((body if c == text else F.col(f"row.{c}")).alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((ordinal - 1) % 3 + 1)::INT] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ordinal FROM sizes)
), ratios AS (SELECT *, (3 * source_size)::DOUBLE / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT source, source_size, ratio, weight, (SELECT arg_min(level, (ratio, ordinal)) FROM levels WHERE ratio >= level) AS level FROM levels
), goals AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM leveled
), placed AS (
  SELECT s.*, g.source_size, g.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END::BIGINT AS epochs FROM placed
), parts AS (
  SELECT *, least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - place))::BIGINT AS part FROM taken
)
SELECT doc_id, size, source_size, target, (size * epochs + part)::BIGINT AS taken, source, epochs, part FROM parts
"""
