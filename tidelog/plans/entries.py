"""Log entries derived from the events: the source is user_id modulo 256, the payload is props, times count from each source's first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import archive
from tidelog.plans.base import micros, query, table


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries; of those at a source's first time, the one with the smallest event is the onset, and the others follow a microsecond later."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 256).cast("int").alias("source_id"), micros("ts").alias("us"), "event_id", F.encode(F.coalesce("props", F.lit("")), "UTF-8").alias("payload"))
    first = events.groupBy("source_id").agg(F.min(F.struct("us", "event_id")).alias("first"))
    joined = events.join(first, "source_id")
    onset = (F.col("us") == F.col("first.us")) & (F.col("event_id") == F.col("first.event_id"))
    elapsed = F.when(onset, 0).otherwise(F.greatest(F.col("us") - F.col("first.us"), F.lit(1)))
    return joined.select("event_id", "source_id", elapsed.cast("decimal(20,0)").alias("acquisition_time"), F.when(onset, codec.u64_bytes(F.col("us"))).otherwise(F.col("payload")).alias("serialized_data"))


_PACKAGES = """
WITH ev AS (SELECT (user_id % 256)::INT AS source_id, epoch_us(ts) AS us, event_id, encode(coalesce(props, '')) AS payload FROM events),
fst AS (SELECT source_id, min(us) AS us0, arg_min(event_id, (us, event_id)) AS id0 FROM ev GROUP BY source_id),
pk AS (SELECT event_id, ev.source_id, CASE WHEN event_id = id0 THEN 0 ELSE greatest(us - us0, 1) END AS t, us0, event_id = id0 AS onset, hex(payload) AS payload FROM ev JOIN fst USING (source_id)),
le AS (SELECT *, printf('%016x', t) AS h, printf('%016x', us0) AS h0 FROM pk),
wire AS (SELECT *, upper(printf('%02x', source_id) || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS header,
  CASE WHEN onset THEN upper(h0[15:16] || h0[13:14] || h0[11:12] || h0[9:10] || h0[7:8] || h0[5:6] || h0[3:4] || h0[1:2]) ELSE payload END AS body FROM le)
"""


@query(_PACKAGES + "SELECT event_id, format('{:03d}_{:020d}.npy', source_id, t) AS entry_name FROM wire")
def log_entry_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir).select("event_id", codec.entry_name(F.col("source_id"), F.col("acquisition_time")).alias("entry_name"))


@query(_PACKAGES + "SELECT event_id, header FROM wire")
def log_entry_header_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir).select("event_id", F.hex(codec.header(F.col("source_id"), F.col("acquisition_time"))).alias("header"))


@query(_PACKAGES + "SELECT event_id, header || body AS data FROM wire")
def log_entry_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.with_wire(packages(spark, sf_dir)).select("event_id", F.hex("data").alias("data"))


@query(_PACKAGES + "SELECT event_id, source_id, t::BIGINT AS elapsed, body AS payload FROM wire")
def log_header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    return codec.with_wire(packages(spark, sf_dir)).select("event_id", codec.source_of(data).alias("source_id"), codec.elapsed_of(data).cast("long").alias("elapsed"), F.hex(codec.payload_of(data)).alias("payload"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.with_wire(packages(spark, sf_dir))


@query(_PACKAGES + "SELECT source_id, (us0 + t)::BIGINT AS timestamp_us, body AS payload FROM wire WHERE t <> 0")
def message_absolute_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(_keyed(spark, sf_dir))
    return rows.select("source_id", F.col("timestamp_us").cast("long").alias("timestamp_us"), F.hex("payload").alias("payload"))


@query(_PACKAGES + "SELECT w.event_id, (us0 + t)::BIGINT AS timestamp_us FROM wire w JOIN (SELECT source_id, event_id AS onset_place FROM wire WHERE t = 0) o ON w.source_id = o.source_id WHERE w.event_id > onset_place")
def messages_after_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in order of arrival instead of time: what lies before the onset in the archive is no message."""
    rows = packages(spark, sf_dir).withColumn("place", F.col("event_id"))
    kept = archive.after_onset(rows).join(archive.onsets(rows), "source_id")
    return kept.select("event_id", (F.col("onset_us") + F.col("acquisition_time")).cast("long").alias("timestamp_us"))


@query(_PACKAGES + "SELECT source_id, t::BIGINT AS elapsed FROM wire WHERE t > 0")
def messages_excluding_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages(spark, sf_dir).filter("acquisition_time > 0").select("source_id", F.col("acquisition_time").cast("long").alias("elapsed"))


@query(_PACKAGES + "SELECT event_id, format('{:03d}_{:020d}', source_id, t) AS entry_key FROM wire w WHERE EXISTS (SELECT 1 FROM wire k WHERE k.source_id = w.source_id AND k.t = w.t AND k.event_id % 7 = 0)")
def message_key_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, sf_dir)
    return archive.of_keys(rows, rows.filter("event_id % 7 = 0").select("entry_key")).select("event_id", "entry_key")


@query(_PACKAGES + "SELECT source_id, count(*) FILTER (WHERE t <> 0) AS messages FROM wire GROUP BY source_id")
def message_count_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.message_counts(packages(spark, sf_dir))


@query(_PACKAGES + "SELECT DISTINCT source_id, us0 AS onset_us FROM wire")
def onset_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.onsets(_keyed(spark, sf_dir)).select("source_id", F.col("onset_us").cast("long").alias("onset_us"))


@query(_PACKAGES + "SELECT source_id, string_agg(event_id::VARCHAR, ',' ORDER BY t, event_id) AS event_ids FROM wire GROUP BY source_id")
def entries_grouped_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.grouped(packages(spark, sf_dir), "event_id")
    return rows.select("source_id", F.array_join(F.transform("event_id", lambda v: v.cast("string")), ",").alias("event_ids"))


@query("SELECT (user_id % 256)::INT AS source_id, (epoch_us(ts) // 3600000000)::BIGINT AS acquisition_time, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def entries_dedup_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a clock of hours many entries share a key, and the last one stays."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 256).cast("int").alias("source_id"), F.floor(micros("ts") / 3_600_000_000).alias("acquisition_time"), "value", "event_id")
    return archive.last_write(rows, "event_id").select("source_id", "acquisition_time", "value")


#: Rows of the parts of a long source, small enough that these tables have several.
PART_ROWS = 1000
#: One source for each event type, so that some sources are long enough to be split.
_TYPED = "SELECT event_id, event_type AS source_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events"
_BATCH = f"SELECT event_id, source_id, ((place - 1) // CASE WHEN total < 2000 THEN total ELSE greatest(1, ceil(total / 32.0)::BIGINT) END)::BIGINT AS batch FROM ({_TYPED})"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_id"), (F.col("event_id") + 1).alias("acquisition_time"))


@query(_BATCH)
def archive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.batches(_typed(spark, sf_dir), workers=8).select("event_id", "source_id", "batch")


@query(f"SELECT source_id, batch, count(*) AS messages FROM ({_BATCH}) GROUP BY source_id, batch")
def archive_batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.batches(_typed(spark, sf_dir), workers=8).groupBy("source_id", "batch").agg(F.count("*").alias("messages"))


@query("SELECT event_id, ((place - 1) // CASE WHEN total < 2000 THEN total ELSE ceil(total / 32.0)::BIGINT END)::BIGINT AS batch FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () AS total FROM events)")
def archive_batches_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one source, which is numbered in parts."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("source_id"), (F.col("event_id") + 1).alias("acquisition_time"))
    return archive.batches(rows, workers=8, rows=PART_ROWS // 4).select("event_id", "batch")


_DAMAGED = """, dmg AS (SELECT source_id, t, CASE WHEN event_id % 97 = 0 THEN body || '00' ELSE body END AS theirs FROM wire WHERE event_id % 101 <> 0)
SELECT coalesce(w.source_id, d.source_id)::INT AS source_id, coalesce(w.t, d.t)::BIGINT AS acquisition_time, w.body AS ours, d.theirs
FROM wire w FULL JOIN dmg d ON w.source_id = d.source_id AND w.t = d.t WHERE w.body IS DISTINCT FROM d.theirs"""


@query(_PACKAGES + _DAMAGED)
def archive_verify_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a copy with some payloads made longer and some entries lost."""
    rows = packages(spark, sf_dir)
    damaged = rows.filter("event_id % 101 <> 0").withColumn("serialized_data", F.when(F.col("event_id") % 97 == 0, F.concat("serialized_data", F.unhex(F.lit("00")))).otherwise(F.col("serialized_data")))
    return archive.mismatches(rows, damaged, "serialized_data").select("source_id", F.col("acquisition_time").cast("long").alias("acquisition_time"), F.hex("ours").alias("ours"), F.hex("theirs").alias("theirs"))


@query("SELECT event_id, upper(printf('%02x', event_id % 256) || printf('%02x', (event_id * 7) % 256) || printf('%02x', (user_id + 300) % 256)) AS payload FROM events")
def payload_narrow_mod256(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.array("event_id", F.col("event_id") * 7, F.col("user_id") + 300).alias("payload"))
    return rows.select("event_id", F.hex(codec.payload_bytes(rows, "payload", narrow=True)).alias("payload"))
