"""URL filters by a temporal list join.

Dated entries of lists, which put a key on a list or take it off, become validity intervals. A
capture is looked up under each key that covers its URL, as of the time of its fetch: intervals and
lookups are in one order of key and time, and each lookup takes the last interval that began before it.
Everything is DataFrame functions. Captures of one key and time share a lookup, and the lookups of a hot
host are cut into buckets of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.align import interpolate

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^]/?#]*]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"
#: Hosts that are addresses have no domains above them.
ADDRESS = r"^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, URL, 2), "/", -1), lambda p: p != "")


def keys(url: Column) -> Column:
    """The keys that cover a URL: its host and the domains above it of two labels at least, and the host with each start of its path.

    The host is in lower case, without user, port and a dot at the end. An IPv4 address and one in brackets have no domains
    above them. A URL without a host has no keys.
    """
    host = F.regexp_replace(host_of(url), r"\.$", "")
    labels, parts = F.split(host, r"\.", -1), path_parts(url)
    domains = F.transform(F.sequence(F.lit(1), F.when(F.rlike(host, F.lit(ADDRESS)), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, at, listed) -> (key, since, until) for the times on the list; until is null while it stays there.

    An entry holds until the key's next one. Of entries of one key and time, one that lists wins. Entries with a null
    in any column say nothing.
    """
    known = entries.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("listed").isNotNull())
    one = known.groupBy(F.lower("key").alias("key"), "at").agg(F.max("listed").alias("listed"))
    after = Window.partitionBy("key").orderBy("at")
    return one.withColumn("until", F.lead("at").over(after)).filter("listed").select("key", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", at: str = "fetched", columns: tuple[str, ...] = (), bucket: float | None = None) -> DataFrame:
    """captures with blocked, matched (the first key in order that was active at the fetch) and since (of its interval).

    Of captures, url, fetched and `columns` are returned; others are not read. A capture without a URL, a host or a time is
    not blocked. Rows that are there more than once give as many rows. Keys compare in lower case. Times are numbers, or
    timestamps of one kind; `bucket` is a width of time that cuts the lookups of a key.
    """
    rows = captures.select(F.col(url).alias("url"), F.col(at).alias("fetched"), *columns)
    asked = rows.select("url", "fetched").filter("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    exploded = asked.select("url", "fetched", F.explode(keys(F.col("url"))).alias("key")).withColumn("key", F.lower("key"))
    begins = intervals(entries).select("key", F.col("since").alias("x"), F.struct("since", "until").alias("v"))
    lookups = exploded.select("key", F.col("fetched").alias("x")).distinct()
    # A lookup before the first interval gets that one, which has not begun.
    last = interpolate(begins, lookups, key="key", discrete=True, bucket=bucket, check=False)
    active = last.filter((F.col("v.since") <= F.col("x")) & (F.col("v.until").isNull() | (F.col("x") < F.col("v.until"))))
    active = active.select(F.col("key").alias("of"), F.col("x").alias("as_of"), F.col("v.since").alias("since"))
    hits = exploded.join(active, (F.col("key") == F.col("of")) & (F.col("fetched") == F.col("as_of"))).groupBy("url", "fetched").agg(F.min(F.struct("key", "since")).alias("hit"))
    found = hits.select(F.col("url").alias("u"), F.col("fetched").alias("t"), "hit")
    return rows.join(found, (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("t")), "left").select(
        *columns, "url", "fetched", F.col("hit").isNotNull().alias("blocked"), F.col("hit.key").alias("matched"), F.col("hit.since").alias("since")
    )


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: The tables hold neither times of fetches nor lists, so the query derives both, in days: a page's day from its id;
#: for a third of the hosts and a quarter of the first steps below a host, an entry, for some an end and a return.
def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (_number(F.concat(F.lit("fetch"), F.col("page_id").cast("string"))) % 365).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    both = pages.select(F.explode(F.array(host, F.concat_ws("/", host, F.try_element_at(path_parts(F.col("url")), F.lit(1))))).alias("key")).filter("key IS NOT NULL AND key <> ''").distinct()
    dated = both.withColumn("n", _number(F.concat(F.lit("list"), F.col("key")))).filter(F.col("n") % F.when(F.contains("key", F.lit("/")), 4).otherwise(3) == 0)
    first = F.floor(F.col("n") / 16) % 300
    event = lambda day, listed, when: F.when(when, F.struct(day.cast("long").alias("at"), F.lit(listed).alias("listed")))
    events = F.array(event(first, True, F.lit(True)), event(first + 40, False, F.col("n") % 2 == 0), event(first + 90, True, F.col("n") % 10 == 0))
    return dated.select("key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("key", "e.at", "e.listed")


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, ('0x' || substr(md5('fetch' || page_id::VARCHAR), 1, 8))::BIGINT % 365 AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^]/?#]*]|[^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^]/?#]*]|[^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), '/'), lambda p: p <> '') AS parts
  FROM pages
), dated AS (
  SELECT key, ('0x' || substr(md5('list' || key), 1, 8))::BIGINT AS n
  FROM (SELECT host AS key FROM parsed UNION SELECT host || coalesce('/' || parts[1], '') FROM parsed) WHERE key <> ''
), events AS (
  SELECT key, (n // 16) % 300 AS day, true AS listed, n FROM dated
  UNION ALL SELECT key, (n // 16) % 300 + 40, false, n FROM dated WHERE n % 2 = 0
  UNION ALL SELECT key, (n // 16) % 300 + 90, true, n FROM dated WHERE n % 10 = 0
), spans AS (
  SELECT lower(key) AS key, day AS since, lead(day) OVER (PARTITION BY lower(key) ORDER BY day) AS until, listed
  FROM (SELECT lower(key) AS key, day, bool_or(listed) AS listed FROM events
        WHERE n % (CASE WHEN contains(key, '/') THEN 4 ELSE 3 END) = 0 GROUP BY ALL)
), covered AS (
  SELECT page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, CASE WHEN regexp_matches(host, '^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$') THEN 2 ELSE greatest(len(string_split(host, '.')), 2) END), lambda k: array_to_string(string_split(host, '.')[k:], '.')),
    list_transform(range(1, len(parts) + 1), lambda k: host || '/' || array_to_string(parts[1:k], '/')))) AS key
  FROM parsed WHERE host <> ''
), hits AS (
  SELECT c.url, c.fetched, min({'key': s.key, 'since': s.since}) AS hit
  FROM covered c JOIN spans s ON lower(c.key) = s.key AND s.listed AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
  GROUP BY ALL
)
SELECT p.page_id, p.url, p.fetched, h.hit IS NOT NULL AS blocked, coalesce(h.hit.key, '') AS matched, coalesce(h.hit.since, -1)::BIGINT AS since
FROM parsed p LEFT JOIN hits h ON p.url = h.url AND p.fetched = h.fetched
"""
