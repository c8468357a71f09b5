"""URL lists with dates, joined with captures as of their fetch time, as DataFrame expressions only.

A list is a table of dated entries (``key``, ``day``, ``action``: add or remove). Entries of one key and day fold
to one (a removal that day wins), so that a key has at most one row for each day; each row is then in force until
the key's next day, which makes disjoint intervals. An interval is dealt to the periods of ``PERIOD`` days that it
touches, and captures meet it on (key, period), so that neither a key with a long history nor a capture compares
with all intervals of the key. At most one interval holds at a capture's time: the join adds no rows, and needs
no aggregate after it. Captures of one very common host are a hot key of the capture side only, which Spark's
skew join splits.

A capture is tried by host, by site (the last two labels) and by host and first path segment.

Defined cases: a null or unparsable url has no keys and is never listed; a null fetch day matches nothing; null
keys, days or actions of list rows are ignored; repeated captures each give a row; an interval without an end
stays open: its periods reach to the last day on which anything was fetched; empty tables: no captures, no rows; no
list, nothing is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 30
#: Days over which :func:`dated_captures` deals its captures.
DAYS = 360


def host_of(url: Column) -> Column:
    """Host in lower case without user, port, last dot and ``www.``; an IPv6 address keeps its brackets; null where there
    is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


#: Suffixes of two labels under which anybody registers names. Fixed values.
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
_ADDRESS = r"^\[|^[0-9]{1,3}([.][0-9]{1,3}){3}$"


def _under(suffixes: tuple[str, ...]) -> str:
    return "(" + "|".join([rf"[^.]+\.{x.replace('.', '[.]')}" for x in suffixes] + [r"[^.]+\.[^.]+"]) + ")$"


def site_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last two labels, the last three under a suffix of two, or the host itself, as it is if it is an address."""
    return F.when(host.rlike(_ADDRESS), host).otherwise(F.coalesce(F.nullif(F.regexp_extract(host, rf"(?:^|\.){_under(suffixes)}", 1), F.lit("")), host))


def section_of(url: Column, host: Column) -> Column:
    """Host and first path segment."""
    return F.concat(host, F.lit("/"), F.regexp_extract(url, r"://[^/?#]*/([^/?#]*)", 1))


def intervals(entries: DataFrame, last_day: int) -> DataFrame:
    """``key``, ``since``, ``until`` (exclusive, null while open) and ``period``, for each period up to ``last_day``."""
    known = entries.where("key is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("key", "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    until = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    spans = daily.withColumn("until", until).where(~F.col("gone") & (F.col("day") <= last_day))
    end = F.least(F.coalesce(F.col("until") - 1, F.lit(last_day)), F.lit(last_day))
    periods = F.sequence(F.floor(F.col("day") / PERIOD).cast("int"), F.floor(end / PERIOD).cast("int"))
    return spans.select("key", F.col("day").alias("since"), "until", F.explode(periods).alias("period"))


def as_of(captures: DataFrame, entries: DataFrame, key: str, since: str, last_day: int) -> DataFrame:
    """``captures`` with the start of the interval that lists column ``key`` on ``fetched``, or null."""
    spans = intervals(entries, last_day).select(F.col("key").alias("_key"), F.col("since").alias(since), F.col("until").alias("_until"), F.col("period").alias("_period"))
    own = F.floor(F.col("fetched") / PERIOD).cast("int")
    held = (F.col("fetched") >= F.col(since)) & (F.col("_until").isNull() | (F.col("fetched") < F.col("_until")))
    return captures.join(spans, (F.col(key) == F.col("_key")) & (own == F.col("_period")) & held, "left").drop("_key", "_until", "_period")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture (``page_id``, ``url``, ``fetched``) against the entries active when it was fetched."""
    keyed = captures.select("page_id", "url", "fetched").withColumn("host", host_of(F.col("url")))
    last_day = captures.agg(F.max("fetched")).first()[0]  # one number
    keyed = keyed.withColumn("site", site_of(F.col("host"))).withColumn("section", section_of(F.col("url"), F.col("host")))
    for key in ("host", "site", "section"):
        own = entries.where(F.col("kind") == key)
        keyed = as_of(keyed, own, key, f"{key}_since", -1 if last_day is None else last_day)
    listed = F.least("host_since", "site_since", "section_since")
    return keyed.select("page_id", "host", "fetched", "host_since", "site_since", "section_since", listed.isNotNull().alias("blocked"), listed.alias("active_since"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures with a day each: the table has no times, so the id gives one."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int").alias("fetched"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A list that the pages themselves give: entries of hosts, sites and sections on days told by their first id."""
    host = host_of(F.col("url"))
    keys = pages.select("page_id", "url", host.alias("host"))
    keys = keys.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("host", F.col("host")), ("site", site_of(F.col("host"))), ("section", section_of(F.col("url"), F.col("host"))))))).alias("k"))
    seen = keys.where("k.key is not null and page_id is not null").groupBy("k.kind", "k.key").agg(F.min("page_id").alias("m"), F.count("*").alias("c"))
    day = F.pmod(F.col("m") * 7, F.lit(300)).cast("int")
    rows = [
        (F.pmod("m", F.lit(3)) != 1, day, "add"),
        (F.pmod("c", F.lit(2)) == 1, day + 45, "remove"),
        (F.pmod("c", F.lit(3)) != 2, day + 45, "add"),
        (F.lit(True), day + 100, "remove"),
        (F.pmod("m", F.lit(5)) == 0, day + 130, "add"),
    ]
    events = F.array_compact(F.array(*(F.when(on, F.struct(d.alias("day"), F.lit(a).alias("action"))) for on, d, a in rows)))
    return seen.select("kind", "key", F.explode(events).alias("e")).select("kind", "key", "e.day", "e.action")


EVALUATE_SQL = f"""
with page as (
  select page_id, url, nullif(regexp_replace(regexp_replace(regexp_extract(lower(url),
    '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)', 1), '\\.$', ''), '^www\\.', ''), '') as host from pages),
keyed as (
  select *, case when regexp_matches(host, '{_ADDRESS}') then host
    else coalesce(nullif(regexp_extract(host, '(?:^|\\.){_under(SUFFIXES)}', 1), ''), host) end as site,
    host || '/' || regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) as section,
    cast((page_id * 37) % 360 as integer) as fetched from page),
seen as (
  select kind, key, min(page_id) as m, count(*) as c from (
    select page_id, 'host' as kind, host as key from keyed union all
    select page_id, 'site', site from keyed union all select page_id, 'section', section from keyed)
  where key is not null and page_id is not null group by kind, key),
entry as (
  select kind, key, cast((m * 7) % 300 as integer) as day, 'add' as action from seen where m % 3 <> 1 union all
  select kind, key, cast((m * 7) % 300 as integer) + 45, 'remove' from seen where c % 2 = 1 union all
  select kind, key, cast((m * 7) % 300 as integer) + 45, 'add' from seen where c % 3 <> 2 union all
  select kind, key, cast((m * 7) % 300 as integer) + 100, 'remove' from seen union all
  select kind, key, cast((m * 7) % 300 as integer) + 130, 'add' from seen where m % 5 = 0),
span as (
  select kind, key, day as since, coalesce(lead(day) over (partition by kind, key order by day), 1000000) as till, gone from (
    select kind, key, day, bool_or(action = 'remove') as gone from entry group by kind, key, day)),
held as (
  select k.page_id, k.host, k.fetched, h.since as host_since, s.since as site_since, c.since as section_since
  from keyed k
  left join span h on h.kind = 'host' and not h.gone and h.key = k.host and k.fetched >= h.since and k.fetched < h.till
  left join span s on s.kind = 'site' and not s.gone and s.key = k.site and k.fetched >= s.since and k.fetched < s.till
  left join span c on c.kind = 'section' and not c.gone and c.key = k.section and k.fetched >= c.since and k.fetched < c.till)
select *, least(host_since, site_since, section_since) is not null as blocked,
  least(host_since, site_since, section_since) as active_since from held
"""
